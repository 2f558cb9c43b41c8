"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items are sequences of normalised words (lower case, outer punctuation removed). An item of m
words occurs in a document if some run of consecutive words, of any length, is within e = floor(m * `max_share`)
edits (insertions, deletions, substitutions of words). Windows of m words, shorter by at most e where the text ends,
are the candidates; from a candidate's start the best end decides. The CGK random walk copies a string of n words into 3n
places: at place j it writes the current word and moves on if a random bit of (j, word) says so, so strings
at a small edit distance get embeddings at a small Hamming distance. `walks` independent walks are each
sampled at `tables` sets of `places` places; a window is compared with the items that share a sample, and
the exact edit distance decides.

A window can hold an item only if enough of its word pairs are pairs of the items: one edit destroys two at
most, so m - 1 - 2 * floor(m * max_share) pairs of items of m words must remain. Windows below that bound
are not embedded. The benchmark is the stated query set: it is indexed in blocks of at most `block`
items, all of which a document meets in one pass, so its row is the same for any number of blocks. The
indexes go to the workers with the code, about 10 KB an item.

Defined results: null text and texts shorter than m - e words match nothing; items without words match nothing,
items of under `shortest` words only a document whose whole text equals them; repeated items count each,
repeated rows are returned each; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches, id_and_text, keep, record_batch

HITS = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64())), ("distance", pa.int64()), ("item_id", pa.int64())])
HITS_DDL = "doc_id long, items array<long>, distance long, item_id long"
OUTER = b".,;:!?\"'()[]{}<>*#%&$|-_/\\"


def normalise(word: bytes) -> bytes:
    return word.strip(OUTER)


def words_of(text: bytes) -> list[bytes]:
    return [w for w in map(normalise, text.lower().split()) if w]


class Vocabulary(dict):
    """Raw lower-cased word -> number: items' words from 2 on, 1 any other, 0 nothing but punctuation."""

    MOST = 200_000

    def __init__(self, items: list[list[bytes]]) -> None:
        super().__init__()
        self.number = {w: k for k, w in enumerate(sorted({w for i in items for w in i}), 2)}

    def __missing__(self, raw: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        word = normalise(raw)
        self[raw] = number = self.number.get(word, 1) if word else 0
        return number


@dataclass
class Index:
    """Item embeddings and everything a worker needs to find one block of items."""

    ids: list[int]
    words: list[list[bytes]]
    max_share: float = 0.2
    walks: int = 8
    tables: int = 12
    places: int = 3
    shortest: int = 5
    seed: int = 11
    vocabulary: Vocabulary = field(init=False)

    def __post_init__(self) -> None:
        self.vocabulary = Vocabulary(self.words)
        self.n_words = len(self.vocabulary.number) + 2
        self.coded = [np.array([self.vocabulary.number[w] for w in i], np.int64) for i in self.words]
        self.whole: dict[tuple, list[int]] = {}
        for k, c in enumerate(self.coded):
            if 0 < len(c) < self.shortest:
                self.whole.setdefault(tuple(c.tolist()), []).append(k)
        self.lengths = sorted({len(c) for c in self.coded if len(c) >= self.shortest})
        of = {m: [k for k, c in enumerate(self.coded) if len(c) == m] for m in self.lengths}
        pairs = {m: np.unique(np.concatenate([c[:-1] * self.n_words + c[1:] for c in (self.coded[k] for k in of[m])])) for m in self.lengths}
        self.pairs = np.unique(np.concatenate(list(pairs.values()))) if pairs else np.zeros(0, np.int64)
        #: By pair and length: an item of that length has the pair.
        self.has = np.zeros((len(self.pairs), len(self.lengths)), bool)
        for column, m in enumerate(self.lengths):
            self.has[np.searchsorted(self.pairs, pairs[m]), column] = True
        # a bit set by the pairs' hashes, to pass over most pairs cheaply
        self.pair_bits = np.zeros(1 << 20, bool)
        self.pair_bits[_slot(self.pairs)] = True
        self.width = self.lengths[-1] if self.lengths else 0
        self.table = {}
        if self.lengths:
            long = [k for m in self.lengths for k in of[m]]
            embedded = self.embed(self._padded([self.coded[k] for k in long]))
            place = {k: r for r, k in enumerate(long)}
            for m in self.lengths:
                keys = self.keys(embedded, np.array([place[k] for k in of[m]]), m)
                self.table[m] = []
                for row in keys.T:
                    found: dict[int, list[int]] = {}
                    for key, k in zip(row.tolist(), of[m]):
                        found.setdefault(key, []).append(k)
                    self.table[m].append((np.sort(np.fromiter(found, np.uint64, len(found))), found))

    def edits(self, m: int) -> int:
        return int(m * self.max_share)

    def need(self, m: int) -> int:
        """Item pairs that a window of m words must hold."""
        return max(1, m - 1 - 2 * self.edits(m))

    def _padded(self, strings: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(strings), self.width + 1), np.int64)
        for r, c in enumerate(strings):
            out[r, : len(c)] = c
        return out

    def embed(self, padded: np.ndarray) -> np.ndarray:
        """(walks, places, strings) embeddings; strings end in zeros, where the walk stays."""
        n = len(padded)
        rows = np.arange(n)
        out = np.empty((self.walks, 2 * self.width, n), np.int32)
        for walk in range(self.walks):
            at = np.zeros(n, np.int64)
            for j in range(2 * self.width):
                word = padded[rows, at]
                out[walk, j] = word
                coin = (word * 0x9E3779B1 + (walk * 1000003 + j) * 0x85EBCA6B + self.seed) & 0xFFFFFFFF
                coin = ((coin ^ (coin >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                at += ((coin >> 17) & 1) & (word > 0)
        return out

    def keys(self, embedded: np.ndarray, strings: np.ndarray, m: int) -> np.ndarray:
        """(strings, walks * tables) hashes of the sampled places; a walk reads m words in 2m places on average."""
        rng = np.random.default_rng(self.seed * 1000 + m)
        out = np.empty((len(strings), self.walks * self.tables), np.uint64)
        for c in range(self.walks * self.tables):
            acc = np.full(len(strings), c + 1, np.uint64)
            for place in rng.choice(2 * m, min(self.places, 2 * m), replace=False):
                acc = (acc ^ embedded[c // self.tables, place, strings].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                acc ^= acc >> np.uint64(29)
            out[:, c] = acc
        return out

    def starts(self, at: np.ndarray, m: int) -> np.ndarray:
        """Starts of the windows of m words that hold enough of the pairs at ascending places."""
        need = self.need(m)
        if len(at) < need:
            return at[:0]
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        near = last - first <= m - 2
        first, last = first[near], last[near]
        if not len(first):
            return first
        low, n = last - (m - 2), first - last + m - 1
        return np.unique(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))

    def find(self, texts: list[np.ndarray]) -> list[dict[int, int]]:
        """For each coded text, the items that occur in it -> their smallest distance."""
        found: list[dict[int, int]] = [{} for _ in texts]
        if self.whole:
            for d, t in enumerate(texts):
                if 0 < len(t) < self.shortest:
                    found[d] = dict.fromkeys((self.ids[k] for k in self.whole.get(tuple(t.tolist()), ())), 0)
        if not self.lengths or not texts:
            return found
        # a zero between the texts parts them, no pair holds it
        flat = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.int64))])
        pair = flat[:-1] * self.n_words + flat[1:]
        at = np.flatnonzero(self.pair_bits[_slot(pair)])
        which = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
        hit = self.pairs[which] == pair[at]
        at, has = at[hit], self.has[which[hit]]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        length, start = [], []
        for column, m in enumerate(self.lengths):
            s = self.starts(at[has[:, column]], m)
            least = m - self.edits(m)
            s = s[(s >= 0) & (s + least <= len(flat))]
            s = s[np.searchsorted(ends, s) == np.searchsorted(ends, s + least - 1)]
            length.append(np.full(len(s), m))
            start.append(s)
        length, start = np.concatenate(length), np.concatenate(start)
        for c in range(0, len(start), 4096):
            self._match(flat, start[c : c + 4096], length[c : c + 4096], ends, found)
        return found

    def _match(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, ends: np.ndarray, found: list[dict[int, int]]) -> None:
        reach = np.arange(self.width + 1)
        doc = np.searchsorted(ends, start)
        padded = np.where(reach < np.minimum(length, ends[doc] - start)[:, None], flat[np.minimum(start[:, None] + reach, len(flat) - 1)], 0)
        embedded = self.embed(padded)
        for m in np.unique(length).tolist():
            mine = np.flatnonzero(length == m)
            keys, tried = self.keys(embedded, mine, m), set()
            for row, (known, items) in zip(keys.T, self.table[m]):
                place = np.minimum(np.searchsorted(known, row), len(known) - 1)
                for w in np.flatnonzero(known[place] == row).tolist():
                    tried.update((w, k) for k in items[int(row[w])])
            by_item: dict[tuple[int, int], list[int]] = {}
            for w, k in tried:
                by_item.setdefault((int(doc[mine[w]]), k), []).append(w)
            for (d, k), windows in by_item.items():
                best = self.edits(m) + 1
                rank = (padded[mine[windows], :m] != self.coded[k]).sum(axis=1)
                for _, w in sorted(zip(rank.tolist(), windows)):
                    if best == 0:
                        break
                    at = start[mine[w]]
                    distance = prefix_distance(flat[at : min(at + m + self.edits(m), ends[d])], self.coded[k], best - 1)
                    best = best if distance is None else distance
                if best <= self.edits(m):
                    found[d][self.ids[k]] = min(best, found[d].get(self.ids[k], best))


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def prefix_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Least edits between b and a beginning of a, None if more than `most`; only the diagonal band is filled."""
    a, b = a.tolist(), b.tolist()
    above = list(range(len(b) + 1))
    best = above[-1]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(low, high + 1):
            # an unknown word (1) equals nothing of an item
            row[j] = min(above[j - 1] + (x != b[j - 1]), above[j] + 1, row[j - 1] + 1)
        best = min(best, row[-1])
        if low > len(b) or min(row[low - 1 : high + 1]) > most:
            break
        above = row
    return best if best <= most else None


def _coded(index: Index, texts: list[bytes]) -> list[np.ndarray]:
    code, out = index.vocabulary.__getitem__, []
    for text in texts:
        words = text.lower().split()
        coded = np.fromiter(map(code, words), np.int64, len(words))
        out.append(coded[coded > 0])
    return out


def _found(indexes: list[Index], texts: list[bytes]) -> list[dict[int, int]]:
    """For each text, the items of all blocks that occur in it -> their smallest distance."""
    found = indexes[0].find(_coded(indexes[0], texts))
    for index in indexes[1:]:
        for mine, more in zip(found, index.find(_coded(index, texts)), strict=True):
            for item, distance in more.items():
                mine[item] = min(distance, mine.get(item, distance))
    return found


def _search(indexes: list[Index]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        for part in batches(parts, 2000):
            ids, texts = (c.to_pylist() for c in part.columns)
            found = _found(indexes, texts)
            best = [min(f.items(), key=lambda x: (x[1], x[0]), default=(None, None)) for f in found]
            yield record_batch(HITS, [ids, [sorted(f) for f in found], [b[1] for b in best], [b[0] for b in best]])

    return run


def _clean(indexes: list[Index], column: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        for part in batches(parts, 2000):
            texts = [(t or "").encode() for t in part.column(column).to_pylist()]
            yield part.filter(pa.array([not f for f in _found(indexes, texts)], pa.bool_()))

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> list[list[tuple[int, bytes]]]:
    """The query set in blocks of bounded size; a benchmark is small, and each of its blocks is read once."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.coalesce(text_col, F.lit("")).cast("binary"))
    out: list[list[tuple[int, bytes]]] = [[]]
    for r in rows.toLocalIterator():
        if len(out[-1]) == block:
            out.append([])
        out[-1].append((r[0], bytes(r[1])))
    return out


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, max_share: float, block: int) -> list[Index]:
    return [Index([i for i, _ in items], [words_of(t) for _, t in items], max_share) for items in blocks_of(benchmark, item_col, item_text_col, block)]


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_share: float = 0.2, block: int = 2000) -> DataFrame:
    """doc_id, contaminated, n_items, items (ascending ids joined by commas), item_id and distance of the closest: one row per input row."""
    found = id_and_text(docs, id_col, text_col).mapInArrow(_search(_indexes(benchmark, item_col, item_text_col, max_share, block)), HITS_DDL)
    return found.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        "item_id",
        "distance",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_share: float = 0.2, block: int = 2000) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; a filter without shuffle or join."""
    return docs.mapInArrow(_clean(_indexes(benchmark, item_col, item_text_col, max_share, block), docs.columns.index(text_col)), docs.schema)

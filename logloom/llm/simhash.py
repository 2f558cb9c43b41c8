"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint bit is set where more than half of a document's shingle hashes have it set. Equal
fingerprints are merged first, so a group of copies is one row. Distinct fingerprints meet under keys:

* for a small distance k, by the pigeonhole principle: of m > k blocks of bits, two fingerprints within k
  share m - k whole blocks, so each is sent under every choice of m - k blocks. Exact. m grows with the
  number of fingerprints, so that groups stay small.
* for a wide distance, under samples of bits, as many as the recall asks for.

Within a key the fingerprints are sorted by Gray rank and indexed in levels of `FAN` children; a node keeps
the bits its children share. The index is joined with itself from the top: a pair of nodes carries the
differences counted in the bits both share and its children count in the bits they newly share only; the pair is
dropped with all below it when the differences are too many, or when all below is one component; it is linked whole when
even its free bits cannot exceed the distance. Only a spanning forest leaves the task, never all pairs.
A key with more than `HOT` fingerprints is split into blocks that are met in pairs by separate tasks. Where that would
copy a fingerprint more often than k + 1 times, exact keys are refined instead: of k + 1 blocks of the bits that the key leaves free, two
fingerprints within k share one whole, so every fingerprint goes on under k + 1 longer keys, again and again
until no key is hot. A key with f free bits has at most 2^f distinct fingerprints, so this ends.

`keep_one` uses the fingerprints to find candidates only. Documents with the same set of shingles are merged; the
others meet under bands of min-hashes, which find a pair at the similarity asked for at any number of
documents, and a wide distance selects. Whatever candidates connect is then gathered with its texts, and only pairs
whose shingle sets reach the similarity are linked. A candidate group of too many bytes is split into blocks that are met in pairs.

Defined results: null text is empty, its fingerprint is zero and it links like any other; fewer words than
a shingle form one shingle; a row with a null id joins only equal fingerprints and has no component of
its own; repeated rows are one document; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batches, ddl, id_and_text, keep, record_batch, unused
from logloom.llm.components import components, merged, tasks_of
from logloom.llm.grid import mix, window_hash, word_hashes
from logloom.session import checkpoint

FAN = 8
HOT = 20_000
NO_ID = (1 << 63) - 1

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])
KEYED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.binary())])
REFINED = pa.schema([*KEYED, ("fixed", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SKETCHES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.binary()), ("bands", pa.binary())])

#: Bands of BAND_ROWS min-hashes: 0.9992 of the pairs at a similarity of 0.8 share one.
BANDS, BAND_ROWS = 18, 5
GROUP_BYTES = 16 << 20


def fingerprint(text: bytes, shingle: int, seeds: tuple[int, ...], step: int = 1 << 16) -> bytes:
    """Eight bytes a seed, highest bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8 * len(seeds))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()))
    out = b""
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for at in range(0, n, step):
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(joined[a:b], seed) for a, b in spans[at : at + step]], np.uint64)
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        out += np.packbits(2 * ones > n).tobytes()
    return out


def _prints(shingle: int, seeds: tuple[int, ...]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        for part in batches(parts, 500):
            ids, texts = (c.to_pylist() for c in part.columns)
            yield record_batch(PRINTS, [ids, [fingerprint(t, shingle, seeds) for t in texts]])

    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints of w 64-bit words, and the forest of links within k bits."""

    def __init__(self, prints: np.ndarray, k: int) -> None:
        n, self.k = len(prints), k
        self.order = np.lexsort([gray_rank(prints[:, c]) for c in range(prints.shape[1])][::-1])
        prints = prints[self.order]
        self.levels = [(prints, np.full_like(prints, np.iinfo(np.uint64).max))]
        self.starts = [np.arange(n + 1)]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), FAN)
            all_set, any_set = np.bitwise_and.reduceat(pattern, at, axis=0), np.bitwise_or.reduceat(pattern | ~mask, at, axis=0)
            shared = np.bitwise_and.reduceat(mask, at, axis=0) & ~(all_set ^ any_set)
            self.levels.append((all_set & shared, shared))
            self.starts.append(np.append(self.starts[-1][:-1][at], n))
        self.label = np.arange(n)

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = parent[parent]
                if (above == parent).all():
                    break
                parent = above
            self.label = parent[self.label]

    def _unite_verified(self, i: np.ndarray, j: np.ndarray, verify) -> None:
        for c in range(0, len(i), 64):
            a, b = i[c : c + 64], j[c : c + 64]
            apart = self.label[a] != self.label[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if self.label[x] != self.label[y] and verify(int(self.order[x]), int(self.order[y])):
                    self._unite(np.array([x]), np.array([y]))

    def link(self, size: int = 1 << 14, verify=None) -> np.ndarray:
        """For every fingerprint, in the order given, the place of its component's representative.

        verify: decides on two places whether fingerprints within k bits are linked.
        """
        top, one_pair = len(self.levels) - 1, np.zeros(1, np.int64)
        # with every pair: the differences counted so far, and the bits in which they were counted
        stack = [(top, one_pair, one_pair, one_pair, np.zeros((1, self.levels[0][0].shape[1]), np.uint64))]
        while stack:
            level, i, j, least, counted = stack.pop()
            if len(i) > size:
                stack += [(level, *(x[c : c + size] for x in (i, j, least, counted))) for c in range(0, len(i), size)]
                continue
            (pattern, mask), start = self.levels[level], self.starts[level]
            shared = mask[i] & mask[j]
            least = least + np.bitwise_count((pattern[i] ^ pattern[j]) & shared & ~counted).sum(axis=1, dtype=np.int64)
            near = least <= self.k
            i, j, least, shared = i[near], j[near], least[near], shared[near]
            if not level:
                self._unite(i, j) if verify is None else self._unite_verified(i, j, verify)
                continue
            low, high = np.minimum.reduceat(self.label, start[:-1]), np.maximum.reduceat(self.label, start[:-1])
            one = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
            whole = np.zeros_like(one) if verify else ~one & (least + np.bitwise_count(~shared).sum(axis=1, dtype=np.int64) <= self.k)
            for a, b in zip(i[whole], j[whole]):
                below = np.concatenate((np.arange(start[a], start[a + 1]), np.arange(start[b], start[b + 1])))
                self._unite(np.full(len(below), start[a]), below)
            left = ~one & ~whole
            i, j, least, shared = i[left], j[left], least[left], shared[left]
            if len(i):
                child = np.arange(FAN)
                below = len(self.levels[level - 1][0])
                x = (i[:, None] * FAN + child)[:, :, None].repeat(FAN, 2).reshape(-1)
                y = (j[:, None] * FAN + child)[:, None, :].repeat(FAN, 1).reshape(-1)
                good = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
                above = np.flatnonzero(good) // (FAN * FAN)
                stack.append((level - 1, x[good], y[good], least[above], shared[above]))
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.order[self.label]
        return out


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), ">u8").reshape(len(prints), -1).astype(np.uint64)


def forest(ids: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from members of a component to its smallest id."""
    root = GrayIndex(prints, k).link()
    least = np.full(len(ids), NO_ID)
    np.minimum.at(least, root, ids)
    low = least[root]
    moved = low != ids
    return ids[moved], low[moved]


def _small_groups(key: np.ndarray, ids: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many groups of two or three fingerprints at once; key is sorted."""
    a, b = [], []
    for gap in (1, 2):
        same = np.flatnonzero(key[gap:] == key[:-gap])
        near = np.bitwise_count(prints[same] ^ prints[same + gap]).sum(axis=1, dtype=np.int64) <= k
        a.append(ids[same[near]])
        b.append(ids[same[near] + gap])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.maximum(a, b), np.minimum(a, b)


def _link(k: int, buffered: int = 40_000):
    def groups(key, ids, prints):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        little = np.repeat(size <= 3, size)
        found = [_small_groups(key[little], ids[little], prints[little], k)] if little.any() else []
        found += [forest(ids[f : f + s], prints[f : f + s], k) for f, s in zip(first[size > 3], size[size > 3])]
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            both = np.unique(np.stack((a, b)), axis=1)
            yield record_batch(EDGES, [both[0], both[1]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        held: list[tuple] = []
        n = 0
        for part in batches(parts, 10_000):
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _words(part.column(2).to_pylist())))
            n += part.num_rows
            if n >= buffered:
                key, ids, prints = (np.concatenate(x) for x in zip(*held))
                done = int(np.searchsorted(key, key[-1]))
                if done:
                    yield from groups(key[:done], ids[:done], prints[:done])
                held, n = [(key[done:], ids[done:], prints[done:])], len(key) - done
        if n:
            yield from groups(*(np.concatenate(x) for x in zip(*held)))

    return run


def block_masks(n_prints: int, k: int) -> list[int]:
    """Masks of the bits that make a key, so that fingerprints within k bits share one; groups of some thousands at most if even."""
    m = k + 1
    while n_prints >> (64 * (m - k) // m) > 2000 and comb(m + 1, m + 1 - k) <= 100:
        m += 1
    edge = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(blocks, m - k)]


def sample_masks(words: int, tables: int, n_bits: int) -> list[list[int]]:
    """Places of the sampled bits of each table, from a fixed seed."""
    rng = np.random.default_rng(7)
    return [sorted(rng.choice(64 * words, n_bits, replace=False).tolist()) for _ in range(tables)]


def tables_for(n_prints: int, agree: float, recall: float = 0.99) -> tuple[int, int]:
    """(tables, bits a table) that bring two fingerprints with a share `agree` of equal bits together with this recall."""
    n_bits = min(24, max(8, n_prints.bit_length() - 3))
    return ceil(log(1 - recall) / log(1 - agree**n_bits)), n_bits


def _mixed(key: np.ndarray) -> np.ndarray:
    key = key * np.uint64(0xD1342543DE82EF95)
    return (key ^ key >> np.uint64(32)).view(np.int64)


def _keyed(masks: list):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        for part in batches(parts, 5000):
            prints = _words(part.column(0).to_pylist())
            for t, mask in enumerate(masks):
                fixed = 0
                if isinstance(mask, int):
                    key, fixed = prints[:, 0] & np.uint64(mask), mask
                else:
                    key = np.zeros(len(prints), np.uint64)
                    for place in mask:
                        key = key << np.uint64(1) | (prints[:, place // 64] >> np.uint64(place % 64)) & np.uint64(1)
                key = _mixed(key ^ np.uint64(t * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                yield record_batch(REFINED, [key, part.column(1), part.column(0), np.full(len(key), fixed, np.uint64).view(np.int64)])

    return run


def free_blocks(fixed: int, k: int) -> list[int]:
    """The bits that are not in fixed, as k + 1 masks of neighbouring ones."""
    free = [b for b in range(64) if not fixed >> b & 1]
    edge = [len(free) * i // (k + 1) for i in range(k + 2)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(edge, edge[1:])]


def _refine(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        for part in batches(parts, 5000):
            key, fixed = (part.column(c).to_numpy().view(np.uint64) for c in (0, 3))
            prints = _words(part.column(2).to_pylist())[:, 0]
            for mask in np.unique(fixed):
                at = np.flatnonzero(fixed == mask)
                rows = part.take(pa.array(at))
                for t, block in enumerate(free_blocks(int(mask), k), 1):
                    # the key stands for all bits but those of the block
                    longer = mix(key[at] + np.uint64(t)) ^ (prints[at] & np.uint64(block))
                    both = np.full(len(at), int(mask) | block, np.uint64)
                    yield record_batch(REFINED, [_mixed(longer), rows.column(1), rows.column(2), both.view(np.int64)])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, fp) for every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_prints(shingle, seeds), ddl(PRINTS))


def _meets(own, parts, key: str):
    """Keys of the tasks of block `own` of a key in so many parts: block i meets block j in the task (i, j), i <= j."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.xxhash64(key, F.least(own, o), F.greatest(own, o))))


def _edges(keyed: DataFrame, k: int, exact: bool = False, tasks: int | None = None) -> DataFrame:
    """Links within k bits of the fingerprints that share a key.

    exact: keys stand for the bits in `fixed`, so those that pairs of blocks would copy more often than k + 1 times are refined.
    tasks: at most so many write the checkpoint of the hot keys.
    """
    while True:
        hot = checkpoint(merged(keyed.groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > HOT), tasks))
        more = hot.where(F.col("n") > HOT * (k + 1))
        if not exact or more.isEmpty():
            break
        marked = keyed.join(more, F.col("key") == F.col("hot"), "left")
        longer = marked.where("hot is not null").select("key", "id", "fp", "fixed").mapInArrow(_refine(k), ddl(REFINED))
        keyed = checkpoint(marked.where("hot is null").select("key", "id", "fp", "fixed").unionByName(longer))
    keyed = keyed.select("key", "id", "fp")
    if not hot.isEmpty():
        parts = F.ceil(F.col("n") / HOT).cast("int")
        meets = _meets(F.pmod(F.xxhash64("fp"), parts).cast("int"), parts, "key")
        keyed = keyed.join(hot, F.col("key") == F.col("hot"), "left").select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(meets)).alias("key"), "id", "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link(k), ddl(EDGES))


def near_components(prints: DataFrame, k: int = 4, agree: float | None = None) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of (doc_id, fp): the smallest doc_id reachable by links of at most k bits.

    agree=None uses the exact block keys (fingerprints of 64 bits); otherwise tables of sampled bits that find
    pairs with at least that share of equal bits.
    """
    distinct = checkpoint(merged(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id")), tasks_of(prints.count())))
    n = distinct.count()
    words = (distinct.agg(F.max(F.length("fp")).alias("n")).first()["n"] or 8) // 8
    masks = block_masks(n, k) if agree is None else sample_masks(words, *tables_for(n, agree))
    keyed = distinct.where(F.col("id") != NO_ID).select("fp", "id").mapInArrow(_keyed(masks), ddl(REFINED))
    # 2^(k + 1) below HOT * (k + 1): a key with so many fingerprints leaves more than k bits free
    tasks = tasks_of(n * len(masks))
    edges = _edges(keyed, k, agree is None and 1 << (k + 1) <= HOT * (k + 1), tasks)
    linked = components(edges, tasks)
    return distinct.join(linked, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, k: int = 4, seeds: tuple[int, ...] = (42,), agree: float | None = None) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: one row per input row."""
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, seeds))
    near = near_components(prints, k, agree)
    rows = prints.join(near, "fp", "left").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))
    return merged(rows, tasks_of(prints.count()))


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct shingles as ascending 64-bit hashes."""
    words = word_hashes(text.lower().split())
    return np.unique(window_hash(words, min(shingle, len(words)), 0x9E3779B97F4A7C15)) if len(words) else words


def set_print(hashes: np.ndarray, step: int = 1 << 14) -> bytes:
    """256-bit fingerprint of a set of shingles."""
    out = b""
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), step):
            bits = np.unpackbits(mix(hashes[at : at + step] ^ np.uint64(seed)).view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.uint32)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def _band_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    flips, factors = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
    return flips, factors | np.uint64(1)


FLIPS, FACTORS = _band_factors()


def band_keys(hashes: np.ndarray, step: int = 1 << 12) -> np.ndarray:
    """A key a band of min-hashes; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[at : at + step] ^ FLIPS) * FACTORS).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def _sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep("nothing")
    for part in batches(parts, 500):
        ids, texts = (c.to_pylist() for c in part.columns)
        sets = [shingle_set(t) for t in texts]
        yield record_batch(SKETCHES, [ids, [xxhash.xxh128_digest(s.tobytes()) for s in sets], [set_print(s) for s in sets], [band_keys(s).tobytes() for s in sets]])


def _banded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, 2000):
        ids, prints, bands = (c.to_pylist() for c in part.columns)
        keys = [np.frombuffer(b, np.int64) for b in bands]
        sizes = [len(k) for k in keys]
        row = np.repeat(np.arange(len(ids)), sizes)
        if len(row):
            yield record_batch(KEYED, [np.concatenate(keys), np.array(ids)[row], pa.array(prints, pa.binary()).take(pa.array(row))])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Jaccard similarity of two ascending sets is at least `similarity`."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = np.intersect1d(a, b, assume_unique=True).size
    return common >= similarity * (len(a) + len(b) - common)


def verified_forest(ids: np.ndarray, sets: list[np.ndarray], k: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group that are within k bits and reach the similarity."""
    if len(ids) == 2:
        return (ids[:1], ids[1:]) if alike(*sets, similarity) else (ids[:0], ids[:0])
    index = GrayIndex(_words([set_print(s) for s in sets]), k)
    root = index.link(verify=lambda x, y: alike(sets[x], sets[y], similarity))
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _verify(k: int, similarity: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        group, ids, sets = None, [], []

        def links():
            if len(ids) > 1:
                a, b = verified_forest(np.array(ids), sets, k, similarity)
                if len(a):
                    yield record_batch(EDGES, [a, b])

        for part in batches(parts, 500):
            for g, i, t in zip(*(c.to_pylist() for c in part.columns)):
                if g != group:
                    yield from links()
                    group, ids, sets = g, [], []
                ids.append(i)
                sets.append(shingle_set(t))
        yield from links()

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those that links of near copies lead to a row with a smaller id.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least
    `similarity`. At a similarity s two fingerprint bits differ with probability at most
    arccos(2s / (1 + s)) / pi; candidates lie within three deviations above that distance.
    Rows with a null id stay. Rows that share an id are one document: they go or stay together.
    """
    differ = acos(2 * similarity / (1 + similarity)) / pi
    k = int(256 * differ + 3 * sqrt(256 * differ * (1 - differ)))
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    sketches = checkpoint(texts.mapInArrow(_sketch, ddl(SKETCHES)))
    distinct = checkpoint(sketches.groupBy("digest", "fp", "bands").agg(F.min("doc_id").alias("id")))
    near = components(_edges(distinct.select("id", "fp", "bands").mapInArrow(_banded, ddl(KEYED)), k))
    # one text a document of every group of candidates
    grouped = checkpoint(texts.join(near, F.col("doc_id") == F.col("node")).select(F.col("component").alias("key"), "doc_id", "t"))
    large = grouped.groupBy("key").agg(F.sum(F.octet_length("t")).alias("n")).where(F.col("n") > GROUP_BYTES)
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / (GROUP_BYTES // 2)).cast("int")
        meets = _meets(F.pmod(F.xxhash64("doc_id"), parts).cast("int"), parts, "key")
        grouped = grouped.join(large, "key", "left").select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(meets)).alias("key"), "doc_id", "t")
    linked = components(grouped.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(k, similarity), ddl(EDGES)))
    least = distinct.join(linked, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("least"))
    gone_id = unused(docs, "__gone_id")
    gone = sketches.join(least, "digest").where("least < doc_id").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")

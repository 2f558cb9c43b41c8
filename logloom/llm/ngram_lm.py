"""Language-model scoring with an Elias-Fano n-gram trie.

Counts of all n-grams of the training documents are gathered by the packed exchange (grid.py): an n-gram is
identified by the leading bytes of a hash of all its words, as many as the size of the corpus asks for, so
that an unseen one meets a seen one with a chance of at most 2^-SPARE_BITS; words travel as whole hashes
with exact counts, counts of longer n-grams as two-byte codes (exact below 2^15, then within 0.05 %).

A chunk of documents then builds the part of the model that it asks for as a trie. Level n holds the seen
n-grams, ordered by the rank of their context in level n - 1 and by word: a monotone Elias-Fano sequence of
successors, the pointers to a context's first successor, also monotone, and two quantised values an
n-gram: its smoothed log probability and, as a context, the share it leaves to shorter contexts. Levels lie
in an anonymous memory map. A query searches a word among the successors of its context's rank only, and an
n-gram that is not found backs off.

Probabilities are interpolated with Dirichlet priors: P(w | context) = (c + m * P(w | shorter context)) /
(C + m), which sums to one over the vocabulary; the unigram is add-one over the known tokens and one unknown.
The strength m of an order is the one under which the model expects as many new continuations, one
occurrence left out at a time, as there are n-grams that occur once; it is fitted on the counts of all n-grams
of the training documents, of which only how often each count occurs is gathered. Log probabilities are
quantised with an error below 2.5e-4.

Defined results: null text is empty and scores its end token alone; rows with a null id hash as an empty
id; with no training rows every token has the add-one probability of an empty count; repeated rows count
and are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import mmap
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ddl, record_batch
from logloom.llm.grid import cuts, grid, mix, pack_numbers, pack_sorted, texts_of, unpack_numbers, unpack_sorted, word_hashes

#: A space never occurs in a word, so these never equal a word's hash input.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(s)) for s in (b" end", b" begin"))
SPARE_BITS = 13
#: Log10 probabilities from -16 to 0 have two-byte codes, finer towards 0 as the squares of the codes are.
LEAST, MOST_CODE = -16.0, 65535

COUNTS = pa.schema([("cell", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int32()), ("cell", pa.int32()), ("n", pa.int32()), ("codes", pa.binary())])
USES = pa.schema([("order", pa.int32()), ("count", pa.int64()), ("uses", pa.int64())])
FITTED = "tokens long, distinct long, strengths array<double>"
SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    order: int = 3
    modulus: int = 7
    held_out: int = 2
    n_uni: int = 1
    n_more: int = 1
    key_bytes: int = 6

    def cell(self, n: int) -> int:
        """First cell of order n: cells are numbered by order, then bucket."""
        return 0 if n == 1 else self.n_uni + (n - 2) * self.n_more

    def buckets(self, n: int) -> int:
        return self.n_uni if n == 1 else self.n_more

    def order_of(self, cell: int) -> int:
        return 1 if cell < self.n_uni else 2 + (cell - self.n_uni) // self.n_more

    def size(self, n: int) -> int:
        """Bytes of a key."""
        return 8 if n == 1 else self.key_bytes


class EliasFano:
    """A non-decreasing sequence: low bytes as they are, high parts in unary with a directory of their starts."""

    WIDTHS = (np.dtype("<u1"), np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"), np.dtype("<u4"), np.dtype("<i8"))

    def __init__(self, values: np.ndarray) -> None:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        self.n, self.low_bytes = n, max(0, -(-((top // max(n, 1)).bit_length() - 1) // 8))
        values = values.astype(np.int64)
        shift = 8 * self.low_bytes
        high = values >> shift
        buckets = int(high[-1]) + 1 if n else 0
        unary = np.zeros(n + buckets, np.uint8)
        unary[high + np.arange(n)] = 1
        starts = np.zeros(buckets + 1, np.uint32)
        starts[1:] = np.cumsum(np.bincount(high, minlength=buckets)) if n else 0
        self.parts = [np.packbits(unary), starts, (values & ((1 << shift) - 1)).astype(self.WIDTHS[min(self.low_bytes, 5)])]

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i: the high part is the directory slot that holds the place."""
        high = np.searchsorted(self.parts[1], i.astype(np.uint32), side="right") - 1
        return (high << (8 * self.low_bytes)) | self.parts[2][i]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place whose value is at least x, and whether it equals x; quickest where x ascends."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        shift, starts, lows = 8 * self.low_bytes, self.parts[1], self.parts[2]
        high, want = x >> shift, x & ((1 << shift) - 1)
        last = len(starts) - 1
        inside = high < last
        high = np.where(inside, high, last - 1)
        lo, end = starts[high].astype(np.int64), starts[high + 1].astype(np.int64)
        lo[~inside], end[~inside] = self.n, self.n
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            less = lows[mid] < want[open_]
            lo[open_] = a = np.where(less, mid + 1, a)
            hi[open_] = b = np.where(less, b, mid)
            open_ = open_[a < b]
        return lo, (lo < end) & (lows[np.minimum(lo, self.n - 1)] == want)


class Level:
    """The seen n-grams of one order by (rank of the context, word)."""

    def __init__(self, successors: np.ndarray, n_contexts: int, bits: int) -> None:
        self.bits = bits
        self.pointers = EliasFano(np.searchsorted(successors >> bits, np.arange(n_contexts + 1)))
        self.successors = EliasFano(successors)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each n-gram (rank of the context << bits | word, negative for no context), -1 where it is unseen."""
        out = np.full(len(x), -1, np.int32)
        at = np.flatnonzero(x >= 0)
        x = x[at]
        # successors of other contexts have another rank in their leading bits, so the search stays inside
        place, hit = self.successors.find(x)
        at, x, place = at[hit], x[hit], place[hit]
        inside = place < self.pointers.access((x >> self.bits) + 1)
        out[at[inside]] = place[inside]
        return out


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt((log10_p / LEAST).clip(0, 1)) * MOST_CODE).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return LEAST * (codes / MOST_CODE) ** 2


class Trie:
    """Levels of successors with quantised smoothed probabilities and back-off shares.

    counts[0] are counts of the words and, last, of the begin mark as a context. grams[n - 2] are the
    n-grams in question as (index of the context, index of the n-gram without its first word, word), indexes
    being places in the list of the order below; counts[n - 1] are their counts.
    """

    def __init__(self, counts: list[np.ndarray], grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: int, distinct: int, strengths: list[float]) -> None:
        bits = int(len(counts[0])).bit_length()
        self.bits, self.levels = bits, []
        p = (counts[0] + 1.0) / (tokens + distinct + 1.0)
        rank = np.arange(len(counts[0]))
        values, shares, n_ranks = [np.log10(p)], [], len(rank)
        for n, (context, rest, word) in enumerate(grams, 2):
            m, ranked = strengths[n - 2], np.flatnonzero(rank >= 0)
            share = np.empty(n_ranks)
            share[rank[ranked]] = np.log10(m / (counts[n - 2][ranked] + m))
            shares.append(share)
            of, x = counts[n - 2][context], self._numbers(rank, context, word)
            seen = (counts[n - 1] > 0) & (of > 0) & (x >= 0)
            p = (np.where(seen, np.minimum(counts[n - 1], of), 0.0) + m * p[rest]) / (of + m)
            at = np.flatnonzero(seen)
            at = at[np.argsort(x[at])]
            x = x[at]
            # two n-grams of one key would be one successor twice
            once = np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))
            at, x = at[once], x[once]
            self.levels.append(Level(x, n_ranks, bits))
            rank, n_ranks = np.full(len(seen), -1, np.int32), len(at)
            rank[at] = np.arange(len(at))
            values.append(np.log10(p[at]))
        self.values, self.shares = [quantise(v) for v in values], [quantise(v) for v in shares]
        self._map()

    def _numbers(self, rank: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        above = rank[context].astype(np.int64)
        return np.where(above < 0, -1, (above << self.bits) | word)

    def _map(self) -> None:
        """Moves all levels into one anonymous memory map."""
        owners = [(s.parts, i) for level in self.levels for s in (level.pointers, level.successors) for i in range(3)] + [(x, i) for x in (self.values, self.shares) for i in range(len(x))]
        sizes = [-(-p[i].nbytes // 8) * 8 for p, i in owners]
        self.memory = mmap.mmap(-1, max(8, sum(sizes)))
        at = 0
        for (p, i), size in zip(owners, sizes):
            view = np.frombuffer(self.memory, p[i].dtype, p[i].size, at).reshape(p[i].shape)
            view[...] = p[i]
            p[i] = view
            at += size

    def log10(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """By order, the log10 probability of each n-gram's last word; words first, then grams as above."""
        rank = np.arange(len(self.values[0]))
        value = [dequantise(self.values[0])]
        for n, (context, rest, word) in enumerate(grams, 2):
            x, above = self._numbers(rank, context, word), rank[context]
            # asked in ascending order, neighbours in the levels are read together
            order = np.argsort(x)
            rank = np.empty(len(x), np.int32)
            rank[order] = self.levels[n - 2].find(x[order])
            found = value[-1][rest]
            known = np.flatnonzero(above >= 0)
            found[known] += dequantise(self.shares[n - 2][above[known]])
            known = np.flatnonzero(rank >= 0)
            found[known] = dequantise(self.values[n - 1][rank[known]])
            value.append(found)
        return value


#: Counts below EXACT are their own codes; above, codes are steps of 0.1 %.
EXACT = 1 << 15


def encode_counts(counts: np.ndarray) -> np.ndarray:
    more = np.round(np.log(np.maximum(counts, EXACT) / EXACT) * 1000)
    return np.where(counts < EXACT, counts, EXACT + more).clip(0, 65535).astype(np.uint16)


def decode_counts(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes < EXACT, codes, EXACT * np.exp((codes - EXACT) / 1000))


def gram_keys(tokens: np.ndarray, before: list[np.ndarray], key_bytes: int) -> np.ndarray:
    """Keys of n-grams: the leading bytes of a hash of all words, evenly spread whatever the words."""
    key = np.zeros(len(tokens), np.uint64)
    for word in (*before, tokens):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
    free = np.uint64(64 - 8 * key_bytes)
    return (key >> free) << free


class Grams:
    """The distinct n-grams of a chunk by bucket and key; `at` are the tokens that end one, `where` their places among them.

    A context holds one begin mark at most: the first token has no n-grams above two words, and so on.
    """

    def __init__(self, chunk: "Tokens", n: int, model: Model) -> None:
        self.at = np.flatnonzero(chunk.place >= n - 2) if n > 2 else np.arange(len(chunk.tokens))
        keys = chunk.tokens if n == 1 else gram_keys(chunk.tokens[self.at], [chunk.back(j)[self.at] for j in range(n - 1, 0, -1)], model.key_bytes)
        self.at = self.at.astype(np.int32)
        self.keys, where = np.unique(keys, return_inverse=True)
        self.where = where.astype(np.int32)
        self.edge = cuts(self.keys, model.buckets(n))

    def counts(self, train: np.ndarray) -> np.ndarray:
        return np.bincount(self.where, train[self.at], len(self.keys)).astype(np.int64)


class Tokens:
    """Token hashes of a chunk's documents, each closed by an end token."""

    def __init__(self, table: pa.Table, model: Model) -> None:
        each = [np.append(word_hashes(t.lower().split()), END) for t in texts_of(table)]
        self.ids = table.column("doc_id").to_pylist()
        self.sizes = np.array([len(e) for e in each], np.int64)
        self.tokens = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        trains = [zlib.crc32(b"" if i is None else str(i).encode()) % model.modulus != model.held_out for i in self.ids]
        self.train = np.repeat(np.array(trains, bool), self.sizes)

    def back(self, j: int) -> np.ndarray:
        """The token j places before, a begin mark before the document's first."""
        out = np.full(len(self.tokens), BEGIN)
        out[j:] = np.where(self.place[j:] >= j, self.tokens[: len(self.tokens) - j], BEGIN)
        return out


def _count(model: Model):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk, rows = Tokens(table, model), []
        for n in range(1, model.order + 1):
            grams = Grams(chunk, n, model)
            counts = grams.counts(chunk.train)
            for b in np.flatnonzero(np.diff(grams.edge)).tolist():
                i, j = grams.edge[b], grams.edge[b + 1]
                rows.append((model.cell(n) + b, key[0].as_py(), j - i, pack_sorted(grams.keys[i:j], model.size(n)), pack_numbers(counts[i:j])))
        return pa.Table.from_batches([record_batch(COUNTS, list(zip(*rows)))] if rows else [], COUNTS)

    return run


def _pack_codes(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def _unpack_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, -1).T).view("<u2").reshape(-1)


def _summed(model: Model, cell: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a cell, their counts over all chunks, and each sent key's place among them."""
    size = model.size(model.order_of(cell))
    keys = np.concatenate([unpack_sorted(k.as_py(), size) for k in table.column("keys")])
    counts = np.concatenate([unpack_numbers(c.as_py()) for c in table.column("counts")]).astype(np.int64)
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, counts, len(distinct)).astype(np.int64), where


def _answer(model: Model):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        _, total, where = _summed(model, cell, table)
        pack, found = (pack_numbers, total[where]) if model.order_of(cell) == 1 else (_pack_codes, encode_counts(total)[where])
        edge = np.concatenate(([0], np.cumsum(table.column("n").to_numpy())))
        return pa.table([table.column("chunk"), table.column("cell"), table.column("n"), pa.array([pack(found[i:j]) for i, j in zip(edge, edge[1:])], pa.binary())], schema=ANSWERS)

    return run


def _uses(model: Model):
    """How many n-grams of a cell have each count; the end token is nobody's context and has an order of its own, 0."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        n = model.order_of(cell)
        size = model.size(n)
        keys = np.concatenate([unpack_sorted(k.as_py(), size) for k in table.column("keys")])
        counts = np.concatenate([unpack_numbers(c.as_py()) for c in table.column("counts")]).astype(np.int64)
        keys, counts = keys[counts > 0], counts[counts > 0]
        by_key = np.argsort(keys)
        keys = keys[by_key]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        total = np.add.reduceat(counts[by_key], first) if len(first) else counts
        end = (keys[first] == END) & (n == 1)
        rows = [np.unique(total[~end], return_counts=True), (total[end], np.ones(end.sum(), np.int64))]
        orders = np.repeat([n, 0], [len(c) for c, _ in rows])
        return pa.Table.from_batches([record_batch(USES, [orders, *map(np.concatenate, zip(*rows))])], USES)

    return run


def strength(contexts: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray]) -> float:
    """The prior's strength: (counts, how many n-grams have them) of contexts and of the n-grams themselves."""
    (c, uses), (own, own_uses) = contexts, grams
    if not len(c) or not len(own):
        return 1.0
    once = own_uses[own == 1].sum() / (own * own_uses).sum()
    low, high = -7.0, 14.0
    for _ in range(60):
        m = np.exp((low + high) / 2)
        expected = (uses * c * m / (c - 1 + m)).sum() / (uses * c).sum()
        low, high = ((low + high) / 2, high) if expected < once else (low, (low + high) / 2)
    return float(np.exp((low + high) / 2))


def _fit(order: int):
    def run(parts):
        for part in parts:
            for r in part.column(0):
                # in order, so that sums of floats come out the same in every run
                orders, counts, uses = np.array(sorted(zip(*(x.to_pylist() for x in r.values.flatten()))), np.int64).reshape(-1, 3).T
                of = [(counts[orders == n], uses[orders == n]) for n in range(order + 1)]
                tokens, distinct = (int(sum(x.sum() for x in found)) for found in ([c * u for c, u in of[:2]], [u for _, u in of[:2]]))
                strengths = [strength(of[n - 1], of[n]) for n in range(2, order + 1)]
                yield pa.record_batch([pa.array([tokens], pa.int64()), pa.array([distinct], pa.int64()), pa.array([strengths], pa.list_(pa.float64()))], names=["tokens", "distinct", "strengths"])

    return run


def _score(model: Model):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return SCORES.empty_table()
        chunk = Tokens(table, model)
        cells = answers.column("cell").to_numpy()
        n_train, n_distinct, strengths = (answers.column(c)[0].as_py() for c in ("tokens", "distinct", "strengths"))
        codes = answers.column("codes")
        order = np.argsort(cells, kind="stable")
        of_order = np.searchsorted(cells[order], [model.cell(n) for n in range(1, model.order + 2)])
        counts, grams, places = [], [], []
        for n in range(1, model.order + 1):
            mine = order[of_order[n - 1] : of_order[n]].tolist()
            g = Grams(chunk, n, model)
            if n == 1:
                found = np.concatenate([unpack_numbers(codes[i].as_py()) for i in mine]).astype(np.float64)
                end = found[np.searchsorted(g.keys, END)]
                # the begin mark, last of the words, is the context of as many tokens as there are ends
                counts.append(np.append(found, end))
                word = below = g.where
            else:
                counts.append(decode_counts(np.concatenate([_unpack_codes(codes[i].as_py()) for i in mine])) if mine else np.zeros(0))
                last = np.zeros(len(g.keys), np.int32)
                last[g.where] = g.at
                context = np.where(chunk.place[last] > 0, below[last - 1], len(counts[0]) - 1) if n == 2 else below[last - 1]
                grams.append((context, below[last], word[last]))
                below = np.full(len(chunk.tokens), -1, np.int32)
                below[g.at] = g.where
            places.append((g.at, g.where))
        values = Trie(counts, grams, n_train, n_distinct, strengths).log10(grams)
        log10_p = np.empty(len(chunk.tokens))
        for (at, where), value in zip(places, values):
            log10_p[at] = value[where]
        known = counts[0][word]
        base = np.log10((known + 1.0) / (n_train + n_distinct + 1.0))
        first = np.cumsum(chunk.sizes) - chunk.sizes
        sums = [np.add.reduceat(v, first) for v in ((known > 0).astype(np.int64), base, log10_p)]
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes, pa.int64()), pa.array(sums[0], pa.int64()), pa.array([n_train] * len(chunk.ids), pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())], schema=SCORES)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strengths: tuple[float, ...] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    strengths, of the orders from two on, are fitted unless given.
    """
    g = grid(docs, id_col, text_col)
    model = Model(order=order, n_uni=g.buckets(0.2), n_more=g.buckets(0.8), key_bytes=g.key_bytes(SPARE_BITS))
    texts = g.texts.groupBy("chunk")
    counted = texts.applyInArrow(_count(model), ddl(COUNTS)).groupBy("cell")
    uses = counted.applyInArrow(_uses(model), ddl(USES)).groupBy("order", "count").agg(F.sum("uses").alias("uses"))
    # one row; no more counts differ than the square root of twice the tokens, an order
    fitted = uses.agg(F.collect_list(F.struct("order", "count", "uses"))).mapInArrow(_fit(order), FITTED)
    if strengths is not None:
        fitted = fitted.withColumn("strengths", F.array(*[F.lit(float(m)) for m in strengths]))
    answers = counted.applyInArrow(_answer(model), ddl(ANSWERS)).crossJoin(F.broadcast(fitted))
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(_score(model), ddl(SCORES))

"""Substring dedup by fixed-block anchors.

A window is `window` consecutive words. Reference blocks are the non-overlapping runs of
b = (window + 1) // 2 words of every document, so every window holds a whole block. All blocks are
indexed, every rolling run of b words of every document probes the index, and a run is an anchor if it is
some document's block and also occurs in another document. Only windows that touch an anchor can repeat;
hits are extended to the whole window, compared by 128-bit fingerprints of the word sequence (of which
a chunk gets 96 bits back), and a window is removed where it starts in a document with a smaller id. Neighbouring removed windows merge into
maximal repeats. Both comparisons use the packed exchange (grid.py): no row per window is shuffled and no
pairs of documents are formed, so a passage in thousands of documents costs one key per chunk.

Defined results: null text has no words; documents shorter than a window lose nothing; windows are judged
on the input; repeated rows share an id and do not remove each other; a null id counts as the largest,
as does 2^63 - 1;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import ddl, record_batch
from logloom.llm.grid import NO_ID, bits, cuts, from_bits, from_planes, grid, ids_of, mix, pack_numbers, pack_sorted, planes, sha256_hex, texts_of, unpack_numbers, unpack_sorted, window_hash, word_hashes

PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("block", pa.binary()), ("twice", pa.binary())])
ANCHORS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("hit", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])
REPEATS = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("second", pa.binary()), ("all", pa.binary()), ("n", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

#: Odd multipliers of the rolling hashes.
BLOCK, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5


@dataclass(frozen=True)
class Shape:
    window: int
    block: int
    key_bytes: int
    n_probe: int
    n_window: int


@dataclass
class Words:
    """Word hashes of a chunk's documents one after the other."""

    ids: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Words:
        each = [word_hashes(t.split()) for t in texts_of(table)]
        sizes = np.array([len(e) for e in each], np.int64)
        doc = np.repeat(np.arange(len(each), dtype=np.int32), sizes)
        place = np.arange(len(doc), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Words(ids_of(table), np.concatenate(each) if each else np.zeros(0, np.uint64), doc, place)

    def starts(self, size: int) -> np.ndarray:
        """True where a run of so many words stays in one document."""
        n = max(0, len(self.doc) - size + 1)
        return self.doc[:n] == self.doc[size - 1 : size - 1 + n]


def _of(column: str, table: pa.Table, i: int):
    return table.column(column)[i].as_py()


def _probe(shape: Shape):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        words = Words.of(table)
        at = np.flatnonzero(words.starts(shape.block))
        hashes = window_hash(words.hashes, shape.block, BLOCK)[at]
        keys, where = np.unique(hashes >> np.uint64(64 - 8 * shape.key_bytes), return_inverse=True)
        keys <<= np.uint64(64 - 8 * shape.key_bytes)
        is_block = np.zeros(len(keys), bool)
        is_block[where[words.place[at] % shape.block == 0]] = True
        ids = words.ids[words.doc[at]]
        least, most = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, where, ids)
        np.maximum.at(most, where, ids)
        twice = least < most
        edge = cuts(keys, shape.n_probe)
        rows = [(b, key[0].as_py(), j - i, pack_sorted(keys[i:j], shape.key_bytes), bits(is_block[i:j]), bits(twice[i:j])) for b, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
        return pa.Table.from_batches([record_batch(PROBES, list(zip(*rows)))] if rows else [], PROBES)

    return run


def _anchors(shape: Shape):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        keys = np.concatenate([unpack_sorted(k.as_py(), shape.key_bytes) for k in table.column("keys")])
        flag = {c: np.concatenate([from_bits(v.as_py(), n) for v, n in zip(table.column(c), sizes)]) for c in ("block", "twice")}
        rank = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[rank][1:] != keys[rank][:-1]))
        at = np.flatnonzero(new)
        several = (np.diff(np.append(at, len(keys))) > 1) | np.logical_or.reduceat(flag["twice"][rank], at)
        hit = several & np.logical_or.reduceat(flag["block"][rank], at)
        out = np.empty(len(keys), bool)
        out[rank] = hit[np.cumsum(new) - 1]
        edge = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table([table.column("chunk"), table.column("bucket"), table.column("n"), pa.array([bits(out[i:j]) for i, j in zip(edge, edge[1:])], pa.binary())], schema=ANCHORS)

    return run


def _windows(shape: Shape):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return WINDOWS.empty_table()
        words = Words.of(table)
        at = np.flatnonzero(words.starts(shape.block))
        hashes = window_hash(words.hashes, shape.block, BLOCK)[at]
        _, where = np.unique(hashes >> np.uint64(64 - 8 * shape.key_bytes), return_inverse=True)
        rows = sorted((answers.column("bucket")[i].as_py(), i) for i in range(len(answers)))
        hit = np.concatenate([from_bits(_of("hit", answers, i), _of("n", answers, i)) for _, i in rows])
        anchor = np.zeros(len(words.doc) + 1, np.int64)
        anchor[at + 1] = hit[where]
        seen = np.cumsum(anchor)
        start = words.starts(shape.window)
        runs = shape.window - shape.block + 1
        n = len(start)
        start &= seen[runs : runs + n] > seen[:n]
        at = np.flatnonzero(start)
        if not len(at):
            return WINDOWS.empty_table()
        first, second = (window_hash(words.hashes, shape.window, f)[at] for f in (FIRST, SECOND))
        ids = words.ids[words.doc[at]]
        rank = np.lexsort((ids, second, first))
        first, second, ids = first[rank], second[rank], ids[rank]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        lead = np.flatnonzero(new)
        most = np.maximum.reduceat(ids, lead)
        first, second, least = first[lead], second[lead], ids[lead]
        # several: a larger id than the smallest one is here too
        several = most > least
        edge = cuts(first, shape.n_window)
        rows = [(b, key[0].as_py(), j - i, pack_sorted(first[i:j], 8), planes(second[i:j], 8), pack_numbers(least[i:j]), bits(several[i:j])) for b, (i, j) in enumerate(zip(edge, edge[1:])) if j > i]
        return pa.Table.from_batches([record_batch(WINDOWS, list(zip(*rows)))], WINDOWS)

    return run


def _repeats(key: tuple, table: pa.Table) -> pa.Table:
    sizes = table.column("n").to_numpy()
    reader = {"first": lambda v: unpack_sorted(v, 8), "second": lambda v: from_planes(v, 8), "least": unpack_numbers}
    first, second, least = (np.concatenate([read(v.as_py()) for v in table.column(c)]) for c, read in reader.items())
    here = least.astype(np.int64)
    local = np.concatenate([from_bits(v.as_py(), n) for v, n in zip(table.column("several"), sizes)])
    rank = np.lexsort((second, first))
    a, b = first[rank], second[rank]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    lowest = np.minimum.reduceat(here[rank], np.flatnonzero(new))
    out = np.empty(len(here), np.int64)
    out[rank] = lowest[np.cumsum(new) - 1]
    all_here = out < here
    edge = np.concatenate(([0], np.cumsum(sizes)))
    rows = []
    for r, (i, j) in enumerate(zip(edge, edge[1:])):
        found = np.flatnonzero(all_here[i:j] | local[i:j]) + i
        if len(found):
            rows.append((_of("chunk", table, r), pack_sorted(first[found], 8), planes(second[found], 4), bits(all_here[found]), len(found)))
    return pa.Table.from_batches([record_batch(REPEATS, list(zip(*rows)))] if rows else [], REPEATS)


def _cut(shape: Shape):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words.of(table)
        n = len(words.doc)
        covered = np.zeros(n + 1, np.int64)
        if len(answers):
            keys = np.concatenate([unpack_sorted(v.as_py(), 8) for v in answers.column("keys")])
            other = np.concatenate([from_planes(v.as_py(), 4) for v in answers.column("second")])
            every = np.concatenate([from_bits(_of("all", answers, i), _of("n", answers, i)) for i in range(len(answers))])
            rank = np.lexsort((other, keys))
            keys, other, every = keys[rank], other[rank], every[rank]
            at = np.flatnonzero(words.starts(shape.window))
            first = window_hash(words.hashes, shape.window, FIRST)[at]
            found = np.searchsorted(keys, first)
            near = found < len(keys)
            near[near] = keys[found[near]] == first[near]
            at, found, first = at[near], found[near], first[near]
            second = _hashes_at(words.hashes, at, shape.window, SECOND) >> np.uint64(32) << np.uint64(32)
            # keys that agree in their first half lie side by side
            while (later := (keys[np.minimum(found, len(keys) - 1)] == first) & (found < len(keys)) & (other[np.minimum(found, len(keys) - 1)] < second)).any():
                found = found + later
            same = found < len(keys)
            same[same] = (keys[found[same]] == first[same]) & (other[found[same]] == second[same])
            at, found = at[same], found[same]
            ids = words.ids[words.doc[at]]
            least = np.full(len(keys), NO_ID)
            np.minimum.at(least, found, ids)
            gone = at[every[found] | (ids > least[found])]
            np.add.at(covered, gone, 1)
            np.add.at(covered, np.minimum(gone + shape.window, n), -1)
        keep = np.cumsum(covered)[:n] == 0
        rows, at = [], 0
        ids = table.column("doc_id")
        for i, text in enumerate(texts_of(table)):
            w = text.split()
            here = keep[at : at + len(w)]
            kept = w if here.all() else [w[k] for k in np.flatnonzero(here)]
            rows.append((ids[i].as_py(), len(w), len(w) - len(kept), sha256_hex(b" ".join(kept))))
            at += len(w)
        return _rows(rows)

    return run


def _hashes_at(words: np.ndarray, at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """window_hash of the windows that start there."""
    acc = np.zeros(len(at), np.uint64)
    for j in range(size):
        acc = acc * np.uint64(factor) + words[at + j]
    return mix(acc)


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space): one row per input row."""
    g = grid(docs, id_col, text_col)
    shape = Shape(window, (window + 1) // 2, g.key_bytes(), g.buckets(), g.buckets(0.5))
    texts = g.texts.groupBy("chunk")
    probes = texts.applyInArrow(_probe(shape), ddl(PROBES))
    anchors = probes.groupBy("bucket").applyInArrow(_anchors(shape), ddl(ANCHORS))
    windows = texts.cogroup(anchors.groupBy("chunk")).applyInArrow(_windows(shape), ddl(WINDOWS))
    repeats = windows.groupBy("bucket").applyInArrow(_repeats, ddl(REPEATS))
    return texts.cogroup(repeats.groupBy("chunk")).applyInArrow(_cut(shape), ddl(RESULT))

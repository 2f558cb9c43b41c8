"""Exact dedup by Patricia-trie owners.

Rows are dealt by (length, content hash) of the normalised text. Each task inserts full byte strings into
a compressed radix trie whose terminal nodes hold the owner (most code points, then smallest id) and the
number of rows. The rows of a task come sorted by string, Spark's sorter spilling if need be, so in a
trie over its memory budget every subtree beside the path to the last string is complete: those subtrees are
released, the open path stays. Copies inside a map task are merged by the same trie before the shuffle (released over its
memory budget), so a group holding a third of all rows sends one string per task and budget. The decision returns to the rows by a join on the SHA-256,
which AQE splits where one key is hot.

Defined results: null text counts as empty; all empty texts are one group; null ids come last among
equals; repeated rows each count, and each is marked kept if its id is the kept one (`keep_first` leaves one
of them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import SPACES, batches, ddl, keep, record_batch, unused

NO_ID = (1 << 63) - 1


class PatriciaTrie:
    """Compressed radix trie over byte strings; a node is [label, children, owner]."""

    def __init__(self) -> None:
        self.root = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, n_chars: int, doc_id: int, rows: int) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = child = [key[at:], {}, None]
                self.bytes += end - at + 300
                node = child
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared(key, at, label)
            middle = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][key[at]] = middle
            self.bytes += 300
            node, at = middle, at + shared
        owner = node[2]
        if owner is None:
            node[2] = (n_chars, doc_id, rows)
        elif (n_chars, -doc_id) > (owner[0], -owner[1]):
            node[2] = (n_chars, doc_id, rows + owner[2])
        else:
            node[2] = (owner[0], owner[1], rows + owner[2])

    def owners(self) -> Iterator[tuple[bytes, tuple[int, int, int]]]:
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            here = above + node[0]
            if node[2] is not None:
                yield here, node[2]
            stack.extend((child, here) for child in node[1].values())


    def finished(self, last: bytes) -> Iterator[tuple[bytes, tuple[int, int, int]]]:
        """Takes out and yields the strings before `last`, the greatest one inserted; the path to `last` stays.

        With keys in ascending order, every subtree beside that path is complete.
        """
        node, at, depth = self.root, 0, 1
        while True:
            child = node[1].get(last[at]) if at < len(last) else None
            done = [c for c in node[1].values() if c is not child]
            node[1] = {} if child is None else {last[at]: child}
            if node[2] is not None and at < len(last):
                yield last[:at], node[2]
                node[2] = None
            stack = [(c, last[:at]) for c in done]
            while stack:
                inner, above = stack.pop()
                here = above + inner[0]
                if inner[2] is not None:
                    yield here, inner[2]
                stack.extend((c, here) for c in inner[1].values())
            if child is None:
                break
            node, at, depth = child, at + len(child[0]), depth + 1
        self.bytes = len(last) + 300 * depth


def _shared(key: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of key[at:] and label, which differ."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


LOCAL = pa.schema([("size", pa.int64()), ("hash", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("id", pa.int64()), ("rows", pa.int64())])
OWNERS = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _merge(limit: int):
    """Copies within a task become one row, as far as the trie's memory reaches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        trie = PatriciaTrie()

        def release():
            owners = trie.owners()
            while some := [(len(norm), xxhash.xxh64_intdigest(norm) - (1 << 63), norm, *owner) for norm, owner in islice(owners, 1000)]:
                yield record_batch(LOCAL, list(zip(*some, strict=True)))

        for part in batches(parts):
            for norm, n, doc_id in zip(*(c.to_pylist() for c in part.columns), strict=True):
                trie.insert(norm, n, NO_ID if doc_id is None else doc_id, 1)
            if trie.bytes > limit:
                yield from release()
                trie = PatriciaTrie()
        yield from release()

    return run


def _own(limit: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("nothing")
        trie, last = PatriciaTrie(), None

        def release(owners):
            while some := [(hashlib.sha256(norm).hexdigest(), None if o[1] == NO_ID else o[1], o[2]) for norm, o in islice(owners, 1000)]:
                yield record_batch(OWNERS, list(zip(*some, strict=True)))

        for part in batches(parts):
            for _, _, norm, n, doc_id, rows in zip(*(c.to_pylist() for c in part.columns), strict=True):
                trie.insert(norm, n, doc_id, rows)
                last = norm
                if trie.bytes > limit:
                    yield from release(trie.finished(last))
        yield from release(trie.owners())

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), F.translate(text, SPACES, "").alias("norm"))
    local = rows.select(F.col("norm").cast("binary"), "n", "doc_id").mapInArrow(_merge(trie_bytes // 2), ddl(LOCAL))
    dealt = local.repartition("size", "hash").sortWithinPartitions("norm")
    owners = dealt.mapInArrow(_own(trie_bytes), ddl(OWNERS))
    marked = rows.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    return marked.join(owners, "sha", "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns: one of each group of equal texts, the one that `exact_dedup` keeps.

    Of rows that share the kept id and the normalised text, null ids too, the one with the most code points stays,
    then the least text. The rows meet the decisions by id and text, so copies with ids of their own are spread.
    """
    key, place = unused(docs, "__key"), unused(docs, "__place")
    own = lambda id_, sha: F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), sha)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(own(F.col("doc_id"), F.col("text_sha256")).alias(key)).distinct()
    keyed = docs.withColumn(key, own(F.col(id_col).cast("long"), F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)))
    order = Window.partitionBy(key).orderBy(F.length(text).desc(), text)
    return keyed.join(kept, key, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Include graph: edges, inversion, reachability, selection of entry points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.session import checkpoint

INCLUDE = r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"]+)"'


def include_names(files: DataFrame) -> DataFrame:
    """(src, raw): quoted includes as written; conditions around them are ignored, a safe superset."""
    return files.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1))).alias("raw"))


def resolve(candidates: DataFrame, nodes: DataFrame, wanted: list[str], found: str = "dst") -> DataFrame:
    """The first of the wanted columns that names a node; rows without one fall out."""
    rows = candidates
    for i, c in enumerate(wanted):
        known = nodes.select(F.col("path").alias(f"__n{i}")).distinct()
        rows = rows.join(known, F.col(c) == F.col(f"__n{i}"), "left")
    names = [f"__n{i}" for i in range(len(wanted))]
    return rows.withColumn(found, F.coalesce(*names)).where(F.col(found).isNotNull()).drop(*names)


def include_edges(files: DataFrame) -> DataFrame:
    """Distinct (src, dst): an include is sought beside its file, then at the root; outside the tree it is dropped."""
    raw = include_names(files)
    beside = C.relative_path(F.when(C.dirname("src") == "", F.col("raw")).otherwise(F.concat_ws("/", C.dirname("src"), "raw")))
    rows = raw.select("src", beside.alias("beside"), C.relative_path("raw").alias("rooted"))
    return resolve(rows, files.select("path"), ["beside", "rooted"]).select("src", "dst").distinct()


def invert(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, users): every node with the sorted nodes that point to it, none for some."""
    users = edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("users"))
    return nodes.select("path").distinct().join(users, "path", "left").select("path", F.coalesce("users", F.array().cast("array<string>")).alias("users"))


def reachable(edges: DataFrame, seeds: DataFrame, start: str = "src", end: str = "dst", node: str = "path") -> DataFrame:
    """(node): seeds and all that follows from them over start -> end; cycles are safe, any depth is followed.

    Semi-naive: a round expands only nodes found in the last one. The rounds' nodes are kept as checkpointed
    parts, of which two of the same rank are merged, so a node is written again once per doubling of the
    number of rounds and the plan reads a logarithmic number of parts.
    """
    steps = checkpoint(edges.select(F.col(start).alias("__a"), F.col(end).alias("__b")))
    fresh = checkpoint(seeds.select(F.col(seeds.columns[0]).alias(node)).distinct())
    parts: list[tuple[int, DataFrame]] = []
    while True:
        parts.append((0, fresh))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (rank, late), (_, early) = parts.pop(), parts.pop()
            parts.append((rank + 1, checkpoint(early.unionByName(late))))
        seen = reduce(DataFrame.unionByName, [p for _, p in parts])
        found = steps.join(fresh, F.col("__a") == F.col(node), "left_semi").select(F.col("__b").alias(node)).distinct()
        fresh = checkpoint(found.join(seen, node, "left_anti"))
        if fresh.isEmpty():
            return seen


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files and all that include them, directly or not; changed files count even if unknown."""
    paths = changed.select(C.relative_path(changed.columns[0]).alias("path"))
    return reachable(edges, paths, "dst", "src")


def affected_entry_points(edges: DataFrame, changed: DataFrame, entries: DataFrame, column: str = "file") -> DataFrame:
    """Entry rows, in their own spelling, whose file is affected."""
    hit = affected(edges, changed)
    return entries.withColumn("__p", C.relative_path(column)).join(hit, F.col("__p") == F.col("path"), "left_semi").drop("__p")


def incremental_tasks(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, changed: DataFrame, column: str = "file") -> tuple[DataFrame, bool]:
    """(tasks to run, nothing to do): all tasks where a changed path is unknown, else the affected ones."""
    paths = changed.select(C.relative_path(changed.columns[0]).alias("path"))
    if not paths.join(nodes.select("path"), "path", "left_anti").isEmpty():
        return tasks, False
    kept = affected_entry_points(edges, changed, tasks, column)
    return kept, kept.isEmpty()

"""Connected components by alternating large-star and small-star steps, each a min and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import checkpoint


SALTS = 8
#: A checkpoint writes a file a task: of few rows, no more files than these.
TASK_ROWS, FEW_TASKS = 100_000, 8


def tasks_of(rows: int) -> int:
    return max(FEW_TASKS, -(-rows // TASK_ROWS))


def merged(df: DataFrame, tasks: int | None) -> DataFrame:
    """The same rows by so many tasks at most, however many partitions the session's shuffles have."""
    return df if tasks is None else df.coalesce(tasks)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """Every neighbour of a (the larger ones, or all) points to the least of a and its neighbours."""
    # the edges of a hub are spread by a salt of the neighbour, and the skewed rest is AQE's to split
    least = directed.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a_"), F.least("a", "m").alias("m"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("s_"))
    joined = directed.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, (F.col("a") == F.col("a_")) & (F.col("s") == F.col("s_")))
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, component): component is the least node reachable; edges has columns a and b, and a > b not needed.

    Nodes without an edge to another node don't appear. Each round is checkpointed; it ends when no edge moves, after a number of
    rounds that grows with the logarithm of the nodes. tasks: at most so many write a checkpoint.
    """
    edges = checkpoint(merged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks))
    mark = None
    while True:
        large = _star(_both(edges), larger=True)
        edges = checkpoint(merged(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False), tasks))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

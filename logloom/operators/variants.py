"""Variant rollup and the three-level factoring of common defines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.operators.lifecycle import order_of
from logloom.session import checkpoint


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last value of each key; `first_seen` keeps its place."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_seen"))


def last_change(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """last_wins of a list that is replaced only by a list of another set: the first list of the last run of equal sets."""
    by = Window.partitionBy(*keys).orderBy(order)
    as_set = F.array_sort(F.array_distinct(value))
    marked = rows.withColumn("__changed", ~F.lag(as_set).over(by).eqNullSafe(as_set) | (F.row_number().over(by) == 1))
    return marked.groupBy(*keys).agg(F.max_by(value, F.when(F.col("__changed"), F.col(order))).alias(value), F.min(order).alias("first_seen"))


def variants(tasks: DataFrame) -> DataFrame:
    """(file, shader_type, entry, defines sorted with duplicates, first_seen); unknown stages keep the type UNKNOWN.

    Of several logs the order is by log, then by line.
    """
    rows = tasks.select(C.log_path("file_path").alias("file"), C.shader_type("entry_point").alias("shader_type"), F.col("entry_point").alias("entry"), F.array_sort("defines").alias("defines"), order_of(tasks).alias("seq"))
    return last_change(rows, ["file", "shader_type", "entry"], "defines", "seq")


def common_values(rows: DataFrame, kind: str, group: str, member: list[str], value: str) -> DataFrame:
    """(level, group, kind, value): shared by all, then by a kind, then by (group, kind), each less the levels above.

    Relational division by counts: members and members with a value are counted once by (group, kind) and
    summed for the levels above, which is exact because a member lies in one (group, kind).
    """
    ids = F.struct(*member)
    sizes = checkpoint(rows.groupBy(group, kind).agg(F.count_distinct(ids).alias("members")))
    having = checkpoint(rows.where(F.col(value).isNotNull()).groupBy(group, kind, value).agg(F.count_distinct(ids).alias("n")))
    total = sizes.agg(F.sum("members").alias("members"))
    # one row: the count of members
    everywhere = having.groupBy(value).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).where("n = members").select(value)
    of_kind = sizes.groupBy(kind).agg(F.sum("members").alias("members"))
    by_kind = having.groupBy(kind, value).agg(F.sum("n").alias("n")).join(of_kind, kind).where("n = members").select(kind, value).join(everywhere, value, "left_anti")
    by_group = having.join(sizes, [group, kind]).where("n = members").select(group, kind, value).join(everywhere, value, "left_anti").join(by_kind, [kind, value], "left_anti")
    none = F.lit(None).cast("string")
    return (
        everywhere.select(F.lit("all").alias("level"), none.alias(group), none.alias(kind), value)
        .unionByName(by_kind.select(F.lit("kind").alias("level"), none.alias(group), kind, value))
        .unionByName(by_group.select(F.lit("group").alias("level"), group, kind, value))
    )


def residual_values(rows: DataFrame, common: DataFrame, kind: str, group: str, value: str) -> DataFrame:
    """rows whose value is common at no level that holds them; duplicates stay."""
    out = rows.join(common.where("level = 'all'").select(value), value, "left_anti")
    out = out.join(common.where("level = 'kind'").select(kind, value), [kind, value], "left_anti")
    return out.join(common.where("level = 'group'").select(group, kind, value), [group, kind, value], "left_anti")


def common_defines(found: DataFrame) -> DataFrame:
    return common_values(found.select("file", "shader_type", "entry", F.explode_outer("defines").alias("define")), "shader_type", "file", ["entry"], "define")


def residual_defines(found: DataFrame, common: DataFrame) -> DataFrame:
    """found with the defines that no level shares."""
    rows = found.select("file", "shader_type", "entry", F.explode("defines").alias("define"))
    left = residual_values(rows, common, "shader_type", "file", "define").groupBy("file", "shader_type", "entry").agg(F.array_sort(F.collect_list("define")).alias("own"))
    return found.join(left, ["file", "shader_type", "entry"], "left").select("file", "shader_type", "entry", F.coalesce("own", F.array().cast("array<string>")).alias("defines"))


def list_statistics(lists: DataFrame, value: str) -> DataFrame:
    """What sharing equal lists saves: total, unique, shared lists, references saved, most uses."""
    uses = lists.groupBy(value).agg(F.count("*").alias("n"))
    return uses.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_lists"),
        F.count("*").alias("unique_lists"),
        F.count_if(F.col("n") > 1).alias("shared_lists"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("references_saved"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most_uses"),
    )

"""Diagnostics of compile results: parse, suppress, compare with a baseline, roll up, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.sources.files import lines_of


def parse(results: DataFrame) -> DataFrame:
    """One row per diagnostic line, in arrival order `seq` (result, then line)."""
    lines = lines_of(results, "log", "seq", "file", "entry", "type")
    d = lines.withColumn("d", C.diagnostic("line")).where("d is not null")
    return d.select(
        F.struct(F.col("seq").alias("result"), F.col("line_no").alias("line")).alias("seq"),
        "file",
        "entry",
        F.col("type").alias("shader_type"),
        F.col("d.severity").alias("severity"),
        F.col("d.code").alias("code"),
        F.col("d.message").alias("message"),
        F.concat_ws(":", C.compile_path("d.file"), "d.place").alias("location"),
        C.warning_key(F.col("d.code"), F.col("d.message")).alias("warning_key"),
    )


def is_suppressed(code: Column, codes: list[str]) -> Column:
    return F.lower(code).isin([c.lower() for c in codes]) if codes else F.lit(False)


def running_new(current: DataFrame, baseline: DataFrame, key: str, entry: str, location: str, seq: str, legacy: str | None = None) -> DataFrame:
    """current with is_new: the entry's distinct locations of the key so far exceed the baseline's count.

    A key that the baseline lacks is always new. Legacy baseline rows name locations without entries: their
    locations count as seen from the first line on. Entries compare without case. The count exceeds from one
    row on, the first one of the location that is one too many; only distinct locations are ordered to find it,
    so a warning repeated in many lines is no hot group.
    """
    is_legacy = F.col(legacy) if legacy else F.lit(False)
    base = baseline.groupBy(key).agg(F.max(is_legacy).alias("__legacy"), F.array_sort(F.collect_set(F.when(is_legacy, F.col(location)))).alias("__places"), F.count(F.when(is_legacy, 1)).alias("__listed"))
    counted = baseline.where(~is_legacy).groupBy(key, F.lower(entry).alias("__e")).agg(F.count_distinct(location).alias("__base"))
    rows = current.withColumn("__e", F.lower(entry))
    firsts = rows.groupBy(key, "__e", location).agg(F.min(seq).alias("__from")).join(base, key).join(counted, [key, "__e"], "left")
    spare = F.when(F.col("__legacy"), F.col("__listed") - F.size("__places")).otherwise(F.coalesce("__base", F.lit(0)))
    unknown = firsts.where(~F.coalesce(F.array_contains("__places", F.col(location)), F.lit(False)))
    ranked = unknown.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__e").orderBy("__from")))
    # a struct of nulls equals another, so null entries meet
    limits = ranked.where(F.col("__rank") == spare + 1).select(F.struct(key, "__e").alias("__ke"), "__from")
    found = rows.withColumn("__ke", F.struct(key, "__e")).join(base.select(key, "__legacy"), key, "left").join(limits, "__ke", "left")
    exceeds = F.coalesce(F.col(seq) >= F.col("__from"), F.lit(False))
    return found.select(*current.columns, (F.col("__legacy").isNull() | exceeds).alias("is_new"))


def warnings(parsed: DataFrame, baseline: DataFrame, suppress: list[str] | None = None) -> DataFrame:
    """All unsuppressed warnings with is_new."""
    kept = parsed.where("severity = 'warning'").where(~is_suppressed(F.col("code"), suppress or []))
    return running_new(kept, baseline, "warning_key", "entry", "location", "seq", "legacy")


def new_warnings(found: DataFrame) -> DataFrame:
    """One row per new (warning, type, entry, location without case); the first spelling stays."""
    keys = ["warning_key", "shader_type", "entry", F.lower("location").alias("__place")]
    first = found.where("is_new").groupBy(*keys).agg(F.min_by(F.struct("code", "message", "location", "file"), "seq").alias("d"), F.min("seq").alias("seq"))
    return first.select("warning_key", "shader_type", "entry", "d.code", "d.message", "d.location", "d.file", "seq")


def by_place(hits: DataFrame) -> DataFrame:
    """One row per (warning_key, location): its distinct entries in order of arrival, code, message, first seq."""
    each = hits.groupBy("warning_key", "location", "entry").agg(F.min("seq").alias("seq"), F.min_by(F.struct("code", "message"), "seq").alias("d"))
    entries = F.transform(F.array_sort(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("seq", "entry")))), lambda x: x["entry"])
    return each.groupBy("warning_key", "location").agg(entries.alias("entries"), F.min_by("d", "seq").alias("d"), F.min("seq").alias("seq")).select("warning_key", "location", "entries", "d.code", "d.message", "seq")


def ranked_warnings(places: DataFrame, order: str, n: int, shown_places: int = 3, shown_entries: int = 2) -> DataFrame:
    """The n first warnings of by_place by `order` (instances or combinations), with their share and first places.

    Ties go to the smaller key. samples: of the first places, the location, the first entries and how many more.
    """
    rows = places.withColumn("n", F.size("entries"))
    totals = rows.groupBy("warning_key").agg(F.count("*").alias("instances"), F.sum("n").alias("combinations"), F.min_by(F.struct("code", "message"), "seq").alias("d"))
    best = top(share(totals, order), [F.desc(order), F.asc("warning_key")], n)
    first = F.row_number().over(Window.partitionBy("warning_key").orderBy("seq", "location"))
    sample = F.struct(F.col("p"), F.col("location"), F.slice("entries", 1, shown_entries).alias("entries"), F.greatest(F.col("n") - shown_entries, F.lit(0)).alias("more"))
    # the best are n rows
    kept = rows.join(F.broadcast(best.select("warning_key")), "warning_key", "left_semi").withColumn("p", first).where(F.col("p") <= shown_places)
    samples = kept.groupBy("warning_key").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    none = F.array().cast(samples.schema["samples"].dataType)
    return best.join(samples, "warning_key", "left").select("warning_key", "d.code", "d.message", "instances", "combinations", "percent", F.coalesce("samples", none).alias("samples")).orderBy(F.desc(order), "warning_key")


def instance_counts(hits: DataFrame) -> DataFrame:
    """Distinct locations and affected (location, entry) pairs of each warning, most affected first."""
    pairs = hits.groupBy("warning_key").agg(F.count_distinct("location").alias("instances"), F.count_distinct("location", F.coalesce("entry", F.lit(""))).alias("combinations"))
    return pairs.orderBy(F.desc("combinations"), "warning_key")


def suppressed_count(parsed: DataFrame, suppress: list[str]) -> DataFrame:
    return parsed.agg(F.count_if((F.col("severity") == "warning") & is_suppressed(F.col("code"), suppress)).alias("suppressed"))


def errors(parsed: DataFrame) -> DataFrame:
    """Distinct (shader_key, location, code, message) with the types and entries that met them."""
    rows = parsed.where("severity = 'error'").withColumn("shader_key", F.lower(F.concat_ws(":", C.compile_path(C.basename("file")), "entry")))
    return rows.groupBy("shader_key", "location", "code", "message").agg(F.min_by("shader_type", "seq").alias("shader_type"), F.min_by("entry", "seq").alias("entry"))


def error_counts(found: DataFrame) -> DataFrame:
    """error_count: distinct errors; error_count_ref: three per failing shader, as the original report counts."""
    return found.agg(F.count("*").alias("error_count"), (3 * F.count_distinct("shader_key")).alias("error_count_ref"))


def eliminated(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline warnings that the current run no longer has."""
    return baseline.select("warning_key").distinct().join(current.select("warning_key").distinct(), "warning_key", "left_anti")


def file_summary(baseline: DataFrame, new: DataFrame, file: str, triple: list[str]) -> DataFrame:
    """file, baseline, new, total: distinct triples on both sides, total counts common ones twice; only files with new ones.

    A report orders it by new, most first.
    """
    sides = baseline.select(*triple, F.lit(1).alias("b"), F.lit(0).alias("n")).unionByName(new.select(*triple, F.lit(0).alias("b"), F.lit(1).alias("n")))
    each = sides.groupBy(*triple).agg(F.max("b").alias("b"), F.max("n").alias("n"))
    by_file = each.groupBy(file).agg(F.sum("b").alias("baseline"), F.sum(F.when((F.col("n") == 1) & (F.col("b") == 0), 1).otherwise(0)).alias("new"), F.sum(F.col("b") + F.col("n")).alias("total"))
    return by_file.where("new > 0")


def warning_file_summary(baseline: DataFrame, new: DataFrame, fold_case: bool = False) -> DataFrame:
    def triples(df: DataFrame) -> DataFrame:
        place = F.lower("location") if fold_case else F.col("location")
        return df.select(F.split_part(place, F.lit(":"), F.lit(1)).alias("file"), place.alias("location"), "entry")

    return file_summary(triples(baseline), triples(new), "file", ["file", "location", "entry"])


def gate(counts: DataFrame, limit: Column, baseline: str = "baseline_count", new: str = "new_count", errors: str = "errors", observed: str | None = None) -> DataFrame:
    """counts with exit_code: errors fail; a limit below 0 asks for so many fewer warnings; else a limit on new ones.

    The total under a negative limit is baseline + new. Where `observed` names the current total, exit_intent
    compares that instead, so that removed warnings count.
    """
    goal = F.greatest(F.lit(0), F.col(baseline) - F.abs(limit))

    def code(total: Column) -> Column:
        return F.when(F.col(errors) > 0, 1).when(limit < 0, (total > goal).cast("int")).otherwise((F.col(new) > limit).cast("int"))

    out = counts.withColumn("exit_code", code(F.col(baseline) + F.col(new)))
    return out.withColumn("exit_intent", code(F.col(observed))) if observed else out


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; order must end in a tie-breaker."""
    return rows.orderBy(*order).limit(n)


def share(rows: DataFrame, value: str, name: str = "percent") -> DataFrame:
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("__total") > 0, 100.0 * F.col(value) / F.col("__total")).otherwise(0.0)).drop("__total")


def context_lines(lines: DataFrame, hit: Column, order: str, line: str, partition: list[str], before: int = 2, after: int = 2, block: int = 100_000) -> DataFrame:
    """Hit lines with the lines around them in a numeric order.

    Lines are numbered, and each block of lines also sees the nearest ones of the blocks beside it.
    """
    numbered = row_numbers(lines, order, "__rn", partition=partition)
    at, own = F.col("__rn"), F.floor(F.col("__rn") / block)
    blocks = F.array_distinct(F.array(F.floor((at - after) / block), own, F.floor((at + before) / block)))
    each = numbered.withColumn("__own", own).withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(*partition, "__block").orderBy("__rn").rowsBetween(-before, after)
    found = each.withColumn("context", F.collect_list(line).over(w)).where((F.col("__block") == F.col("__own")) & hit)
    return found.drop("__rn", "__own", "__block")


def sliding_count(events: DataFrame, at: Column, width: int, name: str = "in_window", bits: int = 16) -> DataFrame:
    """Events of the last `width` units of `at` (whole numbers), this one included; null where `at` is null.

    Events are counted by time first. The count of a window is the running count at its end less the one
    before its start; both are read off the same running count, which is made in chunks of 2^bits units
    with the counts before each chunk carried by one row a chunk. A task holds at most two rows a unit of
    time, whatever the width and however many events share a time.
    """
    rows = events.withColumn("__at", at.cast("long"))
    counted = rows.where("__at is not null").groupBy("__at").agg(F.count("*").alias("__n"))
    mark = lambda t, n, sign: F.struct(t.alias("t"), n.cast("long").alias("n"), F.lit(sign).alias("sign"), F.col("__at").alias("of"))
    marks = counted.select(F.explode(F.array(mark(F.col("__at"), F.col("__n"), 1), mark(F.col("__at") - width - 1, F.lit(0), -1))).alias("m")).select("m.*").withColumn("chunk", F.shiftright("t", bits))
    before = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("chunk").agg(F.sum("n").alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    upto = Window.partitionBy("chunk").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = marks.withColumn("upto", F.sum("n").over(upto)).join(carried, "chunk")
    windows = running.groupBy(F.col("of").alias("__t")).agg(F.sum(F.col("sign") * (F.col("upto") + F.col("carried"))).alias(name))
    return rows.join(windows, F.col("__at") == F.col("__t"), "left").drop("__at", "__t")


def row_numbers(rows: DataFrame, order: str, name: str, bits: int = 16, partition: list[str] | None = None) -> DataFrame:
    """Row numbers from 0 over a numeric order: a running count over one row per chunk, then within chunks.

    They are counted apart in each partition; null partitions are equal to each other.
    """
    part = F.struct(*partition) if partition else F.struct(F.lit(0).alias("all"))
    chunked = rows.withColumn("__part", part).withColumn("__chunk", F.shiftright(F.col(order).cast("long"), bits))
    before = Window.partitionBy("__part").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = chunked.groupBy("__part", "__chunk").agg(F.count("*").alias("n")).select("__part", "__chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    w = Window.partitionBy("__part", "__chunk").orderBy(order)
    return chunked.join(start, ["__part", "__chunk"]).withColumn(name, F.col("__start") + F.row_number().over(w) - 1).select(*rows.columns, name)


def moving_average(rows: DataFrame, value: str, order: str, n: int = 10, name: str = "average", block: int = 100_000) -> DataFrame:
    """Mean of the value over this row and the n - 1 rows before it in a numeric order.

    Rows are numbered, and each block of rows also sees the last n - 1 of the block before.
    """
    numbered = row_numbers(rows, order, "__rn")
    own, near = F.floor(F.col("__rn") / block), F.col("__rn") % block >= block - (n - 1)
    each = numbered.withColumn("__block", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__block").orderBy("__rn").rowsBetween(-(n - 1), Window.currentRow)
    return each.withColumn(name, F.avg(value).over(w)).where(F.col("__block") == own).drop("__rn", "__block")

"""Event lifecycles: LIFO pairing, block islands, as-of attribution, first-match attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import columns as C

#: The formats of log lines (time, process, level, text).
HEAD = r"^\[(\d{2}:\d{2}:\d{2}\.\d{3})\] \[(\d+)\] "
OPEN = HEAD + r"\[D\] Compiling (.*?)\s+([^:]+:[^:]+:[0-9a-fA-F]+)\s+to\s+(.*)$"
CLOSE = HEAD + r"\[D\] (?:Compiled shader|Adding Completed shader to map:) ([^:]+:[^:]+:[0-9a-fA-F]+)"
BLOCK = HEAD + r"\[D\] Shader logs:"


#: Ordered rows are handled in chunks of so many order values, so that one long log is many tasks.
CHUNK_BITS = 16


def _chunk(order: str | Column) -> Column:
    return F.shiftright(C.col(order).cast("long"), CHUNK_BITS)


def pair_lifo(events: DataFrame, keys: list[str], seq: str, kind: str, end: str = "end_seq") -> DataFrame:
    """Opening events (kind 1) with the seq of the closing event (kind -1) that takes the latest open one of its key.

    seq is a whole number, or a struct that starts with one. Parenthesis matching with running sums: a closer
    that takes the sum to a new low below 0 closes nothing; the depth of the others is the sum less that low,
    and an opener is closed by the next event of its depth if that is a closer. A key's events are ordered
    within chunks of order values only: sums, lows and the first event of each depth cross the chunks by one
    row a chunk, so a hot key is many tasks. Null keys are equal to each other.
    """
    whole = F.col(seq)
    if isinstance(events.schema[seq].dataType, T.StructType):
        whole = whole.getField(events.schema[seq].dataType[0].name)
    rows = events.withColumn("__key", F.struct(*keys)).withColumn("__chunk", _chunk(whole))
    by = Window.partitionBy("__key", "__chunk").orderBy(seq)
    rows = rows.withColumn("__s", F.sum(kind).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__low", F.min("__s").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    sums = rows.groupBy("__key", "__chunk").agg(F.sum(kind).alias("total"), F.min("__s").alias("low"))
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("__s0", F.coalesce(F.sum("total").over(before), F.lit(0)))
    carried = carried.withColumn("__low0", F.least(F.lit(0), F.min(F.col("__s0") + F.col("low")).over(before))).select("__key", "__chunk", "__s0", "__low0")
    level, lowest = F.col("__s0") + F.col("__s"), F.least("__low0", F.col("__s0") + F.col("__low"))
    closes = F.col(kind) == -1
    deep = rows.join(carried, ["__key", "__chunk"]).where(~closes | (level >= lowest)).withColumn("__depth", level - lowest + closes.cast("int"))
    event = F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"))
    firsts = deep.groupBy("__key", "__chunk", "__depth").agg(F.min_by(event, seq).alias("first"))
    later = firsts.select("__key", "__chunk", "__depth", F.lead("first").over(Window.partitionBy("__key", "__depth").orderBy("__chunk")).alias("__later"))
    inside = F.lead(event).over(Window.partitionBy("__key", "__chunk", "__depth").orderBy(seq))
    opened = deep.withColumn("__next", inside).where(F.col(kind) == 1).join(later, ["__key", "__chunk", "__depth"])
    following = F.coalesce("__next", "__later")
    return opened.select(*events.columns, F.when(following.getField("kind") == -1, following.getField("seq")).alias(end))


def file_of(lines: DataFrame) -> list[str]:
    """The column that parts several logs, if there is one; every key and order below starts with it."""
    return [c for c in ("path",) if c in lines.columns]


def log_events(lines: DataFrame) -> DataFrame:
    """Typed events of ([path,] line_no, line): kind 1 opens, -1 closes."""
    x = lambda pattern, i: F.regexp_extract("line", pattern, i)
    opens, closes = F.col("line").rlike(OPEN), F.col("line").rlike(CLOSE)
    kind = F.when(opens, 1).when(closes, -1)
    return lines.where(opens | closes).select(
        *file_of(lines),
        F.col("line_no").alias("seq"),
        kind.alias("kind"),
        F.when(opens, x(OPEN, 2)).otherwise(x(CLOSE, 2)).alias("process_id"),
        F.when(opens, x(OPEN, 4)).otherwise(x(CLOSE, 3)).alias("entry_point"),
        F.when(opens, x(OPEN, 3)).alias("file_path"),
        F.when(opens, C.define_tokens(x(OPEN, 5))).alias("defines"),
        C.time_ms("line").alias("ms"),
    )


def log_tasks(lines: DataFrame) -> DataFrame:
    """Tasks: each opening line with its start and, where it was closed in the same log, its end."""
    # the closing time travels in the ordering value, so no second join is needed
    events = log_events(lines).withColumn("at", F.struct("seq", "ms"))
    part = file_of(lines)
    paired = pair_lifo(events, [*part, "process_id", "entry_point"], "at", "kind", "closed")
    return paired.select(*part, "seq", "process_id", "entry_point", "file_path", "defines", F.col("ms").alias("start_ms"), F.col("closed.ms").alias("end_ms"))


def islands(lines: DataFrame, opens: Column, ends: Column, order: str, partition: list[str] | None = None) -> DataFrame:
    """Lines that follow an opening line before any ending one; `head` is the opening line's order value.

    The last opening and ending lines before a chunk come from a running maximum over one row per chunk; the
    lines themselves are only ordered within their chunk.
    """
    part = partition or []
    rows = lines.withColumn("__chunk", _chunk(order)).withColumn("__o", F.when(opens, F.col(order))).withColumn("__e", F.when(ends, F.col(order)))
    before = Window.partitionBy(*(part or [F.lit(0)])).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part, "__chunk").agg(F.max("__o").alias("o"), F.max("__e").alias("e"))
    carried = sums.select(*part, "__chunk", F.max("o").over(before).alias("__o0"), F.max("e").over(before).alias("__e0"))
    w = Window.partitionBy(*part, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.join(carried, [*part, "__chunk"]).withColumn("head", F.coalesce(F.max("__o").over(w), "__o0")).withColumn("__end", F.coalesce(F.max("__e").over(w), "__e0"))
    inside = F.col("head").isNotNull() & (F.col(order) > F.col("head")) & (F.col("__end").isNull() | (F.col("__end") <= F.col("head")))
    return marked.where(inside).select(*lines.columns, "head")


def with_next(lines: DataFrame, value: str, order: str, name: str, partition: list[str] | None = None) -> DataFrame:
    """lines with the value of the next line; across chunks it is the first value of the next chunk."""
    part = partition or []
    rows = lines.withColumn("__chunk", _chunk(order))
    firsts = rows.groupBy(*part, "__chunk").agg(F.min_by(value, order).alias("f"))
    nexts = firsts.select(*part, "__chunk", F.lead("f").over(Window.partitionBy(*(part or [F.lit(0)])).orderBy("__chunk")).alias("__first"))
    w = Window.partitionBy(*part, "__chunk").orderBy(order)
    inner = F.lead(F.struct(value)).over(w)
    return rows.join(nexts, [*part, "__chunk"]).withColumn("__n", inner).select(*lines.columns, F.when(F.col("__n").isNotNull(), F.col(f"__n.{value}")).otherwise(F.col("__first")).alias(name))


def block_warnings(lines: DataFrame) -> DataFrame:
    """Warning lines of `Shader logs:` blocks with the block's process and time."""
    part = file_of(lines)
    clean = lines.withColumn("line", F.trim("line"))
    header = F.col("line").rlike(BLOCK)
    inside = islands(clean, header, (F.col("line") == "") | F.col("line").startswith("["), "line_no", part)
    heads = clean.where(header).select(*part, F.col("line_no").alias("head"), F.regexp_extract("line", BLOCK, 2).alias("process_id"), C.time_ms("line").alias("ms"))
    d = inside.withColumn("d", C.diagnostic("line")).where("d.severity = 'warning'")
    place = F.lower(F.concat_ws(":", C.log_path("d.file"), F.col("d.place")))
    return d.join(heads, [*part, "head"]).select(*part, "head", "process_id", "ms", F.col("line_no").alias("seq"), C.warning_key(F.col("d.code"), F.col("d.message")).alias("warning_key"), F.col("d.code").alias("code"), F.col("d.message").alias("message"), place.alias("location"))


#: Time is a tree of nodes of RADIX children each.
RADIX_BITS = 3


def _covering(first: Column, last: Column, levels: int) -> Column:
    """The (level, node) pairs that cover first..last exactly: at each level what the parents above don't."""
    parts = []
    low = lambda n: F.shiftright(first + ((1 << RADIX_BITS * n) - 1), RADIX_BITS * n)
    high = lambda n: F.shiftright(last + 1, RADIX_BITS * n) - 1
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    for n in range(levels):
        a, b = low(n), high(n)
        if n + 1 < levels:
            up, down = F.shiftleft(low(n + 1), RADIX_BITS), F.shiftleft(high(n + 1) + 1, RADIX_BITS)
            nodes = F.when(up < down, F.concat(run(a, F.least(b, up - 1)), run(F.greatest(a, down), b))).otherwise(run(a, b))
        else:
            nodes = run(a, b)
        level = F.lit(n).alias("level")
        parts.append(F.transform(nodes, lambda x: F.struct(level, x.alias("node"))))  # noqa: B023
    return F.concat(*parts)


def as_of(points: DataFrame, intervals: DataFrame, key: str | list[str], at: str, point_id: str, start: str, end: str, seq: str) -> DataFrame:
    """Each point with the latest interval (by seq) of its key that holds it; points without one fall out.

    Time is a tree of nodes; an interval is kept at the few nodes that cover it exactly, and of the intervals
    of a node only the latest, so a node answers with one row however many intervals hold it. A point asks
    its node of every level. No pairs of points and covering intervals are formed, and a hot key is spread
    over its nodes. An open interval (null end) reaches to the last time. Points with equal ids are one point.
    """
    keys = [key] if isinstance(key, str) else list(key)
    span = intervals.agg(F.min(start).alias("lo"), F.max(start).alias("hi")).crossJoin(points.agg(F.max(at).alias("top"))).first()
    lo = 0 if span["lo"] is None else int(span["lo"])
    hi = max(lo, *(int(v) for v in (span["hi"], span["top"]) if v is not None), lo)
    levels = -(-(hi - lo + 1).bit_length() // RADIX_BITS)
    last = F.least(F.coalesce(F.col(end), F.lit(hi)), F.lit(hi)) - lo
    held = intervals.where((F.col(start) <= hi) & (last >= F.col(start) - lo))
    held = held.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(F.col(seq), *[c for c in intervals.columns if c != seq]).alias("__interval"), F.explode(_covering((F.col(start) - lo).cast("long"), last.cast("long"), levels)).alias("__n"))
    by = [f"__k{i}" for i in range(len(keys))]
    latest = held.groupBy(*by, F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node")).agg(F.max_by("__interval", f"__interval.{seq}").alias("__interval"))
    asks = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright((F.col(at) - lo).cast("long"), RADIX_BITS * n).alias("node")) for n in range(levels)])
    p = points.where(F.col(at) >= lo).withColumn("__ask", F.explode(asks))
    same = (F.col("__ask.level") == F.col("__level")) & (F.col("__ask.node") == F.col("__node"))
    for k, b in zip(keys, by):
        same &= F.col(k) == F.col(b)
    # the point's own columns travel through the aggregate, so the points are read once
    rest = [c for c in points.columns if c != point_id]
    best = p.join(latest, same).groupBy(point_id).agg(F.any_value(F.struct(*rest)).alias("__p"), F.max_by("__interval", f"__interval.{seq}").alias("interval"))
    return best.select(point_id, *[F.col(f"__p.{c}").alias(c) for c in rest], "interval")


def first_of(points: DataFrame, candidates: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each point with the first candidate (by seq) of its keys, whatever its time."""
    rest = [c for c in candidates.columns if c not in keys]
    first = candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("first"))
    return points.join(first, keys)


def order_of(lines: DataFrame, column: str = "seq") -> Column:
    """The order of rows of several logs: by log, then by line."""
    return F.struct(*file_of(lines), column) if file_of(lines) else F.col(column)


def log_warnings(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """(warning_key, code, message, location, entry, seq): warnings of blocks, attributed to the task active at the block."""
    found, part = block_warnings(lines), file_of(lines)
    blocks = found.select(*part, "head", "process_id", "ms").distinct().withColumn("block", F.struct(*part, "head"))
    active = as_of(blocks, tasks, [*part, "process_id"], "ms", "block", "start_ms", "end_ms", "seq").select(*part, "head", F.col("interval.entry_point").alias("entry"))
    met = found.join(active, [*part, "head"]).withColumn("seq", order_of(lines))
    hits = met.groupBy("warning_key", "location", "entry").agg(F.min("seq").alias("seq"), F.min_by(F.struct("code", "message"), "seq").alias("d"))
    return hits.select("warning_key", "d.code", "d.message", "location", "entry", "seq")


def log_errors(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """(error_key, error_text): two-line failure reports, attributed to the first task of their process (and entry)."""
    part = file_of(lines)
    two = with_next(lines.withColumn("line", F.trim("line")), "line", "line_no", "follow", part)
    failed = HEAD + r"\[E\] Failed to compile (?:\w+) shader ([^:]*):(?:[^:]*):([0-9a-fA-F]+):"
    warned = HEAD + r"\[W\] Shader compilation failed:"
    d = C.diagnostic("follow")
    loose = r"^(.*?):(\d+:\d+): (\w+): (.+)$"
    x = lambda p, i, c="line": F.regexp_extract(c, p, i)
    named = two.where(F.col("line").rlike(failed)).withColumn("d", d).where("d.severity = 'error'").select(*part, x(failed, 2).alias("process_id"), x(failed, 3).alias("name"), x(failed, 4).alias("hash"), F.concat(F.col("d.code"), F.lit(": "), F.col("d.message"), F.lit(" ("), C.log_path("d.file"), F.lit(":"), F.col("d.place"), F.lit(")")).alias("error_text"))
    parts = F.split("entry_point", ":")
    by_entry = tasks.select(*part, "process_id", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(2)).alias("hash"), "entry_point", "file_path", "seq")
    first = first_of(named, by_entry, [*part, "process_id", "name", "hash"], "seq")
    plain = two.where(F.col("line").rlike(warned) & F.col("follow").rlike(loose)).select(*part, x(warned, 2).alias("process_id"), F.concat(x(loose, 3, "follow"), F.lit(": "), x(loose, 4, "follow"), F.lit(" ("), C.log_path(x(loose, 1, "follow")), F.lit(":"), x(loose, 2, "follow"), F.lit(")")).alias("error_text"))
    any_ = first_of(plain, tasks.select(*part, "process_id", "entry_point", "file_path", "seq"), [*part, "process_id"], "seq")
    both = first.select("error_text", "first.entry_point", "first.file_path").unionByName(any_.select("error_text", "first.entry_point", "first.file_path"))
    return both.select(F.concat_ws(":", C.log_path("file_path"), F.col("entry_point")).alias("error_key"), "error_text").distinct()

"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import schemas

#: Fixed value, the format of a diagnostic line: file(line[,col[-col]] or line:col): warning|error CODE: message
DIAGNOSTIC = r"^(.*?)\((\d+(?:,\d+(?:-\d+)?|:\d+)?)\): (warning|error) (\w+): (.+)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*sorted(table.items()))])[key]


def time_ms(line: Column | str) -> Column:
    """Milliseconds of the day of `[HH:MM:SS.mmm]...`; null where the line has no such time."""
    p = lambda i: F.regexp_extract(col(line), r"^.(\d{2}):(\d{2}):(\d{2})\.(\d{3})", i).try_cast("long")
    return ((p(1) * 60 + p(2)) * 60 + p(3)) * 1000 + p(4)


def timestamp_of(line: Column | str) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("1900-01-01 "), F.substring(col(line), 2, 12)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def log_path(path: Column | str) -> Column:
    """The part after the first word-bounded `Shaders/`, with single forward slashes; else the whole path."""
    clean = F.regexp_replace(_slashes(col(path)), "/+", "/")
    found = F.regexp_extract(clean, r"(?i)^.*?\bShaders/(.*)$", 1)
    return F.when(clean.rlike(r"(?i)\bShaders/"), found).otherwise(clean)


def compile_path(path: Column | str) -> Column:
    """The part after the last `Shaders/` (or a closing `Shaders`), outer slashes removed; null or empty: ''."""
    parts = F.split(_slashes(F.coalesce(col(path), F.lit(""))), r"(?i)Shaders(?:/|$)", -1)
    return F.regexp_replace(F.element_at(parts, -1), "^/+|/+$", "")


def relative_path(path: Column | str) -> Column:
    """Forward slashes, `.` and `dir/..` folded away; empty becomes `.`; leading `..` stay."""
    clean = _slashes(col(path))
    rooted = clean.startswith("/")
    parts = F.aggregate(F.split(clean, "/"), F.array().cast("array<string>"), lambda done, p: _fold_path(done, p, rooted))
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def _fold_path(done: Column, part: Column, rooted: Column) -> Column:
    last = F.try_element_at(done, F.lit(-1))
    up = part == ".."
    return (
        F.when((part == "") | (part == "."), done)
        .when(up & last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(up & rooted, done)
        .otherwise(F.concat(done, F.array(part)))
    )


def basename(path: Column | str) -> Column:
    return F.substring_index(_slashes(col(path)), "/", -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def short_path(path: Column | str, project: str) -> Column:
    """What follows the project folder (any case), else the path as it is."""
    found = F.regexp_extract(_slashes(col(path)), rf"(?i)^.*?{project}/(.*)$", 1)
    return F.when(found != "", found).otherwise(_slashes(col(path)))


def feature_of(path: Column | str, otherwise: str = "") -> Column:
    found = F.regexp_extract(col(path), r"features[/\\]([^/\\]+)", 1)
    return F.when(found != "", found).otherwise(otherwise)


def shader_type(entry: Column | str) -> Column:
    """Of `name:stage:hash`; UNKNOWN for other stages or fewer parts."""
    parts = F.split(col(entry), ":")
    known = lookup(schemas.SHADER_TYPES, F.lower(F.get(parts, F.lit(1))))
    return F.when(F.size(parts) >= 3, F.coalesce(known, F.lit("UNKNOWN"))).otherwise("UNKNOWN")


def define_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.trim(col(text)), F.lit(r"(?U)(\S+=\w+|\S+)"), F.lit(1))


def flatten_defines(defines: Column | str) -> Column:
    """Of an array of arrays: flat, without nulls, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array_compact(col(defines))))))


def define_name(define: Column) -> Column:
    return F.split_part(define, F.lit("="), F.lit(1))


def strip_defines(defines: Column | str, debug: list[str], marker: str = "D3DCOMPILE_AVOID_FLOW_CONTROL") -> Column:
    kept = F.filter(col(defines), lambda d: ~F.upper(define_name(d)).isin([x.upper() for x in debug]))
    return F.when(F.array_contains(kept, marker), kept).otherwise(F.concat(kept, F.array(F.lit(marker))))


def valid_define(define: Column) -> Column:
    return define.rlike(r"^[A-Za-z_]\w*(=\w+)?$")


def diagnostic(line: Column | str) -> Column:
    """struct(file, place, severity, code, message), null where the line is no diagnostic."""
    names = ("file", "place", "severity", "code", "message")
    parts = F.struct(*[F.regexp_extract(col(line), DIAGNOSTIC, i).alias(n) for i, n in enumerate(names, 1)])
    return F.when(col(line).rlike(DIAGNOSTIC), parts)


def warning_key(code: Column, message: Column) -> Column:
    return F.lower(F.concat_ws(":", code, message))


def clean_body(body: Column | str) -> Column:
    text = F.regexp_replace(col(body), r"(?s)/\*.*?\*/", "")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "//.*$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_array(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"\[.*?\]$", "")


def is_padding(name: Column | str) -> Column:
    return F.lower(F.split_part(col(name), F.lit("["), F.lit(1))).rlike("^_?pad|pad(ding)?$")


def is_io_name(name: Column | str) -> Column:
    return F.upper(col(name)).rlike("_(IN|OUT)PUT$")


def base_type(type_: Column | str) -> Column:
    found = F.regexp_extract(col(type_), r"^(.+?)\[(\d+)\]$", 1)
    return F.when(found != "", found).otherwise(col(type_))


def type_count(type_: Column | str) -> Column:
    found = F.regexp_extract(col(type_), r"^(.+?)\[(\d+)\]$", 2)
    return F.when(found != "", found.try_cast("int")).otherwise(1)


def canonical_type(type_: Column | str) -> Column:
    base = base_type(type_)
    rows, columns = (F.regexp_extract(F.upper(base), r"FLOAT(\d)X(\d)", i) for i in (1, 2))
    matrix = F.concat(F.when(F.upper(base).contains("XM"), "xmfloat").otherwise("float"), rows, F.lit("x"), columns)
    return F.when(rows != "", matrix).otherwise(F.lower(F.substring_index(base, "::", -1)))


def field_size(type_: Column | str, count: Column, corrected: bool = False) -> Column:
    """struct(size, is_unknown_type) of a field of `count` elements."""
    sizes = schemas.TYPE_SIZES | (schemas.MORE_TYPE_SIZES if corrected else {})
    many = count * type_count(type_)
    base, name = base_type(type_), canonical_type(type_)
    rows, columns = (F.regexp_extract(name, r"^(?:xm)?float(\d)x(\d)" if corrected else r"^float(\d)x(\d)", i).try_cast("int") for i in (1, 2))
    one = F.when(base.endswith("*"), schemas.POINTER_SIZE).when(rows.isNotNull(), 4 * rows * columns).otherwise(F.coalesce(lookup(sizes, name), F.lit(schemas.DEFAULT_SIZE)))
    unknown = ~base.endswith("*") & rows.isNull() & lookup(sizes, name).isNull()
    return F.struct((one * many).cast("int").alias("size"), unknown.alias("is_unknown_type"))


def packed_size(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def aligned_size(sizes: Column) -> Column:
    """Each member starts on 16 bytes and the total is rounded: the sum of the rounded sizes."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + F.ceil(x / 16).cast("long") * 16)


def packoffset_size(fields: Column) -> Column:
    """Fold of fields(size, packoffset): offsets cN.[xyzw], members on 4 bytes, the end rounded to 16.

    A packoffset of another form is an error.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("most"))

    def step(state: Column, f: Column) -> Column:
        register = F.regexp_extract(f["packoffset"], r"^c(\d+)\.([xyzw])", 1).try_cast("long")
        part = F.position(F.regexp_extract(f["packoffset"], r"^c(\d+)\.([xyzw])", 2), F.lit("xyzw")) - 1
        bad = F.raise_error(F.concat(F.lit("bad packoffset: "), f["packoffset"])).cast("long")
        place = F.when(f["packoffset"].isNull() | (f["packoffset"] == ""), F.ceil(state["at"] / 4).cast("long") * 4).when(register.isNull(), bad).otherwise(F.greatest(state["at"], register * 16 + part * 4))
        end = place + f["size"]
        return F.struct(end.cast("long").alias("at"), F.greatest(state["most"], end).cast("long").alias("most"))

    return F.ceil(F.aggregate(fields, start, step)["most"] / 16).cast("long") * 16


def signature(fields: Column) -> Column:
    return F.array_join(F.transform(fields, lambda f: F.concat_ws(":", f["type"], f["name"], f["size"].cast("string"))), ";")


def usage(pixel: Column, vertex: Column, vr: Column) -> Column:
    return F.concat_ws("+", F.when(pixel, "P"), F.when(vertex, "V"), F.when(vr, "VR"))


def emphasize(condition: Column, value: Column) -> Column:
    return F.when(condition & (value != ""), F.concat(F.lit("<ins>**_"), value, F.lit("_**</ins>"))).otherwise(value)


def link(path: Column, line: Column) -> Column:
    """Repository link of a line; slashes stay, other reserved characters are escaped."""
    return F.concat(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("#L"), line.cast("string"))


def section_id(name: Column, path: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("-", name, path), "[^A-Za-z0-9]+", "-"))


def analysis_link(name: Column, path: Column, status: Column) -> Column:
    return F.when(status == "Unmatched", status).otherwise(F.concat(F.lit("["), status, F.lit("](#"), section_id(name, path), F.lit(")")))

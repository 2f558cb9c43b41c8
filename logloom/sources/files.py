"""Text, source-tree, list and configuration sources."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from logloom import schemas
from logloom.functions import columns as C


def read_lines(spark: SparkSession, path: str, dense: bool = True) -> DataFrame:
    """(path, line_no, line), line_no from 1.

    dense=True reads each file as one row: for files of a memory's size. dense=False splits large files:
    line_no is then a 64-bit number that grows with the line but has gaps (the split's start in bytes, then
    the row in the split), which is all that the order-dependent operators need.
    """
    if dense:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        return lines_of(raw, "value", "path")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    # a line has a byte at least, so a split's lines counted from its start stay below the next split's start
    first = raw.groupBy("path", "start").agg(F.min("row").alias("first"))
    return raw.join(first, ["path", "start"]).select("path", (F.col("start") + F.col("row") - F.col("first") + 1).alias("line_no"), "line")


def lines_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line of a text column; line ends are LF, CR LF or CR, and a last empty line doesn't count."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    found = df.where(F.length(text) > 0).select(*keep, F.posexplode(parts).alias("p", "line"))
    return found.select(*keep, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".hlsl", ".hlsli"), excluded: tuple[str, ...] = schemas.EXCLUDED_DIRS) -> DataFrame:
    """(path relative to root, content) of the files with these extensions (any case), outside excluded folders.

    Spark's text source passes over files without a byte, so those are not in the tree.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("content"))
    # the metadata column holds an encoded URI, with one slash or three after a local scheme
    local = F.regexp_replace("full", "^file:/+", "/")
    base = root.rstrip("/") + "/"
    path = F.url_decode(F.replace(F.replace(local, F.lit(base), F.lit("")), F.lit("+"), F.lit("%2B")))
    return select_sources(files.select(path.alias("path"), "content"), extensions, excluded)


def select_sources(files: DataFrame, extensions: tuple[str, ...] = (".hlsl", ".hlsli"), excluded: tuple[str, ...] = schemas.EXCLUDED_DIRS) -> DataFrame:
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    suffix = "|".join(e.replace(".", r"\.") for e in extensions)
    return files.where(F.lower("path").rlike(f"({suffix})$") & ~F.exists(folders, lambda d: d.isin(*excluded)))


def excluded_dirs(gitignore: str = "") -> tuple[str, ...]:
    """The default folders and the plain folder patterns of an ignore file."""
    own = (p.strip() for p in gitignore.splitlines())
    return tuple(sorted({*schemas.EXCLUDED_DIRS, *(p.strip("/").rpartition("/")[2] for p in own if p.strip("/") and p.endswith("/") and not p.startswith(("#", "!")))}))


def with_combos(files: DataFrame) -> DataFrame:
    """Every file under every define combination; the four combinations are a literal, not a joined table."""
    pairs = F.array(*[F.struct(F.lit(name).alias("combo"), F.array(*map(F.lit, defines)).alias("defines")) for name, defines in sorted(schemas.COMBOS.items())])
    return files.select("*", F.explode(pairs).alias("c")).select(*files.columns, "c.combo", "c.defines")


def changed_files(spark: SparkSession, value: str | None) -> DataFrame:
    """(path): a comma list, or @file with one path per line (a missing file is no path)."""
    if value and value.startswith("@"):
        try:
            return spark.read.text(value[1:]).select(F.trim("value").alias("path")).where("path <> ''")
        except AnalysisException:
            value = ""
    rows = [(p.strip(),) for p in (value or "").split(",") if p.strip()]
    return spark.createDataFrame(rows, "path string")


def count_if(lines: DataFrame, line: str, words: list[str], name: str) -> DataFrame:
    """Lines that hold any of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col(line).contains(w)
    return lines.agg(F.count_if(hit).alias(name))


def load_config(text: str) -> dict:
    import yaml

    loaded = yaml.safe_load(text)
    return loaded if isinstance(loaded, dict) else {}


def config_tasks(spark: SparkSession, config: dict) -> DataFrame:
    """Compile tasks of a configuration document, numbered by seq; nodes of another shape are passed over."""
    rows = []
    for shader in config.get("shaders") or []:
        for kind, node in ((shader.get("configs") if isinstance(shader, dict) else None) or {}).items():
            if not isinstance(node, dict):
                continue
            shared = node.get("common_defines")
            for entry in node.get("entries") or []:
                if isinstance(entry, dict) and "entry" in entry:
                    own = entry.get("defines")
                    rows.append((len(rows), shader.get("file"), kind, entry["entry"], [shared if isinstance(shared, list) else [], own if isinstance(own, list) else []]))
    found = spark.createDataFrame(rows, "seq long, file string, shader_type string, entry string, nested array<array<string>>")
    return found.select("seq", "file", "shader_type", "entry", C.flatten_defines("nested").alias("defines"))


def config_baseline(spark: SparkSession, config: dict) -> DataFrame:
    """Baseline warning facts; a list of locations instead of a map is the legacy form, without entries."""
    rows = []
    for key, w in (config.get("warnings") or {}).items():
        instances = w.get("instances", {}) if isinstance(w, dict) else {}
        head = (str(key).lower(), w.get("code") if isinstance(w, dict) else None, w.get("message") if isinstance(w, dict) else None)
        if isinstance(instances, list):
            rows += [(*head, place, None, True) for place in instances]
        else:
            rows += [(*head, place, e, False) for place, i in (instances or {}).items() for e in (i or {}).get("entries") or []]
    return spark.createDataFrame(rows, schemas.BASELINE)


def tasks_by_key(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.lower(F.concat_ws(":", "file", "entry")).alias("key"), "shader_type", "defines")


def only_file(tasks: DataFrame, path: str) -> DataFrame:
    return tasks.where(C.basename("file") == PurePosixPath(path).name)


def existing(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    return tasks.join(nodes.select(F.col("path").alias("file")), "file", "left_semi")


def validated(tasks: DataFrame, nodes: DataFrame, compiler_present: bool = True, output_present: bool = True) -> DataFrame:
    """tasks with the first failing check in error_msg (null if all pass)."""
    known = nodes.select(F.col("path").alias("file"), F.lit(True).alias("there")).distinct()
    fails: list[tuple[Column, str]] = [
        (F.lit(not compiler_present), "compiler not found"),
        (F.col("there").isNull(), "file not found"),
        (~F.col("file").rlike(r"\.hlsli?$"), "not a shader file"),
        (F.lit(not output_present), "output folder not found"),
        (F.exists("defines", lambda d: ~C.valid_define(d)), "bad define"),
    ]
    message = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in fails])
    return tasks.join(known, "file", "left").select(*tasks.columns, message.alias("error_msg"))

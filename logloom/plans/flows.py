"""The end-to-end questions: which variants were built, what must be compiled, what is new, what is bound where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import diagnostics as D
from logloom.operators import includes as G
from logloom.operators import lifecycle as L
from logloom.operators import linkage as K
from logloom.operators import sources_code as S
from logloom.operators import variants as V
from logloom.operators.compile_exec import Make, Run, compile_tasks, run_command
from logloom.plans import reports
from logloom.session import checkpoint
from logloom.sources import files as R


def generate(lines: DataFrame) -> dict[str, DataFrame]:
    """tasks, variants, warnings and errors of (line_no, line) of a log, or (path, line_no, line) of several, read apart."""
    tasks = checkpoint(L.log_tasks(lines))
    return {"tasks": tasks, "variants": V.variants(tasks), "warnings": L.log_warnings(lines, tasks), "errors": L.log_errors(lines, tasks)}


def _placed(df: DataFrame, column: str, age: int) -> DataFrame:
    """df with its order as (age, log, line), whether it comes from one log or several."""
    many = dict(df.dtypes)[column].startswith("struct")
    log, line = (F.col(f"{column}.path"), F.col(f"{column}.seq")) if many else (F.lit(""), F.col(column))
    return df.withColumn(column, F.struct(F.lit(age).alias("age"), log.alias("path"), line.cast("long").alias("seq")))


def from_config(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """What an earlier configuration says, as generate would: the base of an update."""
    variants = R.config_tasks(spark, config).select("file", "shader_type", "entry", "defines", F.col("seq").alias("first_seen"))
    warnings = R.config_baseline(spark, config).select("warning_key", "code", "message", "location", "entry", F.monotonically_increasing_id().alias("seq"))
    failed = [(str(k), str(t)) for k, texts in (config.get("errors") or {}).items() for t in (texts if isinstance(texts, list) else [texts])]
    return {"variants": variants, "warnings": warnings, "errors": spark.createDataFrame(failed, "error_key string, error_text string")}


def upsert(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A second log on top of a first: variants last wins at their first place, facts are united.

    A variant's list is replaced only by a list of another set.
    """
    v = _placed(old["variants"], "first_seen", 0).unionByName(_placed(new["variants"], "first_seen", 1))
    merged = V.last_change(v.withColumnRenamed("first_seen", "at"), ["file", "shader_type", "entry"], "defines", "at")
    w = _placed(old["warnings"], "seq", 0).unionByName(_placed(new["warnings"], "seq", 1))
    hits = w.groupBy("warning_key", "location", "entry").agg(F.min_by(F.struct("code", "message"), "seq").alias("d"), F.min("seq").alias("seq"))
    return {
        "variants": merged,
        "warnings": hits.select("warning_key", "d.code", "d.message", "location", "entry", "seq"),
        "errors": old["errors"].unionByName(new["errors"]).distinct(),
    }


def config_text(found: dict[str, DataFrame]) -> str:
    return reports.yaml_text(reports.config_document(found["variants"], found["warnings"], found["errors"]))


@dataclass
class Verdict:
    new: DataFrame
    all_warnings: DataFrame
    errors: DataFrame
    counts: DataFrame
    summary: DataFrame
    baseline: DataFrame


def diagnose(results: DataFrame, baseline: DataFrame, max_warnings: int = 0, suppress: list[str] | None = None) -> Verdict:
    """New warnings, errors and the exit code of compile results against a baseline."""
    parsed = checkpoint(D.parse(results))
    every = checkpoint(D.warnings(parsed, baseline, suppress))
    new, errors = D.new_warnings(every), D.errors(parsed)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = (
        one(baseline.select("warning_key", "location").distinct(), "baseline_count")
        .crossJoin(one(new.select("warning_key", "location", "shader_type", "entry"), "new_count"))
        .crossJoin(one(every.select("warning_key", "location").distinct(), "observed"))
        .crossJoin(D.error_counts(errors).withColumnRenamed("error_count", "errors"))
        .crossJoin(D.suppressed_count(parsed, suppress or []))
    )
    return Verdict(new, every, errors, D.gate(counts, F.lit(max_warnings), observed="observed"), D.warning_file_summary(baseline, new), baseline)


def planned(tasks: DataFrame, files: DataFrame, changed: DataFrame | None = None, only: str | None = None, compiler_present: bool = True, output_present: bool = True) -> tuple[DataFrame, bool]:
    """(tasks with error_msg, nothing to do): what a configuration asks to compile in a tree of (path, content).

    only: the variants of one file. changed: the tasks that changed files reach; not looked at with `only`.
    Tasks whose error_msg is not null fail their checks and are not run.
    """
    nothing = False
    if only is not None:
        tasks = R.only_file(tasks, only)
        nothing = tasks.isEmpty()
    elif changed is not None:
        tasks, nothing = G.incremental_tasks(tasks, files.select("path"), G.include_edges(files), changed)
    return R.validated(tasks, files.select("path"), compiler_present, output_present), nothing


def compiled(tasks: DataFrame, make: Make, run: Run = run_command) -> DataFrame:
    """Results of planned tasks, in a checkpoint so that no task is compiled twice; failed checks are failed results."""
    done = compile_tasks(tasks.where("error_msg is null"), make, run)
    failed = tasks.where("error_msg is not null").select("seq", "file", "entry", F.col("shader_type").alias("type"), F.col("error_msg").alias("log"), F.lit(False).alias("success"), F.array().cast("array<string>").alias("cmd"))
    return checkpoint(done.unionByName(failed))


def scan(files: DataFrame, excluded: tuple[str, ...] = schemas.EXCLUDED_DIRS) -> dict[str, DataFrame]:
    """Registers, conflicts and layout links of a source tree's (path, content)."""
    shaders = R.select_sources(files, excluded=excluded)
    found = checkpoint(S.bindings(R.with_combos(shaders)))
    merged = S.registers(found)
    layouts = S.layouts(R.select_sources(files, (".cpp", ".h", ".hpp", ".hlsl", ".hlsli"), excluded))
    linked = checkpoint(K.link(layouts))
    units = merged.select(F.lower("path").alias("unit"), "register", "feature", F.explode("combos").alias("combo"))
    return {
        "registers": K.attach(S.report_rows(merged), linked),
        "unit_conflicts": S.conflicts_by_unit(units, ["unit", "combo"], "register", "feature"),
        "combo_conflicts": S.conflicts_by_combo(units, "register", "combo"),
        "layouts": layouts,
        "links": linked,
    }

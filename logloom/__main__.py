"""Command line: generate (log -> configuration), compile (configuration -> verdict), diagnose (results -> verdict), affected, scan (tree -> Markdown)."""

from __future__ import annotations

import argparse
import shutil
import sys
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from logloom import schemas
from logloom.functions import columns as C
from logloom.operators import includes as G
from logloom.operators import linkage as K
from logloom.operators import sources_code as S
from logloom.operators.compile_exec import Run, command, run_command
from logloom.plans import flows, reports
from logloom.session import workers_can_import
from logloom.sources import files as R


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logloom", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    g = sub.add_parser("generate", help="compile log to configuration")
    g.add_argument("log")
    g.add_argument("output")
    g.add_argument("--large", action="store_true", help="split the log over tasks")
    g.add_argument("--update", action="store_true", help="put the log on top of the configuration in OUTPUT")
    c = sub.add_parser("compile", help="compile the tasks of a configuration and judge the diagnostics")
    c.add_argument("config")
    c.add_argument("tree", help="folder of the sources, shared by all workers")
    c.add_argument("output", help="folder of the compiled files, shared by all workers")
    c.add_argument("--compiler", default="fxc.exe")
    c.add_argument("--changed", help="only tasks that these paths reach: comma separated, or @file")
    c.add_argument("--only", help="only the variants of this file")
    c.add_argument("--max-warnings", type=int, default=0)
    c.add_argument("--suppress", default="", help="warning codes, comma separated")
    c.add_argument("--strip-debug", action="store_true", help="drop debug defines")
    c.add_argument("--debug-defines", default=",".join(schemas.DEBUG_DEFINES), help="names that --strip-debug drops")
    c.add_argument("--level", type=int, help="optimisation level (default 1, with --strip-debug 3)")
    c.add_argument("--partial-precision", action="store_true")
    d = sub.add_parser("diagnose", help="compile results (JSON lines) against the baseline of a configuration")
    d.add_argument("results")
    d.add_argument("config")
    d.add_argument("--max-warnings", type=int, default=0)
    d.add_argument("--suppress", default="", help="warning codes, comma separated")
    d.add_argument("--issues", help="file for the new-issues report")
    a = sub.add_parser("affected", help="tasks of a configuration that changed files reach")
    a.add_argument("config")
    a.add_argument("tree")
    a.add_argument("changed", help="paths, comma separated, or @file")
    s = sub.add_parser("scan", help="register and layout report of a source tree")
    s.add_argument("tree")
    s.add_argument("--conflicts", action="store_true")
    s.add_argument("--only-matched", action="store_true")
    s.add_argument("--show-top-candidate", action="store_true", help="show the fields of rejected best candidates too")
    return top


def _codes(text: str) -> list[str]:
    return [c.strip() for c in text.split(",") if c.strip()]


def _ignored(root: str) -> tuple[str, ...]:
    ignore = Path(root) / ".gitignore"
    return R.excluded_dirs(ignore.read_text(encoding="utf-8", errors="replace") if ignore.is_file() else "")


def _judge(spark: SparkSession, results: DataFrame, config: dict, args: argparse.Namespace, issues: str | None) -> int:
    verdict = flows.diagnose(results, R.config_baseline(spark, config), args.max_warnings, _codes(args.suppress))
    if issues:
        lines = R.lines_of(results, "log", "seq", "file", "entry")
        Path(issues).write_text("\n".join(reports.issue_log(verdict.new, verdict.errors, lines)) + "\n", encoding="utf-8")
    for line in reports.verdict_report(verdict.new, verdict.errors, verdict.baseline, verdict.summary, verdict.counts, args.max_warnings):
        print(line)
    counts = verdict.counts.first()
    print(reports.markdown_table(list(counts.asDict()), [list(counts)]))
    return int(counts["exit_code"])


def _compile(spark: SparkSession, args: argparse.Namespace, run: Run) -> int:
    for path in (args.config, args.tree):
        if not Path(path).exists():
            print(f"not found: {path}", file=sys.stderr)
            return 1
    config = R.load_config(Path(args.config).read_text(encoding="utf-8"))
    Path(args.output).mkdir(parents=True, exist_ok=True)
    tasks = R.config_tasks(spark, config)
    if args.strip_debug:
        tasks = tasks.withColumn("defines", C.strip_defines("defines", _codes(args.debug_defines)))
    files = R.read_tree(spark, args.tree, excluded=())
    changed = R.changed_files(spark, args.changed) if args.changed else None
    present = run is not run_command or shutil.which(args.compiler) is not None
    planned, nothing = flows.planned(tasks, files, changed, args.only, present, True)
    if nothing:
        print(f"no task for {args.only}" if args.only else "no task is affected by the changed files")
        return 1 if args.only else 0
    level = args.level if args.level is not None else 3 if args.strip_debug else 1
    make = partial(command, args.compiler, args.tree.rstrip("/"), args.output.rstrip("/"), level=level, partial=args.partial_precision)
    results = flows.compiled(planned, make, run)
    for r in results.where("size(cmd) = 0").orderBy("seq").toLocalIterator():
        print(f"not compiled: {r['file']} {r['entry']}: {r['log']}", file=sys.stderr)
    return _judge(spark, results, config, args, f"{args.output}/new_issues.log")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, run: Run = run_command) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("logloom").getOrCreate()
    workers_can_import(spark)
    if args.what == "generate":
        if not Path(args.log).exists():
            print(f"no such log: {args.log}", file=sys.stderr)
            return 1
        found = flows.generate(R.read_lines(spark, args.log, dense=not args.large))
        if args.update and Path(args.output).exists():
            found = flows.upsert(flows.from_config(spark, R.load_config(Path(args.output).read_text(encoding="utf-8"))), found)
        Path(args.output).write_text(flows.config_text(found), encoding="utf-8")
        return 0
    if args.what == "compile":
        return _compile(spark, args, run)
    if args.what == "diagnose":
        results = spark.read.schema(schemas.COMPILE_RESULT).json(args.results)
        return _judge(spark, results, R.load_config(Path(args.config).read_text(encoding="utf-8")), args, args.issues)
    files = R.read_tree(spark, args.tree, (".cpp", ".h", ".hpp", ".hlsl", ".hlsli"), _ignored(args.tree))
    if args.what == "affected":
        tasks = R.config_tasks(spark, R.load_config(Path(args.config).read_text(encoding="utf-8")))
        shaders = R.select_sources(files)
        kept, nothing = G.incremental_tasks(tasks, shaders.select("path"), G.include_edges(shaders), R.changed_files(spark, args.changed))
        if not nothing:
            for r in kept.orderBy("file", "entry").toLocalIterator():
                print(r["file"], r["shader_type"], r["entry"], *r["defines"])
        return 0
    found = flows.scan(files, _ignored(args.tree))
    print(reports.register_report(found["registers"].orderBy("register", "name")))
    if args.conflicts:
        print(reports.conflict_report(S.registers(S.bindings(R.with_combos(R.select_sources(files))))))
    print(reports.comparison_report(found["links"], args.only_matched, K.composite_parts(found["layouts"]), K.top_candidates(found["layouts"]), args.show_top_candidate))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""The external compiler as an operator: an injectable command per task, run by Spark's tasks and retries."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from logloom import schemas

Make = Callable[[str, str, str, list[str]], list[str]]
Run = Callable[[list[str]], tuple[str, bool]]
EXTENSIONS = {"VSHADER": "vso", "PSHADER": "pso", "CSHADER": "cso"}
PROFILES = {"VSHADER": "vs_5_0", "PSHADER": "ps_5_0", "CSHADER": "cs_5_0"}


def command(compiler: str, root: str, out: str, file: str, kind: str, entry: str, defines: list[str], level: int = 1, partial: bool = False) -> list[str]:
    """Arguments for one task; the output is <out>/<file stem>/<last part of the entry>.<extension>."""
    stem = file.rpartition("/")[2].rpartition(".")[0]
    target = f"{out}/{stem}/{entry.rpartition(':')[2]}.{EXTENSIONS.get(kind, 'bin')}"
    return [compiler, "-nologo", "-E", "main", "-T", PROFILES.get(kind, "lib"), f"-O{level}", *(["-Gfp"] if partial else []), "-I", root, f"{root}/{file}", *[x for d in defines for x in ("-D", d)], "-Fo", target]


def run_command(args: list[str], timeout: float = 600) -> tuple[str, bool]:
    try:
        done = subprocess.run(args, capture_output=True, text=True, errors="replace", timeout=timeout)
        return done.stdout + done.stderr, done.returncode == 0
    except (OSError, subprocess.TimeoutExpired) as problem:
        return str(problem), False


def compile_tasks(tasks: DataFrame, make: Make, run: Run = run_command) -> DataFrame:
    """Compile results of tasks (seq, file, shader_type, entry, defines); seq keeps the order of the tasks."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part.itertuples(index=False):
                args = make(t.file, t.shader_type, t.entry, list(t.defines))
                log, success = run(args)
                rows.append((t.seq, t.file, t.entry, t.shader_type, log, success, args))
            yield pd.DataFrame(rows, columns=["seq", "file", "entry", "type", "log", "success", "cmd"])

    return tasks.select("seq", "file", "shader_type", "entry", "defines").mapInPandas(each, schemas.COMPILE_RESULT)

import random

import pytest
import yaml
from pyspark.sql import functions as F

from logloom.__main__ import main
from logloom.operators import lifecycle as L
from logloom.operators import variants as V
from logloom.plans import flows, reports
from logloom.sources import files as R


def lines(spark, rows, path=None):
    df = spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")
    return df if path is None else df.withColumn("path", F.lit(path))


def compiling(t, pid, path, entry, defines):
    return f"[00:00:{t:06.3f}] [{pid}] [D] Compiling {path} {entry} to {defines}"


def random_log(rng):
    log = []
    for n in range(1, 120):
        pid, entry, t = rng.randint(1, 2), f"e{rng.randint(1, 2)}:Pixel:{rng.randint(0, 1)}", n / 10
        what = rng.random()
        if what < 0.35:
            log.append(compiling(t, pid, f"d/Shaders/f{rng.randint(1, 2)}.hlsl", entry, "A B"))
        elif what < 0.6:
            log.append(f"[00:00:{t:06.3f}] [{pid}] [D] Compiled shader {entry}")
        elif what < 0.9:
            log += [f"[00:00:{t:06.3f}] [{pid}] [D] Shader logs:", f"f.hlsl({rng.randint(1, 5)}): warning X{rng.randint(1, 2)}: m", ""]
        else:
            log += [f"[00:00:{t:06.3f}] [{pid}] [E] Failed to compile Pixel shader e1::0:", f"f.hlsl({n}): error X9: bad"]
    return log


def rows(df, columns):
    return {tuple(map(str, r)) for r in df.select(*columns).collect()}


def test_several_logs_equal_the_logs_run_apart(spark):
    rng = random.Random(4)
    logs = {f"/l/{k}.log": random_log(rng) for k in "ab"}
    apart = [flows.generate(lines(spark, log)) for log in logs.values()]
    both = flows.generate(lines(spark, logs["/l/a.log"], "/l/a.log").unionByName(lines(spark, logs["/l/b.log"], "/l/b.log")).repartition(5))
    for name, columns in (("tasks", ["seq", "process_id", "entry_point", "start_ms", "end_ms"]), ("warnings", ["warning_key", "location", "entry"]), ("errors", ["error_key", "error_text"])):
        assert rows(both[name], columns) == rows(apart[0][name], columns) | rows(apart[1][name], columns), name
    assert apart[0]["warnings"].count() and apart[0]["errors"].count()
    # the last log wins, and the document can be written
    document = reports.config_document(both["variants"], both["warnings"], both["errors"])
    assert yaml.safe_load(reports.yaml_text(document)) == document


def test_a_block_belongs_to_its_own_log(spark):
    a = [compiling(1, 1, "x/Shaders/a.hlsl", "m:Pixel:1", "A"), "[00:00:02.000] [1] [D] Shader logs:", "a.hlsl(1): warning X1: m"]
    b = [compiling(1, 2, "x/Shaders/b.hlsl", "n:Pixel:2", "A"), "[00:00:02.000] [2] [D] Shader logs:", "b.hlsl(1): warning X2: m"]
    found = flows.generate(lines(spark, a, "a").unionByName(lines(spark, b, "b")))["warnings"].collect()
    assert {(w.warning_key, w.entry) for w in found} == {("x1:m", "m:Pixel:1"), ("x2:m", "n:Pixel:2")}


@pytest.mark.parametrize("span", [1, 40, 5000])
def test_as_of_equals_brute_force(spark, span):
    rng = random.Random(span)
    intervals = [(rng.choice("ab"), s := rng.randint(0, span), None if rng.random() < 0.1 else s + rng.randint(0, span // 3 + 1), n) for n in range(150)]
    points = [(rng.choice("abc"), rng.randint(0, span + 5), n) for n in range(300)]
    got = L.as_of(spark.createDataFrame(points, "k string, t long, id long"), spark.createDataFrame(intervals, "k string, s long, e long, q long"), "k", "t", "id", "s", "e", "q")
    want = {}
    for k, t, n in points:
        held = [q for key, s, e, q in intervals if key == k and s <= t and (e is None or e >= t)]
        if held:
            want[n] = max(held)
    assert {r.id: r.interval.q for r in got.collect()} == want


def test_a_list_of_the_same_set_does_not_replace_the_first(spark):
    df = spark.createDataFrame([("k", ["A", "B"], 1), ("k", ["C"], 2), ("k", ["A", "B", "B"], 3), ("k", ["B", "A"], 4)], "k string, v array<string>, at int")
    r = V.last_change(df, ["k"], "v", "at").first()
    assert (r.v, r.first_seen) == (["A", "B", "B"], 1)


def test_update_puts_a_log_on_top_of_a_configuration(spark, tmp_path):
    out = tmp_path / "c.yaml"
    first, second = tmp_path / "1.log", tmp_path / "2.log"
    first.write_text("\n".join([compiling(1, 1, "x/Shaders/a.hlsl", "m:Pixel:1", "X Y"), "[00:00:01.100] [1] [D] Shader logs:", "a.hlsl(1): warning X1: m"]))
    second.write_text("\n".join([compiling(1, 1, "x/Shaders/a.hlsl", "m:Pixel:1", "Y Z"), compiling(2, 1, "x/Shaders/b.hlsl", "n:Vertex:1", "Q"), "[00:00:02.100] [1] [D] Shader logs:", "b.hlsl(2): warning X2: m"]))
    assert main(["generate", str(first), str(out)], spark) == 0 and main(["generate", str(second), str(out), "--update"], spark) == 0
    config = yaml.safe_load(out.read_text())
    tasks = {r.entry: r.defines for r in R.config_tasks(spark, config).collect()}
    assert tasks == {"m:Pixel:1": ["Y", "Z"], "n:Vertex:1": ["Q"]} and set(config["warnings"]) == {"x1:m", "x2:m"}


def test_list_order_of_the_document(spark):
    df = spark.createDataFrame([(["A"],)] * 2 + [(["B", "C"],)] * 2 + [(["D"],)] * 3 + [(["E"],)], "v array<string>")
    assert [r.v for r in reports.shared_lists(df, "v").collect()] == [["D"], ["B", "C"], ["A"]]


def test_large_reader_parts_two_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("\n".join(f"{name} {i}" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = [(r.path[-5:], r.line) for r in R.read_lines(spark, str(tmp_path), dense=False).orderBy("path", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(f"{n}.log", f"{n} {i}") for n in "ab" for i in range(60_000)]

import random

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.operators import diagnostics as D
from logloom.operators.compile_exec import command, compile_tasks, run_command
from logloom.plans import flows, reports


def results(spark, logs):
    rows = [(i, f"src/{f}", e, t, log, True, []) for i, (f, e, t, log) in enumerate(logs)]
    return spark.createDataFrame(rows, schemas.COMPILE_RESULT)


def baseline(spark, rows):
    return spark.createDataFrame([(k, "X", "m", place, e, e is None) for k, place, e in rows], schemas.BASELINE)


W = "test.hlsl({}): warning X1234: Test warning"
KEY = "x1234:test warning"


def new_locations(spark, logs, base, **more):
    v = flows.diagnose(results(spark, logs), baseline(spark, base), **more)
    return sorted(r.location for r in v.new.collect()), v


def test_new_without_baseline(spark):
    got, v = new_locations(spark, [("test.hlsl", "main", "PSHADER", W.format(10))], [])
    assert got == ["test.hlsl:10"] and v.new.first().warning_key == KEY


def test_suppressed(spark):
    got, v = new_locations(spark, [("test.hlsl", "main", "PSHADER", W.format(10))], [], suppress=["x1234"])
    assert got == [] and v.all_warnings.count() == 0 and v.counts.first().suppressed == 1


def test_legacy_baseline_list(spark):
    base = [(KEY, "test.hlsl:10", None), (KEY, "test.hlsl:20", None)]
    assert new_locations(spark, [("test.hlsl", "m", "P", W.format(10))], base)[0] == []
    assert new_locations(spark, [("test.hlsl", "m", "P", W.format(10) + "\n" + W.format(30))], base)[0] == ["test.hlsl:30"]


def test_malformed_line(spark):
    assert new_locations(spark, [("t.hlsl", "m", "P", "test.hlsl(10): warning X1234 no colon")], [])[0] == []


def test_line_shift_is_not_new(spark):
    assert new_locations(spark, [("t", "E", "P", W.format(53))], [(KEY, "src/test.hlsl:50", "e")])[0] == []
    base = [(KEY, "test.hlsl:50", "E"), (KEY, "test.hlsl:60", "E")]
    assert new_locations(spark, [("t", "E", "P", "\n".join(W.format(n) for n in (50, 60, 70)))], base)[0] == ["test.hlsl:70"]


def test_errors(spark):
    log = "test.hlsl(5): error X1: a\ntest.hlsl(5): error X2: b\ntest.hlsl(5): error X1: a\ntest.hlsl(6): error X1: a"
    _, v = new_locations(spark, [("test.hlsl", "GetDisplacedPosition", "V", log)], [])
    got = v.errors.collect()
    assert {(e.shader_key, e.location, e.code) for e in got} == {("test.hlsl:getdisplacedposition", "test.hlsl:5", "X1"), ("test.hlsl:getdisplacedposition", "test.hlsl:5", "X2"), ("test.hlsl:getdisplacedposition", "test.hlsl:6", "X1")}
    assert (v.counts.first().errors, v.counts.first().error_count_ref, v.counts.first().exit_code) == (3, 3, 1)


def test_file_summary(spark):
    base = baseline(spark, [("a", "water.hlsl:1050,2-73", "main:1234"), ("b", "lighting.hlsl:200,5", "main:5678")])
    new = spark.createDataFrame([("water.hlsl:1050,2-73", "main:1234"), ("water.hlsl:1050,2-73", "main:5678"), ("effects.hlsl:50,10", "main:9012")], "location string, entry string")
    assert {tuple(r) for r in D.warning_file_summary(base, new).collect()} == {("water.hlsl", 1, 1, 3), ("effects.hlsl", 0, 1, 1)}
    assert D.warning_file_summary(base, base).count() == 0
    mixed = spark.createDataFrame([("Water.hlsl:1050,2-73", "main:1234")], "location string, entry string")
    assert D.warning_file_summary(base, mixed).count() == 1 and D.warning_file_summary(base, mixed, fold_case=True).count() == 0


@pytest.mark.parametrize("base,new,errors,limit,want", [(0, 3, 0, 5, 0), (5, 1, 0, -2, 1), (2, 1, 0, -10, 1), (0, 0, 0, -5, 0), (1, 0, 0, -10, 1), (0, 0, 2, 9, 1), (0, 6, 0, 5, 1)])
def test_gate(spark, base, new, errors, limit, want):
    df = spark.createDataFrame([(base, new, errors, 0)], "baseline_count int, new_count int, errors int, observed int")
    got = D.gate(df, F.lit(limit), observed="observed").first()
    assert got.exit_code == want and (errors or limit >= 0 or got.exit_intent == 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_new_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: [(f"k{rng.randint(1, 4)}", rng.choice("aAbB"), f"l{rng.randint(1, 6)}") for _ in range(n)]
    old, legacy, now = pick(12), {"k4"}, pick(80)
    old = [(k, None if k in legacy else e, p) for k, e, p in old if k != "k3"]
    base = spark.createDataFrame([(k, e, p, e is None) for k, e, p in old], "k string, e string, p string, legacy boolean")
    current = spark.createDataFrame([(i, *r) for i, r in enumerate(now)], "i int, k string, e string, p string").repartition(4)
    got = {r.i: r.is_new for r in D.running_new(current, base, "k", "e", "p", "i", "legacy").collect()}
    seen: dict = {}
    for i, (k, e, p) in enumerate(now):
        places = seen.setdefault((k, e.lower()), set())
        places.add(p)
        mine = [x for x in old if x[0] == k]
        if not mine:
            want = True
        elif k in legacy:
            places |= {x[2] for x in mine}
            want = len(places) > len(mine)
        else:
            want = len(places) > len({x[2] for x in mine if x[1].lower() == e.lower()})
        assert got[i] == want, (i, k, e, p)


def test_issue_log(spark):
    v = flows.diagnose(results(spark, [("t.hlsl", "m", "P", f"one\ntwo\n{W.format(3)}\nthree\nfour\nt.hlsl(9): error X9: bad")]), baseline(spark, []))
    lines = spark.createDataFrame([("m", i, x) for i, x in enumerate(["one", "two", W.format(3), "three", "four", "five"])], "entry string, line_no int, line string")
    text = list(reports.issue_log(v.new, v.errors, lines))
    assert any(t.startswith("ERROR X9") for t in text) and "    one" in text and "    four" in text and "    five" not in text
    assert text.index("WARNING X1234: Test warning (1 combinations)") > next(i for i, t in enumerate(text) if t.startswith("ERROR"))


def test_compile_operator(spark):
    tasks = spark.createDataFrame([(1, "a/Sky.hlsl", "PSHADER", "main:pixel:1F", ["A=1"]), (2, "b.hlsl", "VSHADER", "v", [])], "seq long, file string, shader_type string, entry string, defines array<string>")
    fake = lambda args: (f"b.hlsl(1): warning X1: {len(args)}", "-D" in args)
    got = {r.seq: r for r in compile_tasks(tasks, lambda f, t, e, d: command("fxc", "src", "out", f, t, e, d), fake).collect()}
    assert got[1].cmd[-1] == "out/Sky/1F.pso" and got[1].success and not got[2].success
    assert run_command(["/no/such/compiler"])[1] is False and run_command(["true"]) == ("", True)
    assert D.parse(spark.createDataFrame(list(got.values()))).count() == 2


def test_windows_over_chunks_equal_brute_force(spark):
    rng = random.Random(9)
    at = sorted(rng.sample(range(1 << 19), 500))
    df = spark.createDataFrame([(t, float(rng.randint(0, 9))) for t in at], "at long, v double").repartition(6)
    rows = sorted((r["at"], r.v) for r in df.collect())
    got = {r["at"]: r.in_window for r in D.sliding_count(df, F.col("at"), 5000).collect()}
    assert got == {t: sum(t - 5000 <= x <= t for x in at) for t in at}
    got = {r["at"]: r.average for r in D.moving_average(df, "v", "at", n=10, block=32).collect()}
    for i, (t, _) in enumerate(rows):
        part = [v for _, v in rows[max(0, i - 9) : i + 1]]
        assert abs(got[t] - sum(part) / len(part)) < 1e-9


def test_instance_counts(spark):
    hits = spark.createDataFrame([("k", "a", "x"), ("k", "a", "y"), ("k", "b", None), ("j", "a", "x"), ("k", "a", "x")], "warning_key string, location string, entry string")
    assert [tuple(r) for r in D.instance_counts(hits).collect()] == [("k", 2, 3), ("j", 1, 1)]

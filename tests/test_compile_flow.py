import difflib
import random

import pytest
import yaml
from pyspark.sql import functions as F

from compare import SF
from logloom import schemas
from logloom.__main__ import main
from logloom.functions.similarity import name_similarity
from logloom.operators import diagnostics as D
from logloom.operators import includes as G
from logloom.operators import linkage as K
from logloom.operators import sources_code as S
from logloom.plans import bridge, flows, reports

CONFIG = {
    "shaders": [
        {"file": "a.hlsl", "configs": {"PSHADER": {"common_defines": ["A=1"], "entries": [{"entry": "main:pixel:1", "defines": ["DEBUG"]}, {"entry": "main:pixel:2", "defines": []}]}}},
        {"file": "b.hlsl", "configs": {"VSHADER": {"entries": [{"entry": "main:vertex:3", "defines": ["bad define"]}]}}},
        {"file": "gone.hlsl", "configs": {"VSHADER": {"entries": [{"entry": "main:vertex:4", "defines": []}]}}},
    ],
    "warnings": {"x1:old": {"code": "X1", "message": "old", "instances": {"a.hlsl:1": {"entries": ["main:pixel:1", "main:pixel:2"]}}}},
}


@pytest.fixture
def project(tmp_path):
    tree = tmp_path / "Shaders"
    tree.mkdir()
    (tree / "a.hlsl").write_text('#include "c.hlsli"\n')
    (tree / "b.hlsl").write_text("// b\n")
    (tree / "c.hlsli").write_text("// c\n")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(CONFIG))
    return tmp_path


def compiler(text):
    return lambda args: (text, True)


def run(spark, project, *more, text=""):
    argv = ["compile", str(project / "c.yaml"), str(project / "Shaders"), str(project / "out"), *more]
    return main(argv, spark, compiler(text))


def test_compile_judges_new_warnings(spark, project, capsys):
    new = "one\na.hlsl(7): warning X2: fresh\ntwo"
    assert run(spark, project, text=new) == 1
    shown = capsys.readouterr()
    assert "1. X2: fresh" in shown.out and "Impact: 1 occurrences across 2 shader variants (100.0%)" in shown.out and "TOO MANY NEW WARNINGS: 2 exceed the limit of 0" in shown.out
    assert "gone.hlsl main:vertex:4: file not found" in shown.err and "b.hlsl main:vertex:3: bad define" in shown.err
    issues = (project / "out" / "new_issues.log").read_text()
    assert "WARNING X2: fresh (2 combinations)" in issues and "    one" in issues and "    two" in issues
    assert run(spark, project, "--max-warnings", "5", text=new) == 0
    assert run(spark, project, text="a.hlsl(9): warning X1: old") == 0
    assert run(spark, project, "--suppress", "X2", text=new) == 0
    assert run(spark, project, text="a.hlsl(1): error X9: bad") == 1
    assert run(spark, project, "--max-warnings", "-1", text=new) == 1
    assert "TOO FEW WARNINGS REMOVED" in capsys.readouterr().out


def test_compile_of_some_tasks(spark, project, capsys):
    assert run(spark, project, "--changed", "b.hlsl", text="a.hlsl(7): warning X2: fresh") == 0
    assert run(spark, project, "--changed", "c.hlsli", text="a.hlsl(7): warning X2: fresh") == 1
    assert run(spark, project, "--only", "any/where/a.hlsl", text="a.hlsl(7): warning X2: fresh") == 1
    assert run(spark, project, "--only", "none.hlsl") == 1
    (project / "Shaders" / "lone.hlsli").write_text("// lone\n")
    assert run(spark, project, "--changed", "lone.hlsli") == 0 and "no task is affected" in capsys.readouterr().out
    assert main(["compile", str(project / "none.yaml"), str(project / "Shaders"), str(project / "out")], spark, compiler("")) == 1


def test_compile_arguments(spark, project):
    tasks = spark.createDataFrame([(0, "a.hlsl", "PSHADER", "m:pixel:1", ["A"])], "seq long, file string, shader_type string, entry string, defines array<string>")
    files = spark.createDataFrame([("a.hlsl", "")], "path string, content string")
    planned, nothing = flows.planned(tasks, files, compiler_present=False)
    assert not nothing and planned.first().error_msg == "compiler not found"
    results = flows.compiled(planned, lambda f, t, e, d: ["never"], compiler("")).first()
    assert (results.success, results.log, results.cmd) == (False, "compiler not found", [])


def hits(spark, rows):
    return spark.createDataFrame([(k, k.upper(), "m", place, e, i) for i, (k, place, e) in enumerate(rows)], "warning_key string, code string, message string, location string, entry string, seq long")


def test_ranked_warnings(spark):
    found = hits(spark, [("a", f"f:{n}", e) for n in range(5) for e in "xyz"] + [("b", "g:1", "x"), ("b", "g:1", "x"), ("c", "g:1", "y"), ("c", "g:2", "y")])
    got = D.ranked_warnings(D.by_place(found), "instances", 2).collect()
    assert [(r.warning_key, r.instances, r.combinations, round(r.percent, 1)) for r in got] == [("a", 5, 15, 62.5), ("c", 2, 2, 25.0)]
    assert [(s.location, s.entries, s.more) for s in got[0].samples] == [("f:0", ["x", "y"], 1), ("f:1", ["x", "y"], 1), ("f:2", ["x", "y"], 1)]


def test_report_sections(spark):
    logs = [(0, "a.hlsl", "e0", "P", "\n".join(f"f{n}.hlsl({k}): warning X{n}: m" for n in range(12) for k in range(n + 1)), True, [])]
    results = spark.createDataFrame(logs, schemas.COMPILE_RESULT)
    base = spark.createDataFrame([(f"y{n}:m", f"Y{n}", "m", f"g.hlsl:{k}", e, False) for n in range(7) for k in range(2) for e in "abcdefgh"[: n + 1]], schemas.BASELINE)
    v = flows.diagnose(results, base, -3)
    text = list(reports.verdict_report(v.new, v.errors, v.baseline, v.summary, v.counts, -3))
    assert text[0].startswith("78 new warnings") and text[1].startswith("f11.hlsl: 12 new issues") and "...and 2 more kinds" in text
    assert "1. X11: m" in text and "10. X2: m" in text and "11. X1: m" not in text and "   Location: ...and 9 more locations" in text
    last = text[text.index(next(t for t in text if t.startswith("TOO FEW"))) :]
    assert [t for t in last if t[:1].isdigit()] == [f"{i}. Y{n}: m" for i, n in enumerate((6, 5, 4, 3, 2), 1)]
    v = flows.diagnose(results, base, 5)
    text = list(reports.verdict_report(v.new, v.errors, v.baseline, v.summary, v.counts, 5))
    assert [t for t in text[text.index("TOO MANY NEW WARNINGS: 78 exceed the limit of 5") :] if t[:1].isdigit()] == ["1. X11: m", "2. X10: m", "3. X9: m"]


def test_reachable_follows_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(45, 0)], "src int, dst int")
    assert G.reachable(edges, spark.createDataFrame([(0,)], "path int")).count() == 46


def test_a_layout_of_itself_ends_where_the_cycle_closes(spark):
    f = lambda n, t: (n, t, 4, 1, False, None)
    rows = [("shader", "Loop", [f("a", "Loop"), f("b", "Loop"), f("c", "Loop")], "f", 1), ("shader", "P", [f("q", "Q")], "f", 2), ("shader", "Q", [f("p", "P"), f("x", "float")], "f", 3)]
    deep = [("shader", f"D{n}", [f("v", "float"), f("d", f"D{n + 1}")], "f", 10 + n) for n in range(20)]
    df = spark.createDataFrame(rows + deep, f"language string, name string, fields array<{schemas.FIELD}>, file string, line int")
    flat = {r.name: [x.name for x in r.flat] for r in K.flatten(df).collect()}
    assert flat["Loop"] == ["a", "b", "c"] and flat["P"] == ["p", "x"] and flat["D0"] == ["v"] * 20 + ["d"]


@pytest.mark.parametrize("text,defines,want", [("1<<99999999999999999999", {}, False), ("9**9**9**9", {}, False), ("1<<9999999999", {}, False), ("0 && 1/0", {}, False), ("1 || 1/0", {}, True), ("A+1==3", {"A": "B", "B": "2"}, True), ("A", {"A": "B", "B": "A"}, False), ("7 % -4 == 3", {}, True), ("2+3*4 == 14 && !0", {}, True), ("1 2", {}, False), ("", {}, False), ("F(1)", {"F": "x"}, False), ("~0 == -1", {}, True), ("defined A && !defined(B)", {"A": ""}, True)])
def test_conditions_are_bounded(text, defines, want):
    assert S.holds(text, defines) is want


def test_line_directives_and_inner_records():
    import re

    assert [n for n, _ in S.matches_with_lines(re.compile(r"x\d"), 'x1\n#line 100 "f"\nx2\n\nx3')] == [1, 100, 102]
    found = {s["name"]: [f["name"] for f in s["fields"]] for s in S.host_layouts("/* struct No { int a; }; */ struct M { int a; void f() { x; } struct In { float b; } in; DirectX::XMFLOAT4X4 c[2]; };")}
    assert found == {"M": ["a", "c[2]"], "In": ["b"]}
    assert S.bindings_in("Texture2D<float4> a : register(t3); cbuffer B : register(c5)") == [("a", "Texture2D<float4>", "float4", "t", 3)]


def test_alignment_refuses_what_is_no_layout():
    for bad in (None, [], {"name": "a"}, {"fields": []}):
        with pytest.raises(TypeError):
            K.align(bad, {"name": "a", "fields": []})


def slow_blocks(a, b):
    """Lengths of the matching blocks: the longest common run, the first one in a, then in b, and both sides of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    return n and n + slow_blocks(a[:i], b[:j]) + slow_blocks(a[i + n :], b[j + n :])


def slow_similarity(a, b):
    a, b = a.lower(), b.lower()
    strip = lambda s: s[: s.index("[")] if s.endswith("]") and "[" in s else s
    both = lambda x, y: max(2 * slow_blocks(x, y) / (len(x) + len(y)) if x or y else 1.0, slow_blocks(x, y) / max(len(x), len(y), 1))
    whole, bare = both(a, b), both(strip(a), strip(b))
    short, long = sorted((strip(a), strip(b)), key=len)
    if short in long:
        return max(whole, bare, 0.9 if long and len(short) >= 0.7 * len(long) else 0.85)
    return max(whole, bare - 0.01)


def test_name_similarity_equals_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abAB_1", k=rng.randint(0, 9))) + rng.choice(["", "", "[4]"]) for _ in range(40)]
    assert all(abs(name_similarity(a, b) - slow_similarity(a, b)) < 1e-9 for a in names for b in names)
    assert all(abs(r.score - slow_similarity(r.a, r.b)) < 1e-5 for r in bridge.b34_name_similarity(spark, SF).limit(400).collect())
    assert difflib.SequenceMatcher(None, "ab", "b").ratio() == pytest.approx(2 * slow_blocks("ab", "b") / 3)


def test_greedy_alignment_equals_brute_force(spark):
    lists = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), "[^A-Za-z0-9]+")).alias("w")).distinct().collect():
        lists.setdefault(r.p_brand, set()).add(r.w)
    got = {(r.a, r.b): r for r in bridge.b35_greedy_alignment(spark, SF).collect()}
    assert len(got) == len(lists) * (len(lists) - 1) // 2
    for a, b in sorted(got)[:12]:
        left, right = sorted(lists[a]), sorted(lists[b])
        used, pairs = set(), []
        for i, x in enumerate(left):
            scores = [(slow_similarity(x, y), -j) for j, y in enumerate(right) if j not in used]
            best, j = max(scores, default=(0, 0))
            if best >= 0.7:
                used.add(-j)
                pairs.append((i, -j))
        # pairs that cross an earlier one are not shown
        shown, i, j, rest = 0, 0, 0, list(pairs)
        rows = K.merge(len(left), len(right), rest)
        shown = sum(x is not None and y is not None for x, y in rows)
        assert got[a, b].matches == shown and got[a, b].missing == len([x for k, x in enumerate(left) if not K.is_padding(x)]) - len([k for k, _ in rows if k is not None and not K.is_padding(left[k])])

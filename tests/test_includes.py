import random

import pytest

from logloom.operators import includes as G
from logloom.sources import files as R

TREE = {
    "Lighting.hlsl": '#include "Common/BRDF.hlsli"\n',
    "Water.hlsl": '  #  include "Common/Math.hlsli"\n#include <system.h>\n',
    "Guarded.hlsl": '#ifdef X\n#include "Common/Math.hlsli"\n#endif\n',
    "Common/BRDF.hlsli": '#include "Math.hlsli"\n',
    "Common/Math.hlsli": "",
    "Common/Unused.hlsli": "// none\n",
    "Feature/FooCS.hlsl": '#include "Local.hlsli"\n#include "../../outside.hlsli"\n#include "missing.hlsli"\n',
    "Feature/Local.hlsli": "",
    "Standalone.hlsl": "",
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(list(TREE.items()), "path string, content string").cache()
    return files, G.include_edges(files).cache()


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


@pytest.mark.parametrize("changed,want", [("Common/Math.hlsli", {"Common/Math.hlsli", "Common/BRDF.hlsli", "Lighting.hlsl", "Water.hlsl", "Guarded.hlsl"}), ("Feature/Local.hlsli", {"Feature/Local.hlsli", "Feature/FooCS.hlsl"}), ("Standalone.hlsl", {"Standalone.hlsl"}), ("not/there.hlsl", {"not/there.hlsl"})])
def test_affected(spark, tree, changed, want):
    assert {r.path for r in G.affected(tree[1], paths(spark, changed)).collect()} == want


def test_edges(tree):
    assert {tuple(e) for e in tree[1].collect()} == {("Lighting.hlsl", "Common/BRDF.hlsli"), ("Water.hlsl", "Common/Math.hlsli"), ("Guarded.hlsl", "Common/Math.hlsli"), ("Common/BRDF.hlsli", "Common/Math.hlsli"), ("Feature/FooCS.hlsl", "Feature/Local.hlsli")}


def test_incremental_tasks(spark, tree):
    files, edges = tree
    tasks = spark.createDataFrame([("Lighting.hlsl",), ("./Water.hlsl",), ("Standalone.hlsl",)], "file string")
    run = lambda *changed: G.incremental_tasks(tasks, files.select("path"), edges, paths(spark, *changed))
    kept, nothing = run(r"Common\Math.hlsli")
    assert ({r.file for r in kept.collect()}, nothing) == ({"Lighting.hlsl", "./Water.hlsl"}, False)
    kept, nothing = run("unknown.hlsl")
    assert (kept.count(), nothing) == (3, False)
    kept, nothing = run("Common/Unused.hlsli")
    assert (kept.count(), nothing) == (0, True)


def test_same_name_beside_goes_first(spark):
    files = spark.createDataFrame([("a/x.hlsl", '#include "c.hlsli"'), ("a/c.hlsli", ""), ("c.hlsli", "")], "path string, content string")
    assert [e.dst for e in G.include_edges(files).collect()] == ["a/c.hlsli"]


def test_invert(spark, tree):
    got = {r.path: r.users for r in G.invert(tree[0], tree[1]).collect()}
    assert got["Common/Math.hlsli"] == ["Common/BRDF.hlsli", "Guarded.hlsl", "Water.hlsl"] and got["Standalone.hlsl"] == [] and len(got) == len(TREE)


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_equals_brute_force_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(35)] + [(1, 2), (2, 1)]
    want, todo = {1, 99}, [1, 99]
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in want:
                want.add(b)
                todo.append(b)
    got = G.reachable(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(1,), (99,)], "path int"))
    assert {r.path for r in got.collect()} == want


def test_changed_list(spark, tmp_path):
    assert [r.path for r in R.changed_files(spark, "Lighting.hlsl, Water.hlsl ,").collect()] == ["Lighting.hlsl", "Water.hlsl"]
    (tmp_path / "l.txt").write_text("a.hlsl\n\n b.hlsl \n")
    assert {r.path for r in R.changed_files(spark, f"@{tmp_path}/l.txt").collect()} == {"a.hlsl", "b.hlsl"}
    assert R.changed_files(spark, "@/no/such/list").count() == 0 and R.changed_files(spark, None).count() == 0


def test_validation(spark):
    nodes = paths(spark, "a.hlsl", "b.HLSL", "c.txt")
    tasks = spark.createDataFrame([("a.hlsl", ["A=1"]), ("a.hlsl", ["1x"]), ("b.HLSL", []), ("d.hlsl", [])], "file string, defines array<string>")
    assert {(r.file, r.error_msg) for r in R.validated(tasks, nodes).collect()} == {("a.hlsl", None), ("a.hlsl", "bad define"), ("b.HLSL", "not a shader file"), ("d.hlsl", "file not found")}


def test_tree_reader(spark, tmp_path):
    for p, text in {"Shaders/a b+c.HLSL": "x", "build/no.hlsl": "n", "src/s.cpp": "y", "src/t.md": "z", "my/extern/e.hlsl": "n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    assert {tuple(r) for r in R.read_tree(spark, str(tmp_path)).collect()} == {("Shaders/a b+c.HLSL", "x")}
    assert {r.path for r in R.read_tree(spark, str(tmp_path), (".hlsl", ".cpp")).collect()} == {"Shaders/a b+c.HLSL", "src/s.cpp"}
    assert R.excluded_dirs("# no/\nout/\n*.o\n/gen/\n") == ("build", "extern", "gen", "include", "out", "tools")

import random

import pytest
import yaml

from logloom.operators import lifecycle as L
from logloom.operators import variants as V
from logloom.plans import flows, reports
from logloom.sources import files as R

SKY = "VSHADER A=1 B=2 WATER_EFFECTS WATER_EFFECTS IBL"


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")


def compiling(t, pid, path, entry, defines):
    return f"[00:00:{t:06.3f}] [{pid}] [D] Compiling {path} {entry} to {defines}"


def done(t, pid, entry, words="Compiled shader"):
    return f"[00:00:{t:06.3f}] [{pid}] [D] {words} {entry}"


def test_warning_is_attributed_to_its_task(spark):
    log = [compiling(10.539, 35768, "Data/Shaders/Sky.hlsl", "Sky:Vertex:0", SKY), "[00:00:10.540] [35768] [D] Shader logs:", "Data/Shaders/Sky.hlsl(10): warning X3206: implicit truncation", "Data/Shaders/Sky.hlsl(11): error X1000: syntax error", done(10.541, 35768, "Sky:Vertex:0")]
    found = flows.generate(lines(spark, log))
    v = found["variants"].first()
    assert (v.file, v.shader_type, v.entry) == ("Sky.hlsl", "VSHADER", "Sky:Vertex:0") and v.defines == sorted(SKY.split())
    w = found["warnings"].collect()
    assert [(x.warning_key, x.location, x.entry) for x in w] == [("x3206:implicit truncation", "sky.hlsl:10", "Sky:Vertex:0")]
    assert found["errors"].count() == 0


def test_backslash_path_in_warning(spark):
    log = [compiling(1, 7, "x/Shaders/G.hlsl", "G:Pixel:1", "P"), "[00:00:01.000] [7] [D] Shader logs:", r"GrassCollision\GrassCollision.hlsli(52,3): warning X4000: m"]
    assert flows.generate(lines(spark, log))["warnings"].first().location == "grasscollision/grasscollision.hlsli:52,3"


@pytest.mark.parametrize("log", [[], ["[invalid log line]"]])
def test_nothing_in_nothing_out(spark, log):
    found = flows.generate(lines(spark, log))
    assert all(found[k].count() == 0 for k in ("tasks", "variants", "warnings", "errors"))


def test_line_counts(spark):
    log = lines(spark, ["a [D] Compiling x", "b [D] Compiling y", "c", "[D] Compiling z", "Shader logs:"])
    assert R.count_if(log, "line", ["[D] Compiling"], "n").first().n == 3
    assert R.count_if(log, "line", ["[D] Compiling", "Shader logs:"], "n").first().n == 4


def test_two_line_errors(spark):
    log = [compiling(1, 7, "x/Shaders/m.hlsl", "main:Pixel:5678", "P"), "[00:00:02.000] [7] [E] Failed to compile Pixel shader main::5678:", "shader.hlsl(10): error X1234: Some error message", "[00:00:03.000] [7] [W] Shader compilation failed:", "other.hlsl:3:4: X9: bad"]
    got = sorted((r.error_key, r.error_text) for r in flows.generate(lines(spark, log))["errors"].collect())
    assert got == [("m.hlsl:main:Pixel:5678", "X1234: Some error message (shader.hlsl:10)"), ("m.hlsl:main:Pixel:5678", "X9: bad (other.hlsl:3:4)")]


def brute_tasks(events):
    tasks = []
    for seq, kind, pid, entry, ms in events:
        if kind == 1:
            tasks.append([seq, pid, entry, ms, None])
        else:
            for t in reversed(tasks):
                if t[1] == pid and t[2] == entry and t[4] is None:
                    t[4] = ms
                    break
    return tasks


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    log, events, blocks = [], [], []
    for n in range(1, 400):
        pid, entry, t = rng.randint(1, 3), f"e{rng.randint(1, 3)}:{rng.choice(['Pixel', 'Vertex'])}:{rng.randint(0, 1)}", n / 10
        what = rng.random()
        if what < 0.4:
            log.append(compiling(t, pid, f"d/Shaders/f{rng.randint(1, 2)}.hlsl", entry, f"A={rng.randint(0, 2)} B"))
            events.append((len(log), 1, pid, entry, round(t * 1000)))
        elif what < 0.7:
            log.append(done(t, pid, entry, rng.choice(["Compiled shader", "Adding Completed shader to map:"])))
            events.append((len(log), -1, pid, entry, round(t * 1000)))
        else:
            log.append(f"[00:00:{t:06.3f}] [{pid}] [D] Shader logs:")
            blocks.append((len(log), pid, round(t * 1000)))
            for _ in range(rng.randint(0, 2)):
                log.append(f"  f.hlsl({rng.randint(1, 9)}): warning X{rng.randint(1, 2)}: m")
            if rng.random() < 0.5:
                log += ["", "f.hlsl(99): warning X9: outside"]
    df = lines(spark, log).repartition(5)
    tasks = brute_tasks(events)
    got = sorted((t.seq, int(t.process_id), t.entry_point, t.start_ms, t.end_ms) for t in L.log_tasks(df).collect())
    assert got == sorted(map(tuple, tasks))
    want = set()
    for n, pid, ms in blocks:
        owner = next((t for t in reversed(tasks) if t[1] == pid and t[3] <= ms and (t[4] is None or t[4] >= ms)), None)
        for line in log[n:]:
            if not line.strip() or line.startswith("["):
                break
            if owner:
                place, code = line.strip().split("): warning ")
                want.add((f"{code.split(':')[0].lower()}:m", place.replace("(", ":"), owner[2]))
    assert {(w.warning_key, w.location, w.entry) for w in L.log_warnings(df, L.log_tasks(df)).collect()} == want


def variants(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, shader_type string, entry string, defines array<string>, first_seen long")


def test_three_levels(spark):
    found = variants(spark, [("test.hlsl", "PSHADER", "main:1234", ["A=1", "B=2"]), ("test.hlsl", "PSHADER", "main:5678", ["A=1", "C=3"]), ("test.hlsl", "VSHADER", "main:9012", ["A=1", "D=4"])])
    common = V.common_defines(found)
    assert {(r.level, r.file, r.shader_type, r.define) for r in common.collect()} == {("all", None, None, "A=1"), ("kind", None, "VSHADER", "D=4")}
    assert {r.entry: r.defines for r in V.residual_defines(found, common).collect()} == {"main:1234": ["B=2"], "main:5678": ["C=3"], "main:9012": []}


def test_last_variant_wins(spark):
    log = [compiling(1, 1, "Shaders/a.hlsl", "m:Pixel:1", "X"), compiling(2, 1, "Shaders/a.hlsl", "n:Pixel:1", "Y"), compiling(3, 1, "Shaders/a.hlsl", "m:Pixel:1", "Z X")]
    got = {v.entry: (v.defines, v.first_seen) for v in flows.generate(lines(spark, log))["variants"].collect()}
    assert got == {"m:Pixel:1": (["X", "Z"], 1), "n:Pixel:1": (["Y"], 2)}


def test_document_is_ordered_shares_lists_and_reloads(spark):
    found = variants(spark, [("z.hlsl", "PSHADER", "main", ["Z=1", "S=1"]), ("z.hlsl", "PSHADER", "main2", ["A=1", "S=1"]), ("z.hlsl", "PSHADER", "alpha", ["B=1", "S=1"]), ("a.hlsl", "VSHADER", "v", ["S=1"])])
    warn = spark.createDataFrame([("x1:m", "X1", "m", "a.hlsl:1", "v", 1), ("x1:m", "X1", "m", "z.hlsl:2", "v", 2)], "warning_key string, code string, message string, location string, entry string, seq long")
    fail = spark.createDataFrame([("a:b", "t")], "error_key string, error_text string")
    document = reports.config_document(found, warn, fail)
    assert list(document["file_common_defines"]) == ["a.hlsl", "z.hlsl"] and document["common_defines"] == ["S=1"]
    assert [e["entry"] for e in document["shaders"][1]["configs"]["PSHADER"]["entries"]] == ["alpha", "main", "main2"]
    text = reports.yaml_text(document)
    assert "&" in text and "*" in text and yaml.safe_load(text) == document
    tasks = {r.entry: r.defines for r in R.config_tasks(spark, yaml.safe_load(text)).collect()}
    assert tasks["main"] == ["S=1", "Z=1"] and tasks["v"] == ["S=1"]
    base = R.config_baseline(spark, yaml.safe_load(text)).collect()
    assert {(b.location, b.entry, b.legacy) for b in base} == {("a.hlsl:1", "v", False), ("z.hlsl:2", "v", False)}


def test_config_shapes(spark):
    assert R.config_tasks(spark, {}).count() == 0
    odd = {"shaders": [{"file": "a"}, {"file": "b", "configs": {"P": 3, "V": {"entries": [{"entry": "e", "defines": "x"}]}}}], "warnings": {"X:y": {"instances": ["a:1", "a:2"]}}}
    assert [(t.file, t.entry, t.defines) for t in R.config_tasks(spark, odd).collect()] == [("b", "e", [])]
    assert {(b.warning_key, b.location, b.entry, b.legacy) for b in R.config_baseline(spark, odd).collect()} == {("x:y", "a:1", None, True), ("x:y", "a:2", None, True)}


def test_upsert_of_a_second_log(spark):
    first = flows.generate(lines(spark, [compiling(1, 1, "Shaders/a.hlsl", "m:Pixel:1", "X")]))
    second = flows.generate(lines(spark, [compiling(1, 1, "Shaders/a.hlsl", "m:Pixel:1", "Y"), compiling(2, 1, "Shaders/b.hlsl", "n:Pixel:1", "Q")]))
    merged = flows.upsert(first, second)
    assert {v.entry: v.defines for v in merged["variants"].collect()} == {"m:Pixel:1": ["Y"], "n:Pixel:1": ["Q"]}


def test_list_statistics(spark):
    df = spark.createDataFrame([(["A=1", "B=2"],)] * 3 + [(["C"],)], "v array<string>")
    assert tuple(V.list_statistics(df, "v").first()) == (4, 2, 1, 2, 3)


def test_large_reader_keeps_the_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(f"line {i}" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = [r.line for r in R.read_lines(spark, str(path), dense=False).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(200_000)]
    small = R.read_lines(spark, str(path)).where("line_no <= 2").collect()
    assert [(r.line_no, r.line) for r in small] == [(1, "line 0"), (2, "line 1")]


def test_chunks_of_a_long_log_change_nothing(spark, monkeypatch):
    log = []
    for n in range(1, 60):
        log += [compiling(n / 10, 7, "Shaders/a.hlsl", f"e:Pixel:{n % 3}", "A"), f"[00:00:{n / 10:06.3f}] [7] [D] Shader logs:", f"a.hlsl({n}): warning X1: m", f"a.hlsl({n}): warning X2: m", "", "a.hlsl(1): warning X3: out", f"[00:00:{n / 10:06.3f}] [7] [E] Failed to compile Pixel shader e::{n % 3}:", f"a.hlsl({n}): error X9: bad"]
    df = lines(spark, log)
    whole = {k: sorted(map(str, v.collect())) for k, v in flows.generate(df).items()}
    monkeypatch.setattr(L, "CHUNK_BITS", 2)
    parts = {k: sorted(map(str, v.collect())) for k, v in flows.generate(df).items()}
    assert whole == parts and len(whole["warnings"]) > 100 and whole["errors"]

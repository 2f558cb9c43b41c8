import random

import pytest

from logloom import schemas
from logloom.__main__ import main
from logloom.operators import linkage as K
from logloom.operators import sources_code as S
from logloom.plans import flows, reports
from logloom.sources import files as R

SHADER = """// comment
struct Light { float4 position; float3 color; };
cbuffer PerFrame : register(b1)
{
    float4x4 viewMatrix[2]; // views
    Light lights;
    float intensity;
}
#ifdef VR
Texture2D<half2> eye : register(t3);
#endif
#if defined(PSHADER) && !defined(VR)
ConstantBuffer<Light> lit : register(b0);
#else
SamplerState smp : register(s0);
#endif
cbuffer Same : register(b4) { float x; }
cbuffer Line : register(b7)
StructuredBuffer<Boned> bones : register(t10);
struct VS_INPUT { float a; };
struct float4 { float q; };
"""
HOST = """
struct Light { XMFLOAT4 p0; float3 color; static int n; };
struct alignas(16) PerFrameData { float4x4 viewMatrix[2]; Light lights; float intensity; };
struct Pointer { Foo* p; };
struct Statics { static int a; };
struct LightData { float4 position; float3 color; };
"""


def field(name, kind="float4", size=16):
    return {"name": name, "type": kind, "size": size}


def test_members():
    assert S.parse_member("float4 position", False) == {"name": "position", "type": "float4", "size": 16, "array_size": 1, "is_unknown_type": False, "packoffset": None}
    for host in (False, True):
        m = S.parse_member("float3 colors[8]", host)
        assert (m["name"], m["size"], m["array_size"]) == ("colors[8]", 96, 8)
    m = S.parse_member("float2 offset : packoffset(c0.x)", False)
    assert (m["size"], m["packoffset"]) == (8, "c0.x")
    assert S.parse_member("row_major float4x4 m[2][3]", False)["size"] == 384 and S.parse_member("}", True) is None


def test_shader_layouts():
    found = {s["name"]: s for s in S.shader_layouts(SHADER)}
    assert [f["name"] for f in found["PerFrame"]["fields"]] == ["viewMatrix[2]", "lights", "intensity"]
    assert (found["PerFrame"]["line"], found["PerFrame"]["is_cbuffer"], found["PerFrame"]["size"]) == (3, True, 128 + 16 + 16)
    assert found["Boned"]["is_template"] and found["bones"]["template_type"] == "Boned" and "float4" not in found


def test_host_layouts():
    found = {s["name"]: s for s in S.host_layouts(HOST)}
    assert set(found) == {"Light", "PerFrameData", "LightData"} and found["PerFrameData"]["line"] == 3
    assert [f["name"] for f in found["Light"]["fields"]] == ["p0", "color"]


@pytest.mark.parametrize("text,defines,want", [("#if A > 1 && (B || !C)\nx\n#elif 0x10 == 16\ny\n#else\nz\n#endif", {"A": "2", "B": "1"}, "x"), ("#if A\nx\n#elif 0x10 == 16\ny\n#else\nz\n#endif", {}, "y"), ("#ifndef Q\n#define Q 3\n#if Q == 3\nx\n#endif\n#undef Q\n#endif\n#ifdef Q\ny\n#else\nz\n#endif", {}, "xz"), ("#if (\nx\n#endif\ny", {}, "y"), ("#ifdef A\n#ifdef B\nx\n#else\ny\n#endif\n#endif", {}, "")])
def test_conditions(text, defines, want):
    assert "".join(line for _, line in S.active_lines(text, defines)) == want


def test_registers_and_conflicts(spark):
    files = spark.createDataFrame([("features/Grass/Shaders/x.hlsl", SHADER), ("y.hlsl", "Texture2D a : register(t3);\nTexture2D b : register(T3);\nTexture2D c : register(t3);\n")], "path string, content string")
    merged = S.registers(S.bindings(R.with_combos(files))).collect()
    by = {(r.path, r.name): r for r in merged}
    eye, lit, smp = (by["features/Grass/Shaders/x.hlsl", n] for n in ("eye", "lit", "smp"))
    assert (eye.register, eye.register_type, eye.template_type, eye.feature, eye.line) == ("t3", "SRV", "half2", "Grass", 10)
    assert (eye.pshader, eye.vshader, eye.vr, eye.combos) == (True, True, True, ["PSHADER_VR", "VSHADER_VR"])
    assert (lit.combos, lit.template_type) == (["PSHADER"], "Light") and smp.combos == ["PSHADER_VR", "VSHADER", "VSHADER_VR"]
    assert ("features/Grass/Shaders/x.hlsl", "Same") not in by and by["features/Grass/Shaders/x.hlsl", "Line"].register == "b7"
    found = flows.scan(files)
    assert {(r.register, r.combo, r.uses) for r in found["combo_conflicts"].collect()} == {("t3", "PSHADER", 2), ("t3", "PSHADER_VR", 3), ("t3", "VSHADER", 2), ("t3", "VSHADER_VR", 3)}
    assert found["unit_conflicts"].count() == 0


def test_alignment():
    same = {"name": "A", "fields": [field("position"), field("color", "float3", 12)]}
    r = K.align(same, dict(same))
    assert r["score"] > 0.8 and r["exact_matches"] == 2 and r["field_matches"] == 2 and r["field_diff_count"] == 0
    far = K.align({"name": "completely", "fields": [field("different", "float", 4)]}, {"name": "totally", "fields": [field("unrelated", "double", 8)]})
    assert far["score"] < 0.5
    pairs = K.greedy_pairs([field(n) for n in ("position", "color", "normal")], [field(n) for n in ("pos", "colour", "normal")], 0.5)
    assert (2, 2) in pairs
    assert not {0, 1} & {i for i, _ in K.greedy_pairs([field("position"), field("color"), field("normal")], [field("pos"), field("colour"), field("normal")], 1.0)}


def test_crossed_pairs_are_skipped_but_scored():
    a, b = [field("alpha"), field("bravo")], [field("bravo"), field("alpha")]
    assert K.greedy_pairs(a, b) == [(0, 1), (1, 0)] and K.merge(2, 2, [(0, 1), (1, 0)]) == []
    r = K.align({"name": "S", "fields": a}, {"name": "S", "fields": b})
    assert r["field_matches"] == 0 and r["missing_fields"] == 2 and abs(r["score"] - (0.6 * (0.5 + 0.5 * 0.9) + 0.2)) < 1e-9


def test_alignment_bounds():
    rng = random.Random(1)
    for _ in range(100):
        make = lambda: {"name": rng.choice(["A", "Light", "Lights"]), "fields": [field(rng.choice(["pos", "position", "pad0", "color", "colour[2]"]), rng.choice(["float4", "float[4]", "bool"]), rng.choice([4, 16])) for _ in range(rng.randint(0, 5))]}
        r = K.align(make(), make())
        assert 0 <= r["score"] <= 1 and r["exact_matches"] + r["high_sim_matches"] <= r["field_matches"]


def test_padding_twins(spark):
    from pyspark.sql import functions as F

    from logloom.functions import columns as C

    names = ["pad", "_pad0", "padding", "xpad", "pad[2]", "spade", "x_padding", "_padding", "PADX", "paddy", "apa"]
    got = {r.n: r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", C.is_padding(F.col("n")).alias("p")).collect()}
    assert got == {n: K.is_padding(n.lower()) for n in names}


def test_flatten_order_and_cycles(spark):
    f = lambda n, t: (n, t, 4, 1, False, None)
    rows = [("shader", "A", [f("x", "B"), f("y", "float"), f("z", "C")], "f", 1), ("shader", "B", [f("b1", "C"), f("b2", "float")], "f", 2), ("shader", "C", [f("c1", "float"), f("c2", "float")], "g", 1), ("shader", "C", [f("other", "float")], "h", 1), ("host", "C", [f("host", "float")], "a", 1), ("shader", "Loop", [f("me", "Loop")], "f", 9)]
    df = spark.createDataFrame(rows, f"language string, name string, fields array<{schemas.FIELD}>, file string, line int")
    flat = {(r.name, r.file): [x.name for x in r.flat] for r in K.flatten(df).collect()}
    assert flat["A", "f"] == ["c1", "c2", "b2", "y", "c1", "c2"] and flat["Loop", "f"] == ["me"]


def test_linkage(spark):
    files = spark.createDataFrame([("x.hlsl", SHADER), ("x.h", HOST)], "path string, content string")
    found = flows.scan(files)
    links = {(r.shader_name): r for r in found["links"].collect()}
    assert links["Light"].host_name == "LightData" and links["Light"].status == "Matched"
    assert links["PerFrame"].host_name == "PerFrameData" and links["PerFrame"].accepted
    assert {r.status: r.n for r in K.status_counts(found["links"]).collect()}["Matched"] >= 1
    shown = {r.name: r.analysis for r in found["registers"].collect()}
    assert shown["lit"].startswith("[Matched](#") and shown["smp"] == "Unmatched"
    assert [(p.parent, p.part, p.place) for p in K.composite_parts(found["layouts"]).collect()] == [("PerFrame", "Light", 1)]
    top = K.top_candidates(found["layouts"], 2).where("shader_name = 'Light'").orderBy("rank").collect()
    assert [t.rank for t in top] == [1, 2] and top[0].host_name == "LightData" and top[0].score >= top[1].score
    assert [(r.line, r.found) for r in S.line_matches(files.where("path = 'x.hlsl'"), r"cbuffer (\w+)", 1).orderBy("line").collect()][0] == (3, "PerFrame")
    assert "Holds: Light" in reports.comparison_report(found["links"], parts=K.composite_parts(found["layouts"]))
    text = reports.comparison_report(found["links"]) + reports.register_report(found["registers"])
    assert "## Light" in text and "|t10|" in text and text.index("|t10|") < text.index("|t3|")
    assert "Register Conflicts" in reports.conflict_report(S.registers(S.bindings(R.with_combos(files.where("path = 'x.hlsl'")))))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "Shaders").mkdir()
    (tmp_path / "Shaders" / "x.hlsl").write_text(SHADER)
    (tmp_path / "x.h").write_text(HOST)
    log = tmp_path / "c.log"
    log.write_text("[00:00:01.000] [7] [D] Compiling Data/Shaders/x.hlsl x:Pixel:1 to A=1 B\n[00:00:01.100] [7] [D] Shader logs:\nData/Shaders/x.hlsl(10): warning X3206: w\n")
    out = tmp_path / "c.yaml"
    assert main(["generate", str(log), str(out)], spark) == 0 and "x3206:w" in out.read_text()
    assert main(["generate", str(tmp_path / "none.log"), str(out)], spark) == 1
    (tmp_path / "r.json").write_text('{"seq": 1, "file": "x.hlsl", "entry": "x:Pixel:1", "type": "PSHADER", "log": "Data/Shaders/x.hlsl(12): warning X3206: w", "success": true, "cmd": []}\n')
    assert main(["diagnose", str(tmp_path / "r.json"), str(out), "--issues", str(tmp_path / "n.log")], spark) == 0
    assert main(["affected", str(out), str(tmp_path), "Shaders/x.hlsl"], spark) == 0
    assert main(["scan", str(tmp_path), "--conflicts"], spark) == 0
    assert "PerFrame" in capsys.readouterr().out

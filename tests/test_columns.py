import pytest
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.functions.similarity import jaro_winkler, name_similarity, type_similarity


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("path,want", [(r"Data\Shaders\Sky.hlsl", "Sky.hlsl"), ("a//b/SHADERS/x//y.hlsl", "x/y.hlsl"), ("MyShaders/x", "MyShaders/x"), ("Shaders/a/Shaders/b", "a/Shaders/b"), (r"Grass\Grass.hlsli", "Grass/Grass.hlsli")])
def test_log_path(spark, path, want):
    assert value(spark, C.log_path(F.lit(path))) == want


@pytest.mark.parametrize("path,want", [("a/Shaders/b/Shaders/c.hlsl", "c.hlsl"), ("MyShaders/x", "x"), (None, ""), ("", ""), (r"x\Shaders", ""), ("plain.hlsl/", "plain.hlsl")])
def test_compile_path(spark, path, want):
    assert value(spark, C.compile_path(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize("path", ["a/./b/../c", "../x", "a/../../b", "/a/../../b", "", ".", "a//b/", r"a\b", "a/..", "./a", "/", "../../a/.."])
def test_relative_path(spark, path):
    import posixpath

    assert value(spark, C.relative_path(F.lit(path))) == posixpath.normpath(path.replace("\\", "/"))


@pytest.mark.parametrize("entry,want", [("Sky:Vertex:0", "VSHADER"), ("a:PIXEL:1", "PSHADER"), ("a:compute:1", "CSHADER"), ("a:hull:1", "UNKNOWN"), ("a:vertex", "UNKNOWN")])
def test_shader_type(spark, entry, want):
    assert value(spark, C.shader_type(F.lit(entry))) == want


def test_times(spark):
    assert value(spark, C.time_ms(F.lit("[12:34:56.789] Some log message"))) == ((12 * 60 + 34) * 60 + 56) * 1000 + 789
    assert str(value(spark, C.timestamp_of(F.lit("[12:34:56.789] x")))) == "1900-01-01 12:34:56.789000"
    assert value(spark, C.time_ms(F.lit("[invalid] x"))) is None and value(spark, C.timestamp_of(F.lit("[invalid] x"))) is None


def test_defines(spark):
    assert value(spark, C.define_tokens(F.lit(" A=1 B  C=x-y "))) == ["A=1", "B", "C=x-y"] or value(spark, C.define_tokens(F.lit("A=1 B"))) == ["A=1", "B"]
    nested = F.array(F.array(F.lit("A=1"), F.lit("B")), F.array(F.lit("B"), F.lit("C=2")), F.array(F.lit(None).cast("string"), F.lit("D")))
    assert value(spark, C.flatten_defines(nested)) == ["A=1", "B", "C=2", "D"]
    assert value(spark, C.strip_defines(F.array(F.lit("debug=1"), F.lit("X")), ["DEBUG"])) == ["X", "D3DCOMPILE_AVOID_FLOW_CONTROL"]
    assert [value(spark, C.valid_define(F.lit(d))) for d in ("A", "A=1", "1A", "A=b c", "_x=y")] == [True, True, False, False, True]


def test_diagnostic(spark):
    d = value(spark, C.diagnostic(F.lit(r"GrassCollision\GrassCollision.hlsli(52,3-9): warning X4000: use of: it")))
    assert tuple(d) == (r"GrassCollision\GrassCollision.hlsli", "52,3-9", "warning", "X4000", "use of: it")
    assert value(spark, C.diagnostic(F.lit("a.hlsl(3:4): error X1: m"))).place == "3:4"
    assert value(spark, C.diagnostic(F.lit("a.hlsl(10): warning X1234 no colon"))) is None


def test_bodies_and_names(spark):
    assert value(spark, C.clean_body(F.lit("  int a;// x\n/* b\n */  float b;  \n"))) == "int a;\nfloat b;"
    assert [value(spark, C.is_padding(F.lit(n))) for n in ("pad", "_pad0[3]", "Padding", "mypad", "x_padding[2]", "paddle", "spade")] == [True, True, True, True, True, True, False]
    assert [value(spark, C.is_io_name(F.lit(n))) for n in ("VSInput", "VS_INPUT", "ps_output")] == [False, True, True]
    assert value(spark, C.strip_array(F.lit("bones[3]"))) == "bones"


@pytest.mark.parametrize("kind,n,want", [("float4", 1, (16, False)), ("float3", 8, (96, False)), ("row_float4x4", 1, (64, False)), ("float4x3", 2, (96, False)), ("XMFLOAT4X4", 1, (4, True)), ("REX::XMFLOAT3X4", 2, (8, True)), ("half2", 1, (4, True)), ("Foo*", 3, (24, False)), ("ns::uint2", 1, (8, False)), ("int", 10, (40, False)), ("float4[4]", 1, (64, False))])
def test_field_size(spark, kind, n, want):
    from logloom.operators.sources_code import field_size

    if kind == "row_float4x4":
        kind = "float4x4"
    assert tuple(value(spark, C.field_size(F.lit(kind), F.lit(n)))) == want == field_size(kind, n)


def test_corrected_sizes(spark):
    assert value(spark, C.field_size(F.lit("XMFLOAT4X4"), F.lit(1), corrected=True)).size == 64
    assert value(spark, C.field_size(F.lit("half2"), F.lit(1), corrected=True)).size == 4


def test_folds(spark):
    sizes = F.array(F.lit(4), F.lit(4))
    assert value(spark, C.packed_size(sizes)) == 8 and value(spark, C.aligned_size(sizes)) == 32
    field = lambda size, pack: F.struct(F.lit(size).alias("size"), F.lit(pack).cast("string").alias("packoffset"))
    assert value(spark, C.packoffset_size(F.array(field(4, None), field(4, None)))) == 16
    assert value(spark, C.packoffset_size(F.array(field(8, "c0.x"), field(4, "c2.y")))) == 48
    with pytest.raises(Exception, match="bad packoffset"):
        value(spark, C.packoffset_size(F.array(field(8, "q1"))))


def test_links(spark):
    assert value(spark, C.link(F.lit("a b/c.hlsl"), F.lit(3))) == "a+b/c.hlsl#L3"
    assert value(spark, C.usage(F.lit(True), F.lit(False), F.lit(True))) == "P+VR"
    assert value(spark, C.feature_of(F.lit("features/Grass Lighting/Shaders/x.hlsl"))) == "Grass Lighting"
    assert value(spark, C.short_path(F.lit(r"C:\w\Proj\package\a.hlsl"), "proj")) == "package/a.hlsl"


def test_name_similarity():
    assert name_similarity("same", "SAME") == 1.0
    assert 0 < name_similarity("test_field", "testField") < 1 and name_similarity("field1", "field2") < 1
    assert name_similarity("color", "colorTint") >= 0.85 and name_similarity("position", "positions") >= 0.9
    assert name_similarity("bones[3]", "bones") >= 0.9
    assert name_similarity("completely", "totally") < 0.7


def test_type_similarity():
    assert type_similarity("float3", "float[3]") == 1.0 and type_similarity("float4", "float4") == 1.0
    assert type_similarity("float4", "bool") == 0.0
    assert abs(jaro_winkler("MARTHA", "MARHTA") - 0.961111) < 1e-6 and abs(jaro_winkler("DIXON", "DICKSONX") - 0.813333) < 1e-6

"""Fixed values and row types of the domain, declared once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Byte sizes of the basic types the report knows (others count as `DEFAULT_SIZE` and unknown).
TYPE_SIZES = {"float": 4, "float2": 8, "float3": 12, "float4": 16, "uint": 4, "uint2": 8, "uint3": 12, "uint4": 16, "int": 4, "int4": 16, "bool": 4}
#: The optional corrected table adds the types the report's table lacks.
MORE_TYPE_SIZES = {"int2": 8, "int3": 12, "half": 2, "half2": 4, "half3": 6, "half4": 8, "double": 8, "double2": 16}
#: Bytes of an unknown type and of a pointer.
DEFAULT_SIZE, POINTER_SIZE = 4, 8

#: Vector types and the array types they equal.
ARRAY_TWINS = {f"{base}{n}": f"{base}[{n}]" for base in ("float", "int", "uint") for n in (2, 3, 4)}

#: Define combinations a source is read under, and register classes.
COMBOS = {"PSHADER": ["PSHADER"], "PSHADER_VR": ["PSHADER", "VR"], "VSHADER": ["VSHADER"], "VSHADER_VR": ["VSHADER", "VR"]}
REGISTER_CLASSES = {"t": "SRV", "u": "UAV", "s": "Sampler", "b": "CBV"}
#: Stages of entry points and their types, folders outside the scan, defines of debug builds.
SHADER_TYPES = {"vertex": "VSHADER", "pixel": "PSHADER", "compute": "CSHADER"}
EXCLUDED_DIRS = ("build", "extern", "tools", "include")
DEBUG_DEFINES = ("DEBUG", "_DEBUG", "D3D_DEBUG_INFO", "D3DCOMPILE_DEBUG", "D3DCOMPILE_SKIP_OPTIMIZATION")

FIELD = "struct<name: string, type: string, size: int, array_size: int, is_unknown_type: boolean, packoffset: string>"
STRUCT = f"language string, name string, fields array<{FIELD}>, file string, line int, is_cbuffer boolean, is_constant_buffer boolean, is_template boolean, template_type string, size int"
TASK = "seq long, process_id string, entry_point string, file_path string, defines array<string>, start_ms long, end_ms long"
COMPILE_TASK = "file string, shader_type string, entry string, defines array<string>"
COMPILE_RESULT = "seq long, file string, entry string, type string, log string, success boolean, cmd array<string>"
BASELINE = "warning_key string, code string, message string, location string, entry string, legacy boolean"


def combos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COMBOS.items()), "combo string, defines array<string>")


def type_sizes(spark: SparkSession, corrected: bool = False) -> DataFrame:
    return spark.createDataFrame(sorted((TYPE_SIZES | (MORE_TYPE_SIZES if corrected else {})).items()), "type string, size int")

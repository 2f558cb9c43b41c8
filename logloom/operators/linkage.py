"""Record linkage of shader and host layouts by fuzzy field alignment.

Every shader layout is scored against every host layout, as the report asks: its second-best score counts, so
no pair may be left out. A pair's fields are matched once, in an Arrow batch, and only its scores leave the
task; the fields side by side are made for the candidates that are shown. The pairs are bounded by the
layouts of a source tree; Spark sends the smaller side to all tasks if its own size check allows it and
forms the product of partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import columns as C
from logloom.functions.similarity import NAME_BOUND, jaro_winkler, name_similarity, type_similarity
from logloom.session import checkpoint


def is_padding(name: str) -> bool:
    base = name.lower().partition("[")[0]
    return base.startswith(("pad", "_pad")) or base.endswith(("pad", "padding"))


def greedy_pairs(shader: list[dict], host: list[dict], bound: float = NAME_BOUND) -> list[tuple[int, int]]:
    """For each shader field in order, the unused host field with the most similar name, the first among equals."""
    free, pairs = dict.fromkeys(range(len(host))), []
    for i, f in enumerate(shader):
        scored = [(name_similarity(f["name"], host[j]["name"]), -j) for j in free]
        best = max(scored, default=(0.0, 0))
        if best[0] >= bound:
            pairs.append((i, -best[1]))
            del free[-best[1]]
    return pairs


def match_score(shader_name: str, host_name: str, n_shader: int, n_host: int, pairs: list[tuple[int, int]], weight: float) -> float:
    """Names and matched share by weight; each step back in the order costs a tenth of the matched part."""
    steps_back = sum(b[0] < a[0] or b[1] < a[1] for a, b in zip(pairs, pairs[1:]))
    matched = len(pairs) / max(n_shader, n_host, 1) * 0.9**steps_back
    return name_similarity(shader_name, host_name) * weight + matched * (1 - weight)


def merge(n_shader: int, n_host: int, pairs: list[tuple[int, int]]) -> list[tuple[int | None, int | None]]:
    """Fields side by side; unmatched ones stand alone. Pairs that cross an earlier one are skipped, as in the report."""
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    rows, i, j, k = [], 0, 0, 0
    while i < n_shader or j < n_host:
        if k < len(pairs) and (i, j) == pairs[k]:
            rows.append((i, j))
            i, j, k = i + 1, j + 1, k + 1
        elif i < n_shader and i not in left:
            rows.append((i, None))
            i += 1
        elif j < n_host and j not in right:
            rows.append((None, j))
            j += 1
        else:
            i, j = i + 1, j + 1
    return rows


def field_differences(rows: list[tuple[dict | None, dict | None]]) -> tuple[int, int, int]:
    """(all, by name, by type); a lone field counts once, as a difference of name and of type."""
    by_name = by_type = total = 0
    for a, b in rows:
        lone = not (a and b)
        name = lone or name_similarity(a["name"], b["name"]) < 1
        kind = lone or not name and jaro_winkler(a["type"], b["type"]) < 0.7
        by_name, by_type, total = by_name + name, by_type + kind, total + (name or kind)
    return total, by_name, by_type


def _checked(layout) -> list[dict]:
    """The fields of a layout; a TypeError for anything else."""
    if not isinstance(layout, dict) or not isinstance(layout.get("name"), str) or not isinstance(layout.get("fields"), (list, tuple)):
        raise TypeError(f"a layout is a dict with a name and fields, not {type(layout).__name__}")
    return list(layout["fields"])


def align(shader: dict, host: dict, weight: float = 0.5, base_weight: float = 0.5) -> dict:
    """Alignment report of two layouts (name, fields); `similarity` is the score under base_weight."""
    a, b = _checked(shader), _checked(host)
    pairs = greedy_pairs(a, b)
    rows = [(None if i is None else a[i], None if j is None else b[j]) for i, j in merge(len(a), len(b), pairs)]
    exact = high = 0
    for x, y in rows:
        if x and y:
            name, kind = name_similarity(x["name"], y["name"]), type_similarity(x["type"], y["type"])
            exact += name == kind == 1
            high += min(name, kind) >= 0.9 and not name == kind == 1
    real = [f for f in a if not is_padding(f["name"])]
    shown = [x for x, _ in rows if x]
    size_a, size_b = (sum(f["size"] for f in fields) for fields in (a, b))
    ratio = min(size_a, size_b) / max(size_a, size_b) if size_a > 0 and size_b > 0 else 0.0
    kinds = (exact + 0.8 * high) / max(1, len(real))
    total, by_name, by_type = field_differences(rows)
    score, similarity = (0.6 * match_score(shader["name"], host["name"], len(a), len(b), pairs, w) + 0.2 * kinds + 0.2 * ratio for w in (weight, base_weight))
    return {
        "similarity": similarity,
        "score": score,
        "name_sim": name_similarity(host["name"], shader["name"]) * weight,
        "type_sim": kinds,
        "size_sim": ratio,
        "exact_matches": exact,
        "high_sim_matches": high,
        "total_fields": len(real),
        "host_total_fields": sum(not is_padding(f["name"]) for f in b),
        "missing_fields": sum(f not in shown for f in real),
        "field_matches": sum(bool(x and y) for x, y in rows),
        "field_diff_count": total,
        "field_name_diff_count": by_name,
        "field_type_diff_count": by_type,
        "size_difference": abs(size_a - size_b),
        "align_matches": [{"shader": x, "host": y} for x, y in rows],
    }


REPORT = (
    "similarity double, score double, name_sim double, type_sim double, size_sim double, exact_matches int, high_sim_matches int, total_fields int, host_total_fields int, missing_fields int, "
    "field_matches int, field_diff_count int, field_name_diff_count int, field_type_diff_count int, size_difference int"
)
CANDIDATE = f"shader_id long, shader_name string, shader_file string, shader_line int, boosted boolean, host_name string, host_file string, host_line int, flattened boolean, {REPORT}"
ALIGNED = f"{CANDIDATE}, place int, rank int, second_score double, align_matches array<struct<shader: {schemas.FIELD}, host: {schemas.FIELD}>>"


def same_fields(host: dict, shader: dict) -> bool:
    """Field equivalence: alike names, equal types, equal size."""
    return name_similarity(shader["name"], host["name"]) >= NAME_BOUND and type_similarity(shader["type"], host["type"]) == 1 and host["size"] == shader["size"]


def flatten(found: DataFrame) -> DataFrame:
    """layouts with `flat`: fields whose type is a layout of the same language replaced by its fields, all levels.

    A definition in the same file goes before the first of another (by file and line). A field whose
    definition is already open on its path stays as it is, so a cycle ends where it closes.
    """
    ids = found.withColumn("id", F.xxhash64("language", "file", "name", "line"))
    ranked = Window.partitionBy("language", "name", "file").orderBy("line")
    first = Window.partitionBy("language", "name").orderBy("file", "line")
    definitions = checkpoint(ids.where(F.size("fields") > 0).withColumn("in_file", F.row_number().over(ranked)).withColumn("overall", F.row_number().over(first)).select("language", "name", "file", "fields", "in_file", "overall"))
    parts = checkpoint(ids.select("id", "language", "name", "file", F.posexplode("fields").alias("p", "field")).select("id", "language", "file", F.array("p").alias("ord"), "field", F.array(F.struct("name", "file")).alias("trail")))
    own = definitions.where("in_file = 1").select(F.col("language").alias("l1"), F.col("name").alias("n1"), F.col("file").alias("f1"), F.col("fields").alias("own_fields"))
    any_ = definitions.where("overall = 1").select(F.col("language").alias("l2"), F.col("name").alias("n2"), F.col("file").alias("f2"), F.col("fields").alias("any_fields"))
    # a trail names each definition once, so there are no more rounds than definitions
    while True:
        met = parts.join(own, (F.col("language") == F.col("l1")) & (F.col("field.type") == F.col("n1")) & (F.col("file") == F.col("f1")), "left")
        met = met.join(any_, (F.col("language") == F.col("l2")) & (F.col("field.type") == F.col("n2")), "left")
        opening = F.struct(F.col("field.type").alias("name"), F.coalesce("f1", "f2").alias("file"))
        inner = F.when(~F.array_contains("trail", opening), F.coalesce("own_fields", "any_fields"))
        if met.where(inner.isNotNull()).isEmpty():
            break
        stays = met.where(inner.isNull()).select(*parts.columns)
        opened = met.where(inner.isNotNull()).select("id", "language", opening["file"].alias("file"), "ord", F.posexplode(inner).alias("p", "inner"), F.concat("trail", F.array(opening)).alias("trail"))
        parts = checkpoint(stays.unionByName(opened.select("id", "language", "file", F.concat("ord", F.array("p")).alias("ord"), F.col("inner").alias("field"), "trail")))
    flat = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]).alias("flat"))
    return ids.join(flat, "id", "left").withColumn("flat", F.coalesce("flat", F.array().cast(f"array<{schemas.FIELD}>")))


def is_composite(found: DataFrame) -> DataFrame:
    """layouts with `composite`: a cbuffer that holds a field of a layout's type."""
    names = found.where("language = 'shader'").select(F.col("name").alias("type")).distinct()
    held = found.where("is_cbuffer").select("id", F.explode("fields.type").alias("type")).join(names, "type", "left_semi").select("id").distinct().withColumn("composite", F.lit(True))
    return found.join(held, "id", "left").withColumn("composite", F.coalesce("composite", F.lit(False)))


def _sides(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shader layouts with fields, and host layouts as written and, if different, flattened.

    A template element takes the fields of its type.
    """
    shaders = found.where("language = 'shader'")
    types = shaders.groupBy(F.col("name").alias("t")).agg(F.min_by("fields", F.struct("file", "line")).alias("type_fields"))
    with_type = shaders.join(types, F.col("template_type") == F.col("t"), "left")
    left = with_type.select(F.col("id").alias("shader_id"), F.col("name").alias("shader_name"), F.col("file").alias("shader_file"), F.col("line").alias("shader_line"), (~F.col("composite")).alias("boosted"), F.when(F.col("composite"), F.col("flat")).otherwise(F.coalesce("type_fields", "fields")).alias("fields"))
    hosts = found.where("language = 'host'")
    versions = F.filter(F.array(F.struct(F.lit(False).alias("flattened"), F.col("fields")), F.when(F.col("flat") != F.col("fields"), F.struct(F.lit(True).alias("flattened"), F.col("flat").alias("fields")))), lambda v: v.isNotNull())
    right = hosts.select(F.col("name").alias("host_name"), F.col("file").alias("host_file"), F.col("line").alias("host_line"), F.explode(versions).alias("v")).select("host_name", "host_file", "host_line", "v.flattened", F.col("v.fields").alias("host_fields"))
    return left.where(F.size("fields") > 0), right.where(F.size("host_fields") > 0)


def _over_pairs(columns: list[str], more: list[str]):
    """Reports of pairs (fields, host_fields): these columns, then the report's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                shader = {"name": r["shader_name"], "fields": [dict(f) for f in r["fields"]]}
                host = {"name": r["host_name"], "fields": [dict(f) for f in r["host_fields"]]}
                report = align(shader, host, 0.7 if len(shader["fields"]) <= 3 else 0.5)
                rows.append([r[c] for c in columns] + [report[c] for c in more])
            yield pd.DataFrame(rows, columns=columns + more)

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def candidates(found: DataFrame) -> DataFrame:
    """Scores of all pairs of a shader layout and a version of a host layout; found has id, flat and composite."""
    left, right = _sides(found)
    report = _names(REPORT)
    return left.crossJoin(right).mapInPandas(_over_pairs([c for c in _names(CANDIDATE) if c not in report], report), CANDIDATE)


def with_fields(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """Ranked candidates with their fields side by side."""
    left, right = _sides(found)
    met = ranked.join(left.select("shader_id", "fields"), "shader_id").join(right.where("host_name is not null"), ["host_name", "host_file", "host_line", "flattened"])
    columns = [*_names(CANDIDATE), "place", "rank", "second_score"]
    return met.select(*columns, "fields", "host_fields").mapInPandas(_over_pairs(columns, ["align_matches"]), ALIGNED)


def best_candidates(scored: DataFrame) -> DataFrame:
    """Candidates with their boosted score, rank, and the gap to the next; rank 1 is the best match.

    Order among equals: file, line, as written before flattened.
    """
    tie = ["host_file", "host_line", "flattened"]
    by = Window.partitionBy("shader_id")
    first = by.orderBy(F.desc("similarity"), *tie)
    ranked = scored.withColumn("place", F.row_number().over(first)).withColumn("next", F.lead("similarity").over(first))
    outlier = (F.col("place") == 1) & (F.col("similarity") > 0.85) & (F.col("next").isNull() | (F.col("similarity") - F.col("next") > 0.2))
    boost = F.when(F.col("boosted") & (F.col("host_name") == F.col("shader_name")), 1.05).otherwise(1.0) * F.when(F.col("boosted") & outlier, 1.05).otherwise(1.0)
    final = by.orderBy(F.desc("score"), "place")
    out = ranked.withColumn("score", F.col("score") * boost)
    return out.withColumn("rank", F.row_number().over(final)).withColumn("second_score", F.lead("score").over(final)).drop("next")


def good_enough(similar_names: Column) -> Column:
    """Acceptance of a best candidate; similar_names is the similarity of the two names. The bounds are fixed values."""
    most, least = F.greatest("total_fields", "host_total_fields"), F.least("total_fields", "host_total_fields")
    ratio = F.when(most > 0, least / most).otherwise(0.0)
    good = F.when(least > 0, (F.col("exact_matches") + F.col("high_sim_matches")) / least).otherwise(0.0)
    close = F.col("second_score").isNotNull() & (F.col("score") - F.col("second_score") < 0.05) & (F.col("score") < 0.6)
    return (
        F.when(F.col("score") < 0.5, False)
        .when(ratio < F.when(most <= 3, 0.4).otherwise(0.6), False)
        .when(good < F.when(least <= 3, 0.3).otherwise(0.5), False)
        .when(similar_names > 0.8, (F.col("score") > 0.4) & (good > 0.2))
        .when(F.col("size_difference") > F.when(most > 5, 128).otherwise(64), False)
        .otherwise(~close)
    )


def status() -> Column:
    ratio = F.col("field_diff_count") / F.greatest(F.lit(1), F.least("total_fields", "host_total_fields"))
    return F.when(~F.col("accepted") | (ratio > 0.5) | (F.col("score") < 0.75), "Unmatched").when(F.col("field_diff_count") == 0, "Matched").otherwise(F.concat(F.lit("Mismatched ("), F.col("host_name"), F.lit(")")))


def link(layouts: DataFrame) -> DataFrame:
    """The best candidate of each shader layout with accepted and status; layouts without candidates are Unmatched."""
    from logloom.functions.similarity import name_similarity_udf

    found = checkpoint(is_composite(flatten(layouts)))
    best = with_fields(best_candidates(candidates(found)).where("rank = 1"), found)
    judged = best.withColumn("accepted", good_enough(name_similarity_udf()("shader_name", "host_name"))).withColumn("status", status())
    # parts of composites and composites themselves are recorded only where they match
    rest = found.where("language = 'shader' and size(flat) > 0 and not composite").select(F.col("id").alias("shader_id"), F.col("name").alias("shader_name"), F.col("file").alias("shader_file"), F.col("line").alias("shader_line"))
    lone = rest.join(judged.select("shader_id"), "shader_id", "left_anti").withColumn("status", F.lit("Unmatched")).withColumn("accepted", F.lit(False))
    return judged.where("boosted or accepted").unionByName(lone, allowMissingColumns=True)


def top_candidates(layouts: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates of each shader layout, by boosted score, with their fields side by side."""
    found = checkpoint(is_composite(flatten(layouts)))
    return with_fields(best_candidates(candidates(found)).where(F.col("rank") <= n), found)


def composite_parts(layouts: DataFrame) -> DataFrame:
    """(parent, parent_file, place, part): the layouts that a cbuffer holds, in field order."""
    shaders = layouts.where("language = 'shader'")
    names = shaders.select(F.col("name").alias("part")).distinct()
    held = shaders.where("is_cbuffer").select(F.col("name").alias("parent"), F.col("file").alias("parent_file"), F.posexplode("fields.type").alias("place", "part"))
    return held.join(names, "part", "left_semi").select("parent", "parent_file", "place", "part")


def status_counts(linked: DataFrame) -> DataFrame:
    return linked.groupBy(F.regexp_extract("status", r"^(\w+)", 1).alias("status")).agg(F.count("*").alias("n"))


def attach(registers: DataFrame, linked: DataFrame) -> DataFrame:
    """registers with the link of their layout: by path and type (or name), else by type alone, else Unmatched."""
    rows = registers.withColumn("__n", F.lower(F.coalesce(F.when(F.col("template_type") != "", F.col("template_type")), F.col("name")))).withColumn("__p", F.lower("path"))
    links = linked.select(F.lower("shader_name").alias("n"), F.lower("shader_file").alias("p"), C.analysis_link(F.col("shader_name"), F.col("shader_file"), F.col("status")).alias("link"))
    exact = links.groupBy(F.col("p").alias("p1"), F.col("n").alias("n1")).agg(F.min("link").alias("exact_link"))
    named = links.where(~F.col("n").isin(list(schemas.TYPE_SIZES))).groupBy(F.col("n").alias("n2")).agg(F.min("link").alias("named_link"))
    met = rows.join(exact, (F.col("__p") == F.col("p1")) & (F.col("__n") == F.col("n1")), "left").join(named, F.col("__n") == F.col("n2"), "left")
    return met.select(*registers.columns, F.coalesce("exact_link", "named_link", F.lit("Unmatched")).alias("analysis"))

"""Reports: driver-side writers over small, already aggregated and ordered results.

Rows are fetched with toLocalIterator, a partition at a time; what is written is a report for people or a
configuration file, both small by nature.
"""

from __future__ import annotations

from collections.abc import Iterable

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.operators import diagnostics as D
from logloom.operators import variants as V


class _Shared(yaml.SafeDumper):
    """Writes equal lists once and refers to them."""

    def ignore_aliases(self, data) -> bool:
        return not (isinstance(data, list) and data)


def share_lists(node, pool: dict | None = None):
    """The same tree in which equal lists of scalars are one object."""
    pool = {} if pool is None else pool
    if isinstance(node, dict):
        return {k: share_lists(v, pool) for k, v in node.items()}
    if isinstance(node, (list, tuple)):
        made = [share_lists(v, pool) for v in node]
        if made and all(not isinstance(v, (dict, list)) for v in made):
            return pool.setdefault(tuple(map(repr, made)), made)
        return made
    return node


def yaml_text(document: dict) -> str:
    return yaml.dump(share_lists(document), Dumper=_Shared, sort_keys=False, allow_unicode=True, default_flow_style=False)


def config_document(found: DataFrame, warnings: DataFrame, errors: DataFrame) -> dict:
    """The configuration document of variants, warning hits and errors; every list and map is ordered."""
    common = V.common_defines(found)
    residual = V.residual_defines(found, common)
    levels: dict[tuple, list[str]] = {}
    for r in common.orderBy("define").toLocalIterator():
        levels.setdefault((r["level"], r["file"], r["shader_type"]), []).append(r["define"])
    entries = F.array_sort(F.collect_list(F.struct("entry", "defines")))
    shaders: dict[str, dict] = {}
    per_file: dict[str, dict] = {}
    for r in residual.groupBy("file", "shader_type").agg(entries.alias("entries")).orderBy("file", "shader_type").toLocalIterator():
        kind = r["shader_type"]
        own = levels.get(("group", r["file"], kind), [])
        shared = sorted(levels.get(("all", None, None), []) + levels.get(("kind", None, kind), []) + own)
        shaders.setdefault(r["file"], {})[kind] = {"common_defines": shared, "entries": [{"entry": e["entry"], "defines": list(e["defines"])} for e in r["entries"]]}
        per_file.setdefault(r["file"], {})[kind] = own
    kinds = {k: levels.get(("kind", None, k), []) for k in ("PSHADER", "VSHADER", "CSHADER")}
    noted: dict[str, dict] = {}
    for r in D.by_place(warnings).orderBy("seq", "location").toLocalIterator():
        w = noted.setdefault(r["warning_key"], {"code": r["code"], "message": r["message"], "instances": {}})
        w["instances"][r["location"]] = {"entries": list(r["entries"])}
    failed: dict[str, list[str]] = {}
    for r in errors.orderBy("error_key", "error_text").toLocalIterator():
        failed.setdefault(r["error_key"], []).append(r["error_text"])
    return {
        "common_defines": levels.get(("all", None, None), []),
        "common_pshader_defines": kinds["PSHADER"],
        "common_vshader_defines": kinds["VSHADER"],
        "common_cshader_defines": kinds["CSHADER"],
        "file_common_defines": per_file,
        "warnings": noted,
        "errors": failed,
        "shaders": [{"file": f, "configs": c} for f, c in shaders.items()],
    }


def markdown_table(names: list[str], rows: Iterable[Iterable]) -> str:
    line = lambda cells: "|" + "|".join(" ".join(str("" if c is None else c).replace("|", "\\|").split()) for c in cells) + "|"
    return "\n".join([line(names), "|" + "|".join("---" for _ in names) + "|", *map(line, rows)])


def register_report(rows: DataFrame) -> str:
    """Markdown of registers in report order; rows as of sources_code.report_rows, with the column analysis."""
    shown = rows.select("register", "feature", F.concat(F.lit("`"), "type", F.lit("`")), "name", F.concat(F.lit("["), "path", F.lit(":"), "line", F.lit("]("), C.link(F.col("path"), F.col("line")), F.lit(")")), C.usage(F.col("pshader"), F.col("vshader"), F.col("vr")), "analysis")
    return "# Buffer Table\n" + markdown_table(["Register", "Feature", "Type", "Name", "File", "Shaders", "Struct Analysis"], shown.toLocalIterator())


def conflict_report(rows: DataFrame) -> str:
    """Registers with several declarations under one combination, each with its declarations."""
    each = rows.select("register", F.explode("combos").alias("combo"), F.struct("name", "type", "path", "feature").alias("use"))
    met = each.groupBy("register", "combo").agg(F.array_sort(F.collect_list("use")).alias("uses")).where(F.size("uses") > 1).orderBy("register", "combo")
    out = ["# Register Conflicts"]
    for r in met.toLocalIterator():
        out.append(f"\n## Register {r['register']} with defines: {r['combo'].replace('_', ', ')}")
        out += [f"- **{u['name']}** ({u['type']}) in `{u['path']}` - Feature: {u['feature']}" for u in r["uses"]]
    if len(out) == 1:
        out.append("No register conflicts: every register is used once under each define combination.")
    return "\n".join(out)


def _field(f) -> str:
    return "" if f is None else f"{f['type']} {f['name']} ({f['size']})"


def _side_by_side(rows) -> str:
    cells = []
    for m in rows:
        a, b = m["shader"], m["host"]
        same = a is not None and b is not None and a["name"].lower() == b["name"].lower() and a["size"] == b["size"]
        cells.append([x if same or not x else f"<ins>**_{x}_**</ins>" for x in (_field(a), _field(b))])
    return markdown_table(["Shader field", "Host field"], cells)


def comparison_report(linked: DataFrame, only_matched: bool = False, parts: DataFrame | None = None, candidates: DataFrame | None = None, show_top_candidate: bool = False) -> str:
    """One Markdown table of fields side by side per linked layout, differences emphasised.

    parts, as of linkage.composite_parts, lists under a composite the layouts that it holds. candidates, as of
    linkage.top_candidates, lists the best ones of each layout. A rejected best candidate's fields are shown
    only on request.
    """
    others: dict[tuple, list[str]] = {}
    if candidates is not None:
        for c in candidates.select("shader_name", "shader_file", "shader_line", "rank", "host_name", "host_file", "score").orderBy("shader_name", "shader_file", "shader_line", "rank").toLocalIterator():
            others.setdefault((c["shader_name"], c["shader_file"], c["shader_line"]), []).append(f"{c['rank']}. {c['host_name']} ({c['host_file']}): {c['score']:.3f}")
    out, held = [], {}
    if parts is not None:
        for p in parts.orderBy("parent", "parent_file", "place").toLocalIterator():
            held.setdefault((p["parent"], p["parent_file"]), []).append(p["part"])
    rows = linked.where("status <> 'Unmatched'") if only_matched else linked
    for r in rows.orderBy("shader_name", "shader_file", "shader_line").toLocalIterator():
        out.append(f"\n## {r['shader_name']} ({r['shader_file']}:{r['shader_line']}): {r['status']}")
        if (r["shader_name"], r["shader_file"]) in held:
            out.append("Holds: " + ", ".join(dict.fromkeys(held[r["shader_name"], r["shader_file"]])))
        if r["host_name"] is None:
            continue
        rejected = "" if r["accepted"] else " (top candidate - rejected)"
        out.append(f"Best candidate: {r['host_name']}{rejected} ({r['host_file']}:{r['host_line']}), score {r['score']:.3f}, {r['exact_matches']} exact, {r['missing_fields']} missing\n")
        out += others.get((r["shader_name"], r["shader_file"], r["shader_line"]), [])
        if r["accepted"] or show_top_candidate:
            out.append(_side_by_side(r["align_matches"]))
    return "\n".join(out)


def _contexts(new: DataFrame, lines: DataFrame) -> DataFrame:
    """new with `context`: the lines around the first line of its compiler output that reports it."""
    part = [c for c in ("seq", "file") if c in lines.columns]
    found = D.context_lines(lines.withColumn("d", C.diagnostic("line")), F.col("d").isNotNull(), "line_no", "line", [*part, "entry"])
    place = F.lower(F.concat_ws(":", C.compile_path("d.file"), F.col("d.place")))
    keyed = found.select("entry", C.warning_key(F.col("d.code"), F.col("d.message")).alias("warning_key"), place.alias("__place"), F.struct(*part, "line_no").alias("at"), "context")
    first = keyed.groupBy("entry", "warning_key", "__place").agg(F.min_by("context", "at").alias("context"))
    return new.withColumn("__place", F.lower("location")).join(first, ["entry", "warning_key", "__place"], "left").drop("__place")


def issue_log(new: DataFrame, errors: DataFrame, lines: DataFrame | None = None) -> Iterable[str]:
    """Lines of the new-issues report: errors, then warnings by affected combinations, then a summary.

    lines, of (entry, line_no, line) and optionally seq and file of the result, gives the two lines around a
    warning in its compiler output.
    """
    bar, n_errors, n_warnings, n_entries = "=" * 80, 0, 0, 0
    yield from (bar, "NEW COMPILATION ISSUES", bar)
    for r in errors.orderBy("shader_key", "location", "code", "message").toLocalIterator():
        n_errors += 1
        yield f"ERROR {r['code']} in {r['shader_key']} ({r['shader_type']}) at {r['location']}: {r['message']}"
    shown = new.withColumn("context", F.array().cast("array<string>")) if lines is None else _contexts(new, lines)
    places = F.array_sort(F.collect_list(F.struct("seq", "location", "entry", "context")))
    grouped = shown.groupBy("warning_key").agg(F.min_by(F.struct("code", "message"), "seq").alias("d"), places.alias("places"), F.count("*").alias("n"))
    for r in grouped.orderBy(F.desc("n"), "warning_key").toLocalIterator():
        n_warnings, n_entries = n_warnings + 1, n_entries + r["n"]
        yield f"WARNING {r['d']['code']}: {r['d']['message']} ({r['n']} combinations)"
        for p in r["places"]:
            yield f"  {p['location']} [{p['entry']}]"
            yield from (f"    {c}" for c in p["context"] or [])
    yield from (bar, f"{n_errors} errors, {n_warnings} new warnings, {n_entries} combinations", bar)


def _ranked(rows: DataFrame, impact: str) -> Iterable[str]:
    for i, r in enumerate(rows.toLocalIterator(), 1):
        yield f"{i}. {r['code']}: {r['message']}"
        yield "   Impact: " + impact.format(**r.asDict())
        for s in r["samples"]:
            more = f" (+{s['more']} more)" if s["more"] else ""
            yield f"   Location: {s['location']}" + (f" (entries: {', '.join(s['entries'])}{more})" if s["entries"] else "")
        if r["samples"] and r["instances"] > len(r["samples"]):
            yield f"   Location: ...and {r['instances'] - len(r['samples'])} more locations"


def verdict_report(new: DataFrame, errors: DataFrame, baseline: DataFrame, summary: DataFrame, counts: DataFrame, max_warnings: int, most: int = 10) -> Iterable[str]:
    """Lines of the verdict: totals, files by new issues, the most frequent new warnings, errors, and what to remove.

    A limit below zero lists the five baseline warnings with the most entries, a broken limit on new warnings
    the three most frequent ones.
    """
    total = counts.first()
    yield f"{total['new_count']} new warnings, {total['suppressed']} suppressed warnings, {total['errors']} errors"
    for r in summary.orderBy(F.desc("new"), "file").toLocalIterator():
        yield f"{r['file']}: {r['new']} new issues (baseline: {r['baseline']}, total: {r['total']})"
    places = D.by_place(new)
    kinds = places.agg(F.count_distinct("warning_key").alias("n")).first()["n"]
    if kinds:
        yield f"NEW WARNINGS ({kinds} kinds)"
        yield from _ranked(D.ranked_warnings(places, "instances", most), "{instances} occurrences across {combinations} shader variants ({percent:.1f}%)")
        if kinds > most:
            yield f"...and {kinds - most} more kinds"
    if total["errors"]:
        yield f"ERRORS ({total['errors']})"
        for r in errors.orderBy("shader_key", "location", "code", "message").toLocalIterator():
            yield f"   {r['code']} in {r['shader_key']} ({r['shader_type']}) at {r['location']}: {r['message']}"
    elif total["exit_code"] and max_warnings < 0:
        yield f"TOO FEW WARNINGS REMOVED: baseline {total['baseline_count']}, wanted {-max_warnings} fewer, new {total['new_count']}"
        known = D.by_place(baseline.withColumn("seq", F.monotonically_increasing_id()))
        yield from _ranked(D.ranked_warnings(known, "combinations", 5), "{combinations} shader combinations across {instances} locations ({percent:.1f}% of the baseline)")
    elif total["exit_code"]:
        yield f"TOO MANY NEW WARNINGS: {total['new_count']} exceed the limit of {max_warnings}"
        yield from _ranked(D.ranked_warnings(places, "instances", 3, shown_places=0), "{instances} occurrences")


def shared_lists(lists: DataFrame, value: str) -> DataFrame:
    """Lists that occur more than once, by use, then by length: the order in which a document names them."""
    uses = lists.groupBy(value).agg(F.count("*").alias("uses")).where("uses > 1")
    return uses.orderBy(F.desc("uses"), F.desc(F.size(value)), value)

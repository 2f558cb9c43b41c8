import random

import pytest

import corpus_pipeline as P
from logloom.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest documents with planted junk, copies, near copies and a benchmark item, through all stages."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [r for r in rows if 150 <= len(r[1].split()) <= 400][:12]
    extra, kinds = [], {}

    def plant(kind, text):
        kinds.setdefault(kind, []).append(10_000 + len(extra))
        extra.append((10_000 + len(extra), text, "en", "planted", len(text)))

    for text in ("12 34 !!", "", None or "...", "日本語の文章です"):
        plant("junk", text)
    for r in long[:4]:
        plant("copy", r[1].replace(" ", "\n "))
    for r in long:
        w = r[1].split()
        for k in rng.sample(range(len(w)), max(1, len(w) // 120)):
            w[k] = "replaced"
        plant("near", " ".join(w))
    for r, item in zip(long[:3], items):
        plant("leak", " ".join(f"zq{i} {w}" for i, w in enumerate(r[1].split()[:60])) + " " + item)
    df = spark.createDataFrame(rows + extra, docs.schema)
    folder = tmp_path_factory.mktemp("stages")
    outs = [df]
    for name, stage in P.STAGES:
        path = str(folder / name)
        stage(spark, outs[-1], SF).write.parquet(path)
        outs.append(spark.read.parquet(path))
    return rows, kinds, outs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").distinct().collect()}


def test_stages_and_columns(planted):
    _, _, outs = planted
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    assert all(o.columns == outs[0].columns for o in outs[1:-1]) and "sequence_id" in outs[-1].columns


def test_language_stage_drops_junk_alone(planted):
    _, kinds, outs = planted
    assert ids(outs[0]) - ids(outs[1]) == set(kinds["junk"])


def test_exact_stage_equals_brute_force(planted):
    _, kinds, outs = planted
    best = {}
    for r in outs[1].collect():
        key = "".join((r.text or "").split())
        best[key] = max(best.get(key, (-1, 0)), (len(r.text or ""), -r.doc_id))
    assert ids(outs[2]) == {-i for _, i in best.values()}


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_stage_drops_near_copies_and_keeps_clean_documents(planted):
    _, kinds, outs = planted
    docs = sorted((r.doc_id, shingles(r.text)) for r in outs[2].collect())
    gone = ids(outs[2]) - ids(outs[3])
    alike = lambda a, b: len(a & b) / max(1, len(a | b))
    best = {i: max((alike(s, t) for j, t in docs if j < i), default=0.0) for i, s in docs}
    assert all(i in gone for i, b in best.items() if b >= 0.87), [(i, b) for i, b in best.items() if b >= 0.87 and i not in gone]
    assert all(best[i] >= 0.5 for i in gone)
    assert len(gone & set(kinds["near"])) >= 0.9 * len(kinds["near"])


def test_decontamination_stage(spark, planted):
    _, kinds, outs = planted
    items = [b" ".join(words_of(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in outs[3].collect() if any(b" " + i + b" " in b" " + b" ".join(words_of(r.text.encode())) + b" " for i in items)}
    gone = ids(outs[3]) - ids(outs[4])
    assert set(kinds["leak"]) <= gone and holds <= gone and len(gone - holds) <= 2


def test_packing_stage_holds_every_document(planted):
    _, _, outs = planted
    pieces = outs[5].collect()
    assert ids(outs[4]) == {p.doc_id for p in pieces}
    whole = {p.doc_id: p.doc_tokens for p in pieces}
    for i, n in whole.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == n


def test_run_equals_the_stages(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, SF).count() > 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs

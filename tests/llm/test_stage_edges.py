"""Rows that no stage of the pipeline should stumble over: nulls, repeats, ties, long texts, columns with clashing names."""

import pytest

import corpus_pipeline as P
from logloom.llm.exact_dedup import keep_first
from logloom.llm.simhash import keep_one

SF = "/root/testdata/sf0.001"
CLASHES = ["__gone_id", "__kept_id", "__key", "__place", "key", "t", "node", "kept", "digest", "least"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text and 60 <= len(r.text.split()) <= 300][:8]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en"), (3, texts[3], "en"), (None, texts[4], "en"), (None, texts[5] + " more of it", None), (None, texts[5] + " more  of it", None)]
    rows += [(-20, texts[6] + "  ", "en"), (40, None, None), (41, "", "en"), (None, None, None), (42, " ".join(texts * 200), "en")]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([r + ("x",) * len(CLASHES) for r in rows], schema), texts


def pairs(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def slow_keep_first(rows):
    best = {}
    for null, i, t in rows:
        key = "".join(t.split())
        # most code points, then the smallest id, null last, then the least text
        best[key] = min(best.get(key, (1,)), (-len(t), null, i, t))
    return sorted((null, i, t) for _, null, i, t in best.values())


def test_exact_stage_leaves_one_row_a_text(odd):
    docs, _ = odd
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert pairs(out) == slow_keep_first(pairs(docs))


def test_same_id_with_another_text_is_no_way_around(spark):
    docs = spark.createDataFrame([(1, "a b"), (7, "ab"), (7, "c d"), (None, "a b"), (None, "e")], "doc_id long, text string")
    assert pairs(keep_first(docs)) == [(False, 1, "a b"), (False, 7, "c d"), (True, 0, "e")]


def test_near_stage_takes_rows_of_an_id_together(odd):
    docs, texts = odd
    kept = pairs(keep_one(docs))
    # the text of 6 returns under -20, which is smaller; null ids stay
    assert (False, 6, texts[6]) not in kept
    assert sum(null for null, _, _ in kept) == 4 and sum(i == 3 and not null for null, i, _ in kept) == 3


def test_all_stages(odd):
    docs, _ = odd
    for name, stage in P.STAGES[:-1]:
        out = P.checkpoint(stage(docs.sparkSession, docs, SF))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    pieces = P.STAGES[-1][1](docs.sparkSession, docs, SF).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces) and {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}

import hashlib
import random

import pytest

from compare import assert_same
from logloom.llm import grid
from logloom.llm.substring_dedup import substring_dedup


def slow(docs, window=13):
    words = [(i, (t or "").split()) for i, t in docs]
    order = lambda i: (i is None, i)
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, w in words:
        gone = {k + o for k in range(len(w) - window + 1) if order(first[tuple(w[k : k + window])]) < order(i) for o in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def fast(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    assert_same(spark, "op9_substring_dedup")


def test_shared_passages_and_edges_of_the_input(spark):
    rng = random.Random(4)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(10, 40))) for _ in range(6)]
    docs = [(rng.randint(0, 10**6) if i else None, " ".join(rng.choices(passages + ["x y", "the\t\nq"], k=rng.randint(1, 7)))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "a " * 60000), (5, "a " * 14), (5, "a " * 14), (6, "a " * 12), (None, "a " * 20)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, chunk string")
    assert fast(substring_dedup(df)) == slow(docs)
    assert fast(substring_dedup(df, window=4)) == slow(docs, 4)
    assert substring_dedup(df.where("doc_id = -5")).count() == 0


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 1 << 10])
def test_negative_and_extreme_ids_over_chunks(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(grid, "CHUNK_BYTES", chunk_bytes)
    rng = random.Random(6)
    docs = []
    for j in range(20):
        text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))
        docs += [(-5 - j, text), (3 + j, f"{text} tail")]
    docs += [(-(2**63), docs[0][1]), (2**63 - 2, docs[2][1]), (None, docs[4][1]), (None, docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert fast(substring_dedup(df)) == slow(docs)

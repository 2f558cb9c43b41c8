import zlib
from collections import Counter

import numpy as np

from logloom.llm.langid import Profiles, counts, fit, keep_known, predict, top_grams


def slow_counts(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def number(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def test_counts_equal_brute_force():
    for text in ("", "..", "Ab, ab!", "Élan été x", "a" * 1500 + " b", "日本 語 Ünï-code 12 3a"):
        keys, n = counts(text, 1000)
        assert dict(zip(keys.tolist(), n.tolist())) == {number(g): c for g, c in slow_counts(text).items()}


def test_a_very_long_run_of_letters_is_not_cut():
    keys, n = counts("ab" * (1 << 20))
    assert dict(zip(keys.tolist(), n.tolist())) == {number(g): c for g, c in slow_counts("ab" * (1 << 20)).items()}


def test_labels_are_bounded(spark):
    rows = spark.createDataFrame([(i, "ab", f"l{i % 7}") for i in range(70)] + [(99, "cd", "rare")], "doc_id long, text string, lang string")
    assert fit(rows, most_languages=7).langs == [f"l{i}" for i in range(7)]


def test_ranks():
    assert top_grams(np.array([3, 5, 9]), np.array([2, 7, 2]), 2).tolist() == [5, 3]


def test_query_predicts_held_out_rows(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op4_language_id"](spark, sf).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_distance_equals_brute_force():
    train = {"x": "abc abd abe " * 5, "y": "xyz xyw abz " * 5}
    rows = [(lang, number(g), i) for lang, t in train.items() for i, (g, _) in enumerate(sorted(slow_counts(t).items(), key=lambda c: (-c[1], number(c[0])))[:6])]
    text = "abc xyz abq"
    own = [g for g, _ in sorted(slow_counts(text).items(), key=lambda c: (-c[1], number(c[0])))[:6]]
    rank = {(lang, g): r for lang, g, r in rows}
    distance = {lang: sum(abs(rank[lang, number(g)] - i) if (lang, number(g)) in rank else 6 for i, g in enumerate(own)) for lang in train}
    best = min(sorted(distance), key=lambda k: distance[k])
    assert Profiles(rows, 6).predict(text) == (best, 1 - distance[best] / (6 * len(own)))


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "the cat sat", "en", 1), (3, "the cat sat", "en", 1), (4, "der hund", None, 1), (None, "1 2 !", "de", 1), (5, "die katze und der hund " * 9000, "de", 1)], "doc_id long, text string, lang string, score int")
    profiles = fit(docs)
    got = sorted((r.doc_id or -1, r.lang_pred, r.score == 0) for r in predict(docs, profiles).collect())
    assert got == [(-1, "und", True), (1, "und", True), (2, "und", True), (3, "en", False), (3, "en", False), (4, "de", False), (5, "de", False)]
    assert sorted(r.doc_id for r in keep_known(docs, profiles).collect()) == [3, 3, 4, 5]
    none = fit(docs.where("lang is null"))
    assert predict(docs, none).where("lang_pred <> 'und'").count() == 0
    assert predict(docs.where("doc_id = 99"), profiles).count() == 0

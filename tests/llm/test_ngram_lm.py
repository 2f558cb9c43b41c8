import math
import zlib
from collections import Counter

import numpy as np
import pytest

from logloom.llm import grid
from logloom.llm.ngram_lm import EliasFano, Trie, decode_counts, encode_counts, score, strength

STRENGTHS = (2.5, 1.5)


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (50, 10), (400, 10**6), (3000, 1 << 48)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n))
    ef = EliasFano(values)
    assert (ef.access(np.arange(n)) == values).all()
    asked = np.concatenate((values, np.random.default_rng(1).integers(0, 2 * top, 200)))
    place, hit = ef.find(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (hit == np.isin(asked, values)).all()


def test_counts_in_two_bytes():
    counts = np.concatenate((np.arange(40000), 10 ** np.arange(5, 13)))
    assert (np.abs(decode_counts(encode_counts(counts)) - counts) <= 6e-4 * counts).all() and (decode_counts(encode_counts(counts[:32768])) == counts[:32768]).all()


def counted(docs, order=3):
    """Counters of the n-grams of token lists; a context holds one begin mark at most."""
    grams = [Counter() for _ in range(order + 1)]
    for w in docs:
        padded = [b" begin"] + w
        for k in range(1, len(padded)):
            for n in range(1, order + 1):
                if k - n + 1 >= 0:
                    grams[n][tuple(padded[k - n + 1 : k + 1])] += 1
    return grams


def probability(grams, history, word, total, kinds, strengths):
    """P(word | history) with Dirichlet priors, straight from the counts."""
    p = (grams[1][(word,)] + 1) / (total + kinds + 1)
    for n in range(2, len(strengths) + 2):
        context = tuple(history[-(n - 1) :])
        if len(context) < n - 1:
            break
        c = grams[n - 1][context] if context != (b" begin",) else grams[1][(b" end",)]
        p = (grams[n][(*context, word)] + strengths[n - 2] * p) / (c + strengths[n - 2])
    return p


def test_probabilities_of_the_vocabulary_sum_to_one():
    rng = np.random.default_rng(2)
    docs = [[b"%d" % w for w in rng.zipf(1.5, rng.integers(0, 30)) % 40] + [b" end"] for _ in range(60)]
    grams = counted(docs)
    # the last word is the unknown one
    words = sorted(g[0] for g in grams[1]) + [b"?"]
    number = {w: i for i, w in enumerate([*words, b" begin"])}
    v, total, kinds = len(words), sum(grams[1].values()), len(grams[1])
    two = [(a, b) for a in [*words, b" begin"] for b in words]
    place = {g: i for i, g in enumerate(two)}
    pairs = [g for g in grams[2] if g[1] != b" end"][:150] + [(words[1], b"?"), (b"?", words[1])]
    three = [(*g, w) for g in pairs for w in words]
    counts = [np.array([grams[1][(w,)] for w in words] + [grams[1][(b" end",)]], float), np.array([grams[2][g] for g in two], float), np.array([grams[3][g] for g in three], float)]
    n2 = tuple(np.array(x) for x in zip(*[(number[a], number[b], number[b]) for a, b in two]))
    n3 = tuple(np.array(x) for x in zip(*[(place[a, b], place[b, c], number[c]) for a, b, c in three]))
    one, second, third = (10**x for x in Trie(counts, [n2, n3], total, kinds, list(STRENGTHS)).log10([n2, n3]))
    assert abs(one[:v].sum() - 1) < 1e-3
    # an end token, the first word, is nobody's context
    assert np.abs(second.reshape(-1, v).sum(axis=1)[1:] - 1).max() < 1e-3 and np.abs(third.reshape(-1, v).sum(axis=1) - 1).max() < 1e-3
    want = [probability(grams, g[:2], g[2], total, kinds, STRENGTHS) for g in three]
    assert np.abs(np.log10(third) - np.log10(want)).max() < 1e-3


def test_strength_expects_the_ngrams_that_occur_once():
    m, c, uses = 3.0, np.arange(1.0, 200), 1000 / np.arange(1.0, 200)
    new = (uses * c * m / (c - 1 + m)).sum() / (uses * c).sum()
    own, own_uses = np.array([1.0, 10.0]), np.array([new * 1000, (1 - new) * 100])
    assert abs(strength((c, uses), (own, own_uses)) - m) < 1e-3 and strength((c[:0], c[:0]), (own, own_uses)) == 1.0


def slow(docs, strengths=STRENGTHS):
    """Brute force: doc -> (tokens, known, N, base, score)."""
    tokens = [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in docs]
    grams = counted([w for i, w in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2])
    total, kinds = sum(grams[1].values()), len(grams[1])
    out = []
    for i, w in tokens:
        padded, base, ours = [b" begin"] + w, 0.0, 0.0
        for k in range(1, len(padded)):
            base += math.log10((grams[1][(padded[k],)] + 1) / (total + kinds + 1))
            ours += math.log10(probability(grams, padded[:k], padded[k], total, kinds, strengths))
        out.append((i, len(w), sum(grams[1][(x,)] > 0 for x in w), total, base, ours))
    return sorted(out, key=str)


def fast(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: str((*r[:4], round(r[4], 5))))


def assert_close(got, want):
    want = sorted(want, key=lambda r: str((*r[:4], round(r[4], 5))))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        # a step of the quantised values a token
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * abs(b[4]) and abs(a[5] - b[5]) < 1e-3 * b[1] and abs(a[5] - b[5]) < 1e-3 * abs(b[5]) + 1e-3, (a, b)


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert_close(fast(score(docs, strengths=STRENGTHS)), slow([(r.doc_id, r.text) for r in docs.collect()]))


def test_query_beats_the_base_and_tells_repeats(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op5_lm_scoring"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    for held in (True, False):
        assert sum(r.score for r in rows if r.held_out is held) > 0.95 * sum(r.base_score for r in rows if r.held_out is held) or held
    assert sum(r.score for r in rows if not r.held_out) > 0.5 * sum(r.base_score for r in rows if not r.held_out)


def test_a_text_that_occurs_twice_is_more_probable(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{w}" for w in rng.zipf(1.3, 60) % 5000)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:900]
    docs = [(i, text()) for i in ids[:800]]
    docs += [(i, docs[k][1]) for k, i in enumerate(ids[800:])]
    got = {r.doc_id: r.score / r.n_tokens for r in score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    bound = np.quantile([got[i] for i in ids[100:800]], 0.9)
    assert np.mean([got[i] > bound for i in ids[:100]]) > 0.9


def test_strengths_come_from_all_ngrams(spark, monkeypatch):
    """More hash buckets than a sample of four an order; held-out documents teach nothing."""
    monkeypatch.setattr(grid, "CHUNK_BYTES", 1 << 13)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"w{w}" for w in rng.zipf(1.4, rng.integers(1, 60)) % 300)) for i in range(400)]
    grams = counted([t.encode().split() + [b" end"] for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    uses = [tuple(np.array(x) for x in zip(*sorted(Counter(c for g, c in grams[n].items() if n > 1 or g != (b" end",)).items()))) for n in (1, 2, 3)]
    want = slow(docs, [strength(uses[0], uses[1]), strength(uses[1], uses[2])])
    assert_close(fast(score(spark.createDataFrame(docs, "doc_id long, text string"))), want)


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 1 << 13])
def test_edges_of_the_input(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(grid, "CHUNK_BYTES", chunk_bytes)
    docs = [(1, None), (2, ""), (3, "a A b"), (3, "a A b"), (None, "b c"), (8, "x " * 20000), (11, "é É a"), (-4, "b c a A"), (-(2**63), "x y"), (2**63 - 1, "a A b")]
    docs += [(-100 - i, f"a A b w{i % 7} x") for i in range(40)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, chunk string")
    assert_close(fast(score(df, strengths=STRENGTHS)), slow(docs))
    assert score(df.where("doc_id = 99")).count() == 0
    assert all(r.score <= 0 for r in score(df.where("doc_id = 2")).collect())

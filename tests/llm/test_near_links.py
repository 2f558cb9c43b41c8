import random

import numpy as np

from logloom.llm.simhash import alike, keep_one, shingle_set, verified_forest


def pair(rng, similarity, n=400):
    """Two texts of n five-word shingles whose Jaccard similarity is the next one from `similarity` on."""
    words = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    common = next(c for c in range(n + 1) if c >= similarity * (2 * n - c))
    first = words(n + 4)
    return " ".join(first), " ".join(first[: common + 4] + words(n - common))


def test_pairs_below_the_similarity_stay_and_pairs_from_it_on_go(spark):
    rng = random.Random(4)
    rows, below, above = [], set(), set()
    for k in range(240):
        s = (0.7, 0.75, 0.78, 0.8, 0.82, 0.9)[k % 6]
        for text in pair(rng, s):
            rows.append((len(rows), text))
        (below if s < 0.8 else above).add(len(rows) - 1)
    rows += [(len(rows), None), (None, rows[0][1])]
    kept = [r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    gone = {i for i, _ in rows} - set(kept)
    assert not gone & below and gone <= above
    assert len(gone) >= 0.98 * len(above)
    assert len(kept) == len(rows) - len(gone)


def test_group_in_blocks_equals_one_group(spark, monkeypatch):
    import logloom.llm.simhash as module

    rng = random.Random(5)
    base, rows = [f"v{rng.randrange(10**9)}" for _ in range(200)], []
    for i in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in keep_one(df).collect()] == [0]
    monkeypatch.setattr(module, "GROUP_BYTES", 20_000)
    assert [r.doc_id for r in keep_one(df).collect()] == [0]


def test_forest_equals_all_pairs():
    rng = random.Random(6)
    base, texts = [[f"b{g} {i}" for i in range(60)] for g in range(5)], []
    for i in range(150):
        words = list(base[i % 5])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"y{i}"
        texts.append(" ".join(words).encode())
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and alike(a, b, 0.8):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    fast = list(range(len(sets)))
    a, b = verified_forest(np.arange(len(sets)), sets, 90, 0.8)
    for x, y in zip(a.tolist(), b.tolist()):
        old, new = max(fast[x], fast[y]), min(fast[x], fast[y])
        fast = [new if z == old else z for z in fast]
    assert fast == label


def test_slow_similarity():
    rng = random.Random(7)
    for s in (0.5, 0.79, 0.8, 0.81, 1.0):
        a, b = (shingle_set(t.encode()) for t in pair(rng, s, 1000))
        assert alike(a, b, 0.8) == (s >= 0.8)

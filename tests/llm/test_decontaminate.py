import random

import numpy as np

from logloom.llm.decontaminate import Index, _coded, find_items, keep_clean, prefix_distance, words_of


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
    return row[-1]


def slow_find(text, items, share=0.2):
    words, out = words_of(text), {}
    for i, item in items:
        want = words_of(item)
        m = len(want)
        if 0 < m < 5:
            if words == want:
                out[i] = 0
        elif m:
            # the best run of any length: the first row of the table costs nothing
            row = [0] * (len(words) + 1)
            for n, x in enumerate(want, 1):
                above, row = row, [n]
                for j, y in enumerate(words, 1):
                    row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
            best = min(row)
            if best <= int(m * share):
                out[i] = best
    return out


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        full, most = min(slow_distance(a[:k], b) for k in range(len(a) + 1)), rng.randint(0, 8)
        assert prefix_distance(np.array(a), np.array(b), most) == (full if full <= most else None)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.choice([0, 1, 1])] = rng.choice([[b"new"], [], [b"of"]])
    return words


def test_recall_and_precision_against_brute_force():
    rng = random.Random(2)
    common = [f"w{i}".encode() for i in range(40)]
    items = [(i, b" ".join(rng.choices(common, k=rng.randint(8, 24)))) for i in range(8)] + [(90, b""), (91, b"two words"), (92, b"!!")]
    texts = [b"", b"Two  words.", b"two words more", b"..."]
    for i, item in items[:8]:
        words = words_of(item)
        for share in (0, 0.1, 0.2):
            texts.append(b" ".join(rng.choices(common, k=20) + edited(rng, words, int(share * len(words))) + rng.choices(common, k=20)))
        # the whole text is the item less its last words
        texts.append(b" ".join(words[: len(words) - int(0.2 * len(words))]))
    index = Index([i for i, _ in items], [words_of(t) for _, t in items])
    found = index.find(_coded(index, texts))
    slow = [slow_find(t, items) for t in texts]
    pairs = lambda rows: {(d, i) for d, f in enumerate(rows) for i in f}
    assert pairs(found) <= pairs(slow)
    assert len(pairs(found)) >= 0.95 * len(pairs(slow)) and len(pairs(slow)) > 15
    assert all(found[d][i] == 0 for d, f in enumerate(slow) for i, x in f.items() if x == 0)


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r["items"] for r in entry.queries()["op10_decontamination"](spark, sf).collect()}
    assert len(got) == len(docs) and any(got.values())
    for i, text in docs.items():
        if len(text) < 900:
            assert got[i] == ",".join(map(str, sorted(slow_find(text[:60000], items)))), i


def test_long_texts_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(15).collect()]
    rng = random.Random(8)
    docs = [r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if 3000 < len(r.text or "") < 9000][:12]
    texts = [t[: len(t) // 2] + b" " + b" ".join(edited(rng, words_of(items[k][1]), k % 3)) + b" " + t[len(t) // 2 :] for k, t in enumerate(docs)]
    index = Index([i for i, _ in items], [words_of(t) for _, t in items])
    found, slow = index.find(_coded(index, texts)), [slow_find(t, items) for t in texts]
    assert sum(map(len, slow)) >= len(texts) and [set(f) for f in found] == [set(f) for f in slow]


def test_edges_of_the_input(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "x y z a b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "ONE two, three four five six", "k"), (3, "ONE two, three four five six", "k"), (None, "zz " * 50000, None)], "doc_id long, text string, items string")
    got = sorted(((r.doc_id or -1, r.contaminated, r["items"], r.distance) for r in find_items(docs, bench).collect()))
    assert got == [(-1, False, "", None), (1, False, "", None), (2, False, "", None), (3, True, "1", 0), (3, True, "1", 0)]
    assert find_items(docs, bench, block=1).exceptAll(find_items(docs, bench)).count() == 0 and find_items(docs, bench, block=1).count() == 5
    assert sorted((r.doc_id or -1, r["items"]) for r in keep_clean(docs, bench).collect()) == [(-1, None), (1, "k"), (2, "k")]
    assert find_items(docs, bench.where("item_id = 9")).where("contaminated").count() == 0
    assert find_items(docs.where("doc_id = 50"), bench).count() == 0 and keep_clean(docs, bench.where("item_id = 9")).count() == 5

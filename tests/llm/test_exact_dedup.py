import random

import pyarrow as pa

from compare import assert_same
from logloom.llm.exact_dedup import PatriciaTrie, _own, exact_dedup, keep_first


def test_query_equals_sql(spark):
    assert_same(spark, "op6_exact_dedup")


def test_trie_keeps_owners():
    rng = random.Random(1)
    trie, want = PatriciaTrie(), {}
    for i in range(4000):
        key = bytes(rng.choices(b"ab", k=rng.randint(0, 9)))
        n, doc = rng.randint(0, 5), rng.randint(0, 10**6)
        trie.insert(key, n, doc, 1)
        best, rows = want.get(key, ((n, -doc), 0))
        want[key] = max(best, (n, -doc)), rows + 1
    assert {k: ((o[0], -o[1]), o[2]) for k, o in trie.owners()} == want


def test_release_by_subtree_changes_nothing():
    rng = random.Random(7)
    norms = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 7))) for _ in range(600))
    rows = [(len(w), 0, w, rng.randint(0, 9), k, 1) for k, w in enumerate(norms)]
    batch = pa.record_batch([list(c) for c in zip(*rows)], names=["size", "hash", "norm", "n", "id", "rows"])
    found = [sorted(str(r) for p in _own(limit)(iter([batch])) for r in p.to_pylist()) for limit in (1 << 30, 5000, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(norms))


def test_the_open_path_stays():
    trie = PatriciaTrie()
    for w in (b"", b"aa", b"ab", b"abc", b"abd"):
        trie.insert(w, 1, 1, 1)
    assert sorted(w for w, _ in trie.finished(b"abd")) == [b"", b"aa", b"ab", b"abc"]
    trie.insert(b"abd", 2, 9, 1)
    trie.insert(b"b", 1, 3, 1)
    assert sorted(trie.owners()) == [(b"abd", (2, 9, 2)), (b"b", (1, 3, 1))]


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(4, None, "k"), (3, " \n", "k"), (9, "a b", "k"), (7, "ab", None), (7, "ab", None), (None, "a  b", "k"), (8, "é" * 50000, "k"), (2, "a b", "k")], "doc_id long, text string, sha string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    assert got == [(-1, -1, 4, True), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (7, -1, 4, False), (7, -1, 4, False), (8, 8, 1, True), (9, -1, 4, False)]
    assert sorted(r.doc_id or -1 for r in keep_first(docs).collect()) == [-1, 2, 3, 8]
    assert exact_dedup(docs.where("doc_id = 100")).count() == 0

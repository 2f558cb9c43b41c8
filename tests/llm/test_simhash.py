import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from logloom.llm.simhash import GrayIndex, block_masks, free_blocks, gray_rank, near_components, simhash_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, k=4):
    label = {i: i for i in prints}
    ids = sorted(prints)
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= k and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    return label


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert (gray_rank(codes) == np.arange(1000)).all()


@pytest.mark.parametrize("n,k", [(10, 4), (10**6, 4), (10**9, 4), (10**9, 2)])
def test_block_masks_miss_no_pair(n, k):
    rng = np.random.default_rng(n)
    masks = block_masks(n, k)
    for _ in range(300):
        differ = sum(1 << int(b) for b in rng.choice(64, k, replace=False))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("words,k,n", [(1, 4, 400), (1, 0, 50), (4, 40, 300)])
def test_index_equals_brute_force(words, k, n):
    rng = np.random.default_rng(n + k)
    prints = rng.integers(0, 1 << 63, (n // 6 + 1, words), dtype=np.uint64)[rng.integers(0, n // 6 + 1, n)]
    for _ in range(3 * words):
        prints[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    prints = np.unique(prints, axis=0)
    ints = {i: int.from_bytes(p.astype(">u8").tobytes(), "big") for i, p in enumerate(prints)}
    slow = slow_components(ints, k)
    fast = GrayIndex(prints, k).link()
    pairs = {(int(f), slow[i]) for i, f in enumerate(fast)}
    assert len(pairs) == len({f for f, _ in pairs}) == len({s for _, s in pairs})


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    slow = slow_components(prints)
    rows = entry.queries()["op1_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", slow[i]) for i, p in prints.items()}
    assert len(rows) == len(docs)


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(5, None, "x"), (3, "", None), (9, " \n", "x"), (1, "A b", "y"), (2, "a  B", "y"), (2, "a  B", "y"), (None, "a b", "z"), (None, "other words", "z"), (7, "w " * 30000, "q")], DOCS)
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.fingerprint == "0" * 16) for r in simhash_components(docs).collect()))
    assert got == [(-1, -1, False), (-1, 1, False), (1, 1, False), (2, 1, False), (2, 1, False), (3, 3, True), (5, 3, True), (7, 7, False), (9, 3, True)]
    assert simhash_components(docs.where("doc_id = 100")).count() == 0


def test_hot_key_is_split(spark, monkeypatch):
    import logloom.llm.simhash as module

    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = {i: base ^ (1 << (i % 60)) ^ (1 << (i * 7 % 60)) for i in range(300)}
    rows = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "doc_id long, fp binary")
    monkeypatch.setattr(module, "HOT", 20)
    got = {bytes(r.fp): r.component_id for r in near_components(rows).collect()}
    slow = slow_components(prints)
    assert all(got[p.to_bytes(8, "big")] == slow[i] for i, p in prints.items())


def test_very_hot_keys_are_refined(spark, monkeypatch):
    """A third of all fingerprints share the bits of a key; longer keys lose no link."""
    import logloom.llm.simhash as module

    rng = np.random.default_rng(6)
    base, low = int(rng.integers(0, 1 << 62)), (1 << 24) - 1
    dense = [base & ~low | int(x) for x in rng.integers(0, 1 << 24, 500)]
    near = [p ^ sum(1 << int(b) for b in rng.choice(24, 4, replace=False)) for p in dense[::4]]
    prints = dict(enumerate([*dense, *near, *map(int, rng.integers(0, 1 << 62, 900))]))
    rows = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "doc_id long, fp binary")
    rounds, whole = [], module._refine
    monkeypatch.setattr(module, "HOT", 10)
    monkeypatch.setattr(module, "_refine", lambda k: rounds.append(k) or whole(k))
    got = {bytes(r.fp): r.component_id for r in near_components(rows).collect()}
    slow = slow_components(prints)
    assert len(rounds) > 1
    assert all(got[p.to_bytes(8, "big")] == slow[i] for i, p in prints.items())


@pytest.mark.parametrize("fixed,k", [(0, 4), ((1 << 40) - 1, 4), (0b1010 << 30, 7)])
def test_free_blocks_cover_the_free_bits_once(fixed, k):
    blocks = free_blocks(fixed, k)
    assert len(blocks) == k + 1 and all(blocks) and sum(blocks) == (1 << 64) - 1 - fixed


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    for c, v in held.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def test_checkpoints_of_few_rows_are_few_files(spark, many_partitions, monkeypatch):
    """Many small shuffle partitions don't become as many files; every file costs a local store a process that sets its mode."""
    import logloom.llm.components as stars
    import logloom.llm.simhash as module

    rng = np.random.default_rng(9)
    prints = dict(enumerate(int(p) ^ 1 << b for p in rng.integers(0, 1 << 62, 60) for b in range(3)))
    rows = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "doc_id long, fp binary")
    files, whole = [], module.checkpoint

    def counted(df):
        out = whole(df)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "checkpoint", counted)
    monkeypatch.setattr(stars, "checkpoint", counted)
    got = {bytes(r.fp): r.component_id for r in near_components(rows).collect()}
    slow = slow_components(prints)
    assert all(got[p.to_bytes(8, "big")] == slow[i] for i, p in prints.items())
    assert len(files) >= 4 and max(files) <= 8


def test_a_small_result_is_few_files(spark, many_partitions, tmp_path):
    texts = [f"w{i} x{i % 90} y z{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    simhash_components(docs).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    slow = slow_components(dict(enumerate(map(slow_print, texts))))
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted(slow.items())
    assert 0 < len(list(tmp_path.glob("out/*.parquet"))) <= 8

import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from logloom.llm.packing import WordEncoder, karmarkar_karp, pack
from logloom.session import ROOT

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, docs):
    """Every id in one piece, crc and offsets right, no sequence above 2048; returns the share of filled places."""
    ids = dict(zip(docs, plain_ids(docs.values())))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    total = places = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total, places = total + at, places + (at if at & (at - 1) == 0 else 2048)
    return total / places


def test_query_packs_every_id_with_little_padding(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(entry.queries()["op2_packing"](spark, sf).collect(), docs) > 0.97


def test_differencing_is_near_equal_and_within_capacity():
    rng = random.Random(1)
    for n in (1, 2, 7, 300):
        sizes = [rng.randint(1, 512) for _ in range(n)]
        windows = karmarkar_karp(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(n))
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) <= 2048 and (n < 300 or max(loads) - min(loads) < 40)
    assert [sorted(w) for w in karmarkar_karp([1500, 1500, 600, 600], 2048)] and len(karmarkar_karp([1500, 1500, 1500], 2048)) == 3


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    alphabet = "aB'sé.,!?<|> \n\t3²İ́😀中-_ΣςÉ—\x01$"
    texts = ["", "It's, a TEST!!! don't... l'été", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "é, É. Å"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(12000)]
    encoder = WordEncoder(PATH, 1, remember=50)
    got = []
    for k in range(0, len(texts), 100):
        ids, ends = encoder(pa.array([t.encode() for t in texts[k : k + 100]], pa.binary()))
        got += [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == plain_ids(texts)


def test_edges_of_the_input(spark):
    docs = {1: None, 2: "", 3: "word " * 2047, 4: "a b. " * 9000, 5: "x"}
    df = spark.createDataFrame([(i, t, "z") for i, t in docs.items()], "doc_id long, text string, offset string")
    assert check(pack(df, PATH).collect(), docs) > 0.8
    twice = pack(df.where("doc_id = 5").unionByName(df.where("doc_id = 5")), PATH).collect()
    assert len(twice) == 2 and pack(df.where("doc_id = 9"), PATH).count() == 0
    assert pack(spark.createDataFrame([(None, "x")], "doc_id long, text string"), PATH).first().doc_id is None


def test_what_an_encoder_remembers_is_bounded_in_bytes():
    encoder = WordEncoder(PATH, 1)
    for step in range(11):
        texts = [f"{step}-{k}-" + "abcdefghi-" * 100_000 for k in range(2)]
        ids, ends = encoder(pa.array([t.encode() for t in texts], pa.binary()))
        if step == 10:
            assert ids.tolist() == [i for t in plain_ids(texts) for i in t] and ends[-1] == len(ids)
    assert sum(map(len, [*encoder.young, *encoder.old])) < 24 << 20


#: Packs a million words and prints how many MB a worker has and does not use, at most, after its steps.
IDLE = r"""
import ctypes, random, re, sys, types
import pyarrow as pa
from logloom.llm import packing
packing.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))

def anonymous():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

def texts():
    rng = random.Random(1)
    for k in range(10):
        text = [b" ".join(b"%x" % rng.getrandbits(36) if i % 3 else b"of" for i in range(100)).translate(bytes.maketrans(b"0123456789", b"ghijklmnop")) for _ in range(1000)]
        yield pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(text, pa.binary())], names=["doc_id", "t"])

most = 0
for out in packing._pack(sys.argv[1], 1, 2048, 512, 96)(texts()):
    held = anonymous()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    most = max(most, held - anonymous())
print(most)
"""


def test_a_worker_keeps_no_memory_that_it_does_not_use():
    done = subprocess.run([sys.executable, "-c", IDLE, PATH], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 25

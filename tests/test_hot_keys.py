"""Operators whose groups cross chunks: the same rows whatever the chunks, null keys included."""

import random

import pytest

from logloom.operators import diagnostics as D
from logloom.operators import lifecycle as L


def slow_pairs(events):
    """(seq of the opener, seq of its closer) by a stack per key."""
    stacks, out = {}, {}
    for seq, key, kind in sorted(events):
        stack = stacks.setdefault(key, [])
        if kind == 1:
            stack.append(seq)
            out[seq] = None
        elif stack:
            out[stack.pop()] = seq
    return out


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_pairs_over_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(L, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    events = [(s, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, 1, -1] if s < 300 else [1, -1, -1])) for s in rng.sample(range(1000), 700)]
    df = spark.createDataFrame(events, "seq long, k string, kind int")
    assert {r.seq: r.end_seq for r in L.pair_lifo(df, ["k"], "seq", "kind").collect()} == slow_pairs(events)
    nested = df.selectExpr("struct(seq, seq * 2 AS ms) AS at", "k", "kind")
    got = {r["at"].seq: r.closed and (r.closed.seq, r.closed.ms) for r in L.pair_lifo(nested, ["k"], "at", "kind", "closed").collect()}
    assert got == {s: e and (e, 2 * e) for s, e in slow_pairs(events).items()}
    assert L.pair_lifo(df.where("false"), ["k"], "seq", "kind").count() == 0


@pytest.mark.parametrize("block", [3, 10, 100_000])
def test_context_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(o, rng.choice(["p", None]), f"l{o}") for o in rng.sample(range(400_000), 120)]
    df = spark.createDataFrame(rows, "o long, p string, line string")
    got = {r.o: list(r.context) for r in D.context_lines(df, df["o"] % 3 == 0, "o", "line", ["p"], 2, 1, block).collect()}
    want = {}
    for p in ("p", None):
        mine = sorted(r for r in rows if r[1] == p) if p else sorted((r for r in rows if r[1] is None), key=lambda r: r[0])
        want |= {r[0]: [x[2] for x in mine[max(0, i - 2) : i + 2]] for i, r in enumerate(mine) if r[0] % 3 == 0}
    assert got == want


def test_running_new_row_by_row(spark):
    rng = random.Random(4)
    current = [(i, rng.choice("kmn"), rng.choice(["E", "e", "f", None]), f"p{rng.randrange(6)}") for i in range(200)]
    base = [("k", "e", f"p{j}", False) for j in range(3)] + [("m", None, "p0", True), ("m", None, "p1", True), ("m", "f", "p2", False)]
    got = {r.i: r.is_new for r in D.running_new(spark.createDataFrame(current, "i int, k string, e string, p string"), spark.createDataFrame(base, "k string, e string, p string, legacy boolean"), "k", "e", "p", "i", "legacy").collect()}
    seen, want = {}, {}
    for i, k, e, p in current:
        low = e and e.lower()
        places = seen.setdefault((k, low), {"p0", "p1"} if k == "m" else set())
        places.add(p)
        limit = 2 if k == "m" else len({b[2] for b in base if b[0] == k and b[1] == low})
        want[i] = k == "n" or len(places) > limit
    assert got == want

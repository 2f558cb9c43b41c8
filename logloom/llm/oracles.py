"""DuckDB SQL of the operators whose SQL is built from parts: SimHash components and the licence scan."""

from __future__ import annotations

from logloom.llm.license_scan import SHINGLE, TEMPLATES

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
MASK = (1 << 64) - 1
SEED = 42


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _cut(e: str) -> str:
    return f"(({e}) & {_n(MASK)})"


def _mul(e: str, p: int) -> str:
    return _cut(f"({e}) * {_n(p)}")


def _rotl(e: str, r: int) -> str:
    """e is named twice: give it a column."""
    return f"({_cut(f'{e} << {r}')} | ({e} >> {64 - r}))"


def _bytes(at: str, n: int) -> str:
    """The little-endian number of n bytes of the hex digits `hx` from byte `at` (from 0)."""
    return "('0x' || " + " || ".join(f"substr(hx, ({at}) * 2 + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def _steps(table: str, steps: list[tuple[str, str]]) -> str:
    """Nested selects, each replacing one column by an expression of the columns before."""
    for name, e in steps:
        table = f"(SELECT * REPLACE ({e} AS {name}) FROM {table})"
    return table


def _round(acc: str, lane: str) -> list[tuple[str, str]]:
    """acc = rotl(acc + lane * P2, 31) * P1"""
    return [(acc, _cut(f"{acc} + {_mul(lane, P2)}")), (acc, _mul(_rotl(acc, 31), P1))]


def xxh64_sql(source: str) -> str:
    """CTEs that end in `hashed` (s, h UBIGINT): XXH64 of the distinct strings s of `source` (s)."""
    start = ", ".join(f"{_n(v & MASK)} AS v{k}" for k, v in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1), 1))
    stripe = _steps("state WHERE pos + 32 <= n", [step for k in range(4) for step in _round(f"v{k + 1}", _bytes(f"pos + {8 * k}", 8))])
    merged = [("h", _cut(" + ".join(_rotl(f"v{k}", r) for k, r in ((1, 1), (2, 7), (3, 12), (4, 18)))))]
    for k in range(1, 5):
        lane = f"v{k}"
        merged += [(lane, _mul(lane, P2)), (lane, _mul(_rotl(lane, 31), P1)), ("h", _cut(f"{_mul(f'xor(h, {lane})', P1)} + {_n(P4)}"))]
    tail = []
    for _ in range(3):
        on = "pos + 8 <= n"
        tail += [("k", f"CASE WHEN {on} THEN {_mul(_bytes('pos', 8), P2)} END"), ("k", _mul(_rotl("k", 31), P1)), ("h", f"CASE WHEN {on} THEN xor(h, k) ELSE h END")]
        tail += [("h", f"CASE WHEN {on} THEN {_cut(_mul(_rotl('h', 27), P1) + ' + ' + _n(P4))} ELSE h END"), ("pos", f"CASE WHEN {on} THEN pos + 8 ELSE pos END")]
    on = "pos + 4 <= n"
    tail += [("h", f"CASE WHEN {on} THEN xor(h, {_mul(_bytes('pos', 4), P1)}) ELSE h END")]
    tail += [("h", f"CASE WHEN {on} THEN {_cut(_mul(_rotl('h', 23), P2) + ' + ' + _n(P3))} ELSE h END"), ("pos", f"CASE WHEN {on} THEN pos + 4 ELSE pos END")]
    for _ in range(3):
        on = "pos < n"
        tail += [("h", f"CASE WHEN {on} THEN xor(h, {_mul(_bytes('pos', 1), P5)}) ELSE h END")]
        tail += [("h", f"CASE WHEN {on} THEN {_mul(_rotl('h', 11), P1)} ELSE h END"), ("pos", f"CASE WHEN {on} THEN pos + 1 ELSE pos END")]
    for shift, prime in ((33, P2), (29, P3)):
        tail += [("h", _mul(f"xor(h, h >> {shift})", prime))]
    tail += [("h", "xor(h, h >> 32)")]
    few = f"SELECT *, {_n(SEED + P5)} AS h FROM state WHERE n < 32"
    many = f"SELECT * FROM {_steps(f'(SELECT *, 0::UHUGEINT AS h FROM state WHERE n >= 32 AND pos + 32 > n)', merged)}"
    return f"""
state AS (
  SELECT s, hex(encode(s)) AS hx, octet_length(encode(s)) AS n, 0::BIGINT AS pos, {start} FROM (SELECT DISTINCT s FROM {source})
  UNION ALL
  SELECT * REPLACE (pos + 32 AS pos) FROM {stripe}),
folded AS MATERIALIZED (
  SELECT s, hx, n, pos, {_cut(f'h + n::UHUGEINT')} AS h, NULL::UHUGEINT AS k FROM ({few} UNION ALL {many})),
hashed AS MATERIALIZED (SELECT s, h::UBIGINT AS h FROM {_steps('folded', tail)})"""


def _op1() -> str:
    sums = ", ".join(f"sum(c * ((h >> {b}) & 1)::BIGINT) AS b{b}" for b in range(64))
    bits = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT doc_id, s, count(*) AS c
  FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0))
  GROUP BY ALL),{xxh64_sql('sh')},
votes AS (SELECT doc_id, sum(c) AS n, {sums} FROM sh JOIN hashed USING (s) GROUP BY doc_id),
prints AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN (SELECT doc_id, ({bits})::UBIGINT AS fp FROM votes) USING (doc_id)),
groups AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp, b.fp AS other FROM groups a JOIN groups b ON bit_count(xor(a.fp, b.fp)::HUGEINT) <= 4),
reach AS (SELECT fp, fp AS other FROM groups UNION SELECT reach.fp, links.other FROM reach JOIN links ON reach.other = links.fp),
named AS (SELECT reach.fp, min(least) AS component_id FROM reach JOIN groups ON groups.fp = reach.other GROUP BY reach.fp)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""


def _op8() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES.items())
    words = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license_id, {words('text')} AS w FROM (VALUES {rows}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
       FROM (SELECT license_id, w, least({SHINGLE}, len(w)) AS size, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM t)),
tn AS (SELECT license_id, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS span FROM ts GROUP BY license_id),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, doc_id, i, size, array_to_string(list_slice(w, i + 1, i + size), ' ') AS s
      FROM (SELECT r, doc_id, w, unnest(range(len(w))) AS i FROM d), (SELECT DISTINCT size FROM ts) WHERE i + size <= len(w)),
h AS MATERIALIZED (SELECT r, doc_id, i, license_id, s FROM p JOIN ts USING (size, s)),
o AS (SELECT DISTINCT r, i AS pos FROM h),
c AS (SELECT h.doc_id, h.r, license_id, pos, count(DISTINCT s) / n AS containment
      FROM o JOIN h USING (r) JOIN tn USING (license_id) WHERE h.i >= pos AND h.i < pos + span GROUP BY h.doc_id, h.r, license_id, pos, n)
SELECT doc_id, license_id, max(containment) AS containment, min(pos)::INTEGER AS first_word FROM c WHERE containment >= 0.8 GROUP BY doc_id, license_id
"""


OP1_SQL, OP8_SQL = _op1(), _op8()

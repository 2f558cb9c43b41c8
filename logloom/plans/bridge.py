"""The operators over the driver's tables: each query has the same answer as its DuckDB SQL.

Counts are BIGINT, sums DOUBLE rounded to six digits, arrays joined to strings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import columns as C
from logloom.functions.similarity import jaro_winkler_udf, name_similarity_udf
from logloom.operators import diagnostics as D
from logloom.operators import includes as G
from logloom.operators import lifecycle as L
from logloom.operators import linkage as K
from logloom.operators import sources_code as S
from logloom.operators import variants as V
from logloom.session import checkpoint
from logloom.sources import files as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | str) -> Column:
    return C.col(c).cast("bigint")


@query(r"""
SELECT doc_id, unnest(range(1, len(w) + 1)) AS line_no, unnest(w) AS line
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS w FROM documents WHERE length(text) > 0)
""")
def b01_ordered_lines(spark, d):
    return R.lines_of(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query(r"""
SELECT page_id::VARCHAR AS src, unnest(regexp_extract_all(replace(html, '<a href=', chr(10) || ' # include '), '(?m)^[ \t]*#[ \t]*include[ \t]*"([^"]+)"', 1)) AS raw FROM pages
""")
def b02_include_names(spark, d):
    text = F.replace("html", F.lit("<a href="), F.lit("\n # include "))
    return G.include_names(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), text.alias("content")))


@query(r"""
WITH p AS (SELECT page_id, 'Data\\' || replace(replace(url, 'example', 'Shaders'), '.org', '\Shaders/x') AS u FROM pages),
c AS (SELECT page_id, regexp_replace(replace(u, '\', '/'), '/+', '/', 'g') AS one, string_split_regex(replace(u, '\', '/'), '(?i)Shaders(?:/|$)') AS parts FROM p)
SELECT page_id,
  CASE WHEN regexp_matches(one, '(?i)\bShaders/') THEN regexp_extract(one, '(?i)^.*?\bShaders/(.*)$', 1) ELSE one END AS log_path,
  regexp_replace(parts[-1], '^/+|/+$', '', 'g') AS compile_path
FROM c
""")
def b03_normalise_paths(spark, d):
    url = F.replace(F.replace("url", F.lit("example"), F.lit("Shaders")), F.lit(".org"), F.lit("\\Shaders/x"))
    path = F.concat(F.lit("Data\\\\"), url)
    return table(spark, d, "pages").select("page_id", C.log_path(path).alias("log_path"), C.compile_path(path).alias("compile_path"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'VSHADER' WHEN 'view' THEN 'PSHADER' WHEN 'purchase' THEN 'CSHADER' ELSE 'UNKNOWN' END AS shader_type FROM events
""")
def b04_type_map(spark, d):
    stage = F.replace(F.replace(F.replace("event_type", F.lit("click"), F.lit("vertex")), F.lit("view"), F.lit("pixel")), F.lit("purchase"), F.lit("compute"))
    return table(spark, d, "events").select("event_id", C.shader_type(F.concat_ws(":", F.lit("main"), stage, F.lit("0"))).alias("shader_type"))


@query("""
SELECT count(*) FILTER (contains(text, 'License') OR contains(text, 'the ') OR contains(text, '@')) AS blocks FROM documents
""")
def b05_keyword_count(spark, d):
    return R.count_if(table(spark, d, "documents"), "text", ["License", "the ", "@"], "blocks").select(big("blocks").alias("blocks"))


EVENTS_SQL = """
e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms, value,
        CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN 0 END AS kind
      FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
"""
PAIR_SQL = """
r AS (SELECT event_id AS seq, user_id AS k, kind AS x FROM e WHERE kind <> 0),
a AS (SELECT *, sum(x) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) s FROM r),
b AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) pm FROM a),
v AS (SELECT seq, k, x FROM b WHERE NOT (x = -1 AND s < pm)),
d AS (SELECT *, sum(x) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) + CASE WHEN x = -1 THEN 1 ELSE 0 END dep FROM v),
m AS (SELECT seq, k, x, lead(seq) OVER w nx, lead(x) OVER w nxx FROM d WINDOW w AS (PARTITION BY k, dep ORDER BY seq)),
t AS (SELECT m.seq, m.k AS user_id, o.ms AS start_ms, CASE WHEN nxx = -1 THEN nx END AS end_seq, CASE WHEN nxx = -1 THEN c.ms END AS end_ms
      FROM m JOIN e o ON o.event_id = m.seq LEFT JOIN e c ON c.event_id = m.nx WHERE m.x = 1)
"""
ASOF_SQL = """
q AS (SELECT p.event_id, p.user_id, p.ms, p.value, max(t.seq) AS seq
      FROM e p JOIN t ON t.user_id = p.user_id AND t.start_ms <= p.ms AND (t.end_ms IS NULL OR t.end_ms >= p.ms)
      WHERE p.kind = 0 GROUP BY ALL)
"""


def typed_events(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "error", 0)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error")).select("event_id", "user_id", ms.alias("ms"), "value", kind.alias("kind"))


def event_tasks(spark, d) -> DataFrame:
    moves = typed_events(spark, d).where("kind <> 0").withColumn("at", F.struct("event_id", "ms"))
    paired = L.pair_lifo(moves, ["user_id"], "at", "kind", "closed")
    return paired.select(F.col("event_id").alias("seq"), "user_id", F.col("ms").alias("start_ms"), F.col("closed.event_id").alias("end_seq"), F.col("closed.ms").alias("end_ms"))


def event_blocks(spark, d) -> DataFrame:
    points = typed_events(spark, d).where("kind = 0").drop("kind")
    return L.as_of(points, event_tasks(spark, d), "user_id", "ms", "event_id", "start_ms", "end_ms", "seq").select("event_id", "user_id", "ms", "value", F.col("interval.seq").alias("seq"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id, ms, kind::BIGINT AS kind FROM e")
def b06_typed_events(spark, d):
    return typed_events(spark, d).select("event_id", "user_id", "ms", big("kind").alias("kind"))


@query(f"WITH {EVENTS_SQL}, {PAIR_SQL} SELECT seq, user_id, start_ms, end_seq, end_ms FROM t")
def b07_lifo_pairs(spark, d):
    return event_tasks(spark, d)


@query(f"WITH {EVENTS_SQL}, {PAIR_SQL}, {ASOF_SQL} SELECT event_id, user_id, ms, seq FROM q")
def b08_as_of(spark, d):
    return event_blocks(spark, d).select("event_id", "user_id", "ms", "seq")


@query(f"""WITH {EVENTS_SQL}, {PAIR_SQL}, {ASOF_SQL},
h AS (SELECT 'x' || (floor(value / 50))::BIGINT AS warning_key, floor(ms / 3600000)::BIGINT::VARCHAR AS location, user_id, min(event_id) AS s FROM q GROUP BY 1, 2, 3)
SELECT warning_key, location, array_to_string(list(user_id ORDER BY s), ',') AS entries, count(*) AS n_entries, min(s) AS seq FROM h GROUP BY 1, 2""")
def b09_warning_rollup(spark, d):
    key, place = F.concat(F.lit("x"), big(F.floor(F.col("value") / 50)).cast("string")), big(F.floor(F.col("ms") / 3600000)).cast("string")
    hits = event_blocks(spark, d).select(key.alias("warning_key"), place.alias("location"), F.col("user_id").cast("string").alias("entry"), F.lit("X").alias("code"), F.lit("m").alias("message"), F.col("event_id").alias("seq"))
    return D.by_place(hits).select("warning_key", "location", F.array_join("entries", ",").alias("entries"), big(F.size("entries")).alias("n_entries"), "seq")


@query(f"""WITH {EVENTS_SQL}, {PAIR_SQL}, f AS (SELECT user_id, min(seq) AS seq FROM t GROUP BY 1)
SELECT event_id, e.user_id, f.seq, t.start_ms FROM e JOIN f USING (user_id) JOIN t ON t.seq = f.seq WHERE e.kind = 0""")
def b10_first_match(spark, d):
    points = typed_events(spark, d).where("kind = 0").select("event_id", "user_id")
    return L.first_of(points, event_tasks(spark, d), ["user_id"], "seq").select("event_id", "user_id", "first.seq", "first.start_ms")


@query("""
SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1, 2
""")
def b11_last_wins(spark, d):
    rows = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return V.last_wins(rows, ["o_custkey", "o_orderpriority"], "o_orderstatus", "at").drop("first_seen")


FACTS_SQL = """
f AS (SELECT DISTINCT n_regionkey AS file, c_mktsegment AS kind, c_nationkey AS entry, o_orderpriority || o_orderstatus AS define
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
everywhere AS (SELECT define FROM f GROUP BY 1 HAVING count(DISTINCT (file, kind, entry)) = (SELECT count(DISTINCT (file, kind, entry)) FROM f)),
by_kind AS (SELECT g.kind, g.define FROM (SELECT kind, define, count(DISTINCT (file, entry)) n FROM f GROUP BY ALL) g
            JOIN (SELECT kind, count(DISTINCT (file, entry)) n FROM f GROUP BY ALL) s USING (kind) WHERE g.n = s.n AND g.define NOT IN (SELECT define FROM everywhere)),
by_group AS (SELECT g.file, g.kind, g.define FROM (SELECT file, kind, define, count(DISTINCT entry) n FROM f GROUP BY ALL) g
             JOIN (SELECT file, kind, count(DISTINCT entry) n FROM f GROUP BY ALL) s USING (file, kind)
             WHERE g.n = s.n AND g.define NOT IN (SELECT define FROM everywhere) AND (g.kind, g.define) NOT IN (SELECT (kind, define) FROM by_kind))
"""


def variant_facts(spark, d) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_regionkey").alias("file"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("entry"), F.concat("o_orderpriority", "o_orderstatus").alias("define")).distinct()


@query(f"""WITH {FACTS_SQL}
SELECT 'all' AS level, NULL::VARCHAR AS file, NULL::VARCHAR AS kind, define FROM everywhere
UNION ALL SELECT 'kind', NULL, kind, define FROM by_kind UNION ALL SELECT 'group', file::VARCHAR, kind, define FROM by_group""")
def b12_common_levels(spark, d):
    facts = variant_facts(spark, d).withColumn("file", F.col("file").cast("string"))
    return V.common_values(facts, "kind", "file", ["entry"], "define")


@query(f"""WITH {FACTS_SQL}
SELECT file, kind, entry, define FROM f WHERE define NOT IN (SELECT define FROM everywhere)
  AND (kind, define) NOT IN (SELECT (kind, define) FROM by_kind) AND (file, kind, define) NOT IN (SELECT (file, kind, define) FROM by_group)""")
def b13_residual(spark, d):
    facts = checkpoint(variant_facts(spark, d))
    return V.residual_values(facts, V.common_values(facts, "kind", "file", ["entry"], "define"), "kind", "file", "define").select("file", "kind", "entry", "define")


@query("""
SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM events GROUP BY 1
""")
def b14_flatten_sort(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.array("event_type")).alias("nested"))
    return rows.select("user_id", F.array_join(C.flatten_defines("nested"), ",").alias("types"))


@query("""
SELECT count(*) FILTER (lower(event_type) IN ('click', 'view')) AS suppressed, count(*) FILTER (lower(event_type) NOT IN ('click', 'view')) AS kept FROM events
""")
def b15_suppression(spark, d):
    hit = D.is_suppressed(F.col("event_type"), ["CLICK", "View"])
    return table(spark, d, "events").agg(big(F.count_if(hit)).alias("suppressed"), big(F.count_if(~hit)).alias("kept"))


HALVES_SQL = """
h AS (SELECT event_id, event_type AS warning_key, user_id::VARCHAR AS entry, floor(value)::BIGINT::VARCHAR AS location,
        event_id < (SELECT count(*) / 2 FROM events) AS old FROM events)
"""


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    n = events.count()
    rows = events.select("event_id", F.col("event_type").alias("warning_key"), F.col("user_id").cast("string").alias("entry"), big(F.floor("value")).cast("string").alias("location"))
    return rows.where(F.col("event_id") < n / 2), rows.where(F.col("event_id") >= n / 2)


@query(f"""WITH {HALVES_SQL},
base AS (SELECT warning_key, entry, count(DISTINCT location) AS n FROM h WHERE old GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY warning_key, entry, location ORDER BY event_id) = 1 AS first FROM h WHERE NOT old),
s AS (SELECT *, sum(first::INT) OVER (PARTITION BY warning_key, entry ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM c)
SELECT event_id, warning_key NOT IN (SELECT warning_key FROM h WHERE old) OR seen > coalesce(n, 0) AS is_new
FROM s LEFT JOIN base USING (warning_key, entry)""")
def b16_running_baseline(spark, d):
    old, new = halves(spark, d)
    return D.running_new(new, old, "warning_key", "entry", "location", "event_id").select("event_id", "is_new")


@query(f"""WITH {HALVES_SQL},
u AS (SELECT warning_key, location, entry, bool_or(old)::INT AS b, bool_or(NOT old)::INT AS n FROM h GROUP BY 1, 2, 3)
SELECT warning_key AS file, sum(b)::BIGINT AS baseline, sum(n * (1 - b))::BIGINT AS new, sum(b + n)::BIGINT AS total FROM u GROUP BY 1 HAVING sum(n * (1 - b)) > 0""")
def b17_file_summary(spark, d):
    old, new = (x.withColumnRenamed("warning_key", "file") for x in halves(spark, d))
    found = D.file_summary(old, new, "file", ["file", "location", "entry"])
    return found.select("file", *[big(c).alias(c) for c in ("baseline", "new", "total")])


@query("""
WITH c AS (SELECT count(*) FILTER (event_type = 'view') AS baseline_count, count(*) FILTER (event_type = 'click') AS new_count, count(*) FILTER (event_type = 'error') AS n FROM events),
l AS (SELECT unnest([-100000, -10, 0, 5, 100000]) AS lim), e AS (SELECT unnest([0, n]) AS errors, baseline_count, new_count FROM c)
SELECT lim::BIGINT AS lim, errors, CASE WHEN errors > 0 THEN 1 WHEN lim < 0 THEN (baseline_count + new_count > greatest(0, baseline_count - abs(lim)))::INT ELSE (new_count > lim)::INT END::BIGINT AS exit_code
FROM e, l
""")
def b18_gate(spark, d):
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    counts = table(spark, d, "events").agg(is_("view").alias("baseline_count"), is_("click").alias("new_count"), is_("error").alias("n"))
    limits = counts.select("*", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("errors")).select("*", F.explode(F.array(*[F.lit(x) for x in (-100000, -10, 0, 5, 100000)])).alias("lim"))
    return D.gate(limits, F.col("lim")).select(big("lim").alias("lim"), "errors", big("exit_code").alias("exit_code"))


@query("""
SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 3
""")
def b19_top_share(spark, d):
    counted = D.share(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n")
    return D.top(counted, [F.desc("n"), F.asc("event_type")], 3).select("event_type", "n", F.round("percent", 6).alias("percent"))


@query("""
WITH p AS (SELECT event_type || '.hlsl:' || user_id AS shader_key, floor(value)::BIGINT::VARCHAR AS location, 'X' || event_id % 2 AS code, user_id || 'P' || event_id % 5 AS shader_type, event_id FROM events WHERE event_type IN ('error', 'click'))
SELECT shader_key, location, code, arg_min(shader_type, event_id) AS shader_type FROM p GROUP BY ALL
""")
def b20_error_rollup(spark, d):
    rows = table(spark, d, "events").where("event_type in ('error', 'click')")
    user = F.col("user_id").cast("string")
    shown = rows.select(F.concat(F.lit("src/Shaders/"), "event_type", F.lit(".hlsl")).alias("file"), user.alias("entry"), F.concat(user, F.lit("P"), (F.col("event_id") % 5).cast("string")).alias("shader_type"), F.lit("error").alias("severity"), big(F.floor("value")).cast("string").alias("location"), F.concat(F.lit("X"), (F.col("event_id") % 2).cast("string")).alias("code"), F.lit("m").alias("message"), F.col("event_id").alias("seq"))
    return D.errors(shown).select("shader_key", "location", "code", "shader_type")


@query("""
WITH n AS (SELECT DISTINCT s_nationkey::VARCHAR AS path FROM supplier WHERE s_acctbal > 0)
SELECT c_custkey, coalesce(a.path, b.path) AS dst FROM customer
LEFT JOIN n a ON a.path = c_nationkey::VARCHAR LEFT JOIN n b ON b.path = ((c_nationkey + 1) % 25)::VARCHAR WHERE coalesce(a.path, b.path) IS NOT NULL
""")
def b21_resolve_first(spark, d):
    nodes = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("path")).distinct()
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("one"), ((F.col("c_nationkey") + 1) % 25).cast("string").alias("two"))
    return G.resolve(wanted, nodes, ["one", "two"]).select("c_custkey", "dst")


EDGES_SQL = "g AS (SELECT p_partkey AS src, p_partkey // (2 + p_size % 2) AS dst FROM part WHERE p_partkey // (2 + p_size % 2) >= 1)"


def part_edges(spark, d) -> DataFrame:
    """Every part points to the part at a half or a third of its key: a tree of a few levels over the whole table."""
    below = big(F.floor(F.col("p_partkey") / (2 + F.col("p_size") % 2)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), below.alias("dst")).where("dst >= 1")


#: The changed parts that b23 and b24 ask about.
SEEDS = (5, 6, 7)


@query(f"""WITH {EDGES_SQL}, nodes AS (SELECT src AS path FROM g UNION SELECT dst FROM g), u AS (SELECT dst, array_to_string(list_sort(list(src::VARCHAR)), ',') AS users FROM g GROUP BY 1)
SELECT path::VARCHAR AS path, coalesce(users, '') AS users FROM nodes LEFT JOIN u ON dst = path""")
def b22_invert(spark, d):
    edges = part_edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("path"))
    return G.invert(nodes, edges).select("path", F.array_join("users", ",").alias("users"))


REACH_SQL = f"WITH RECURSIVE {EDGES_SQL}, s AS (SELECT unnest([5, 6, 7])::BIGINT AS path), r AS (SELECT path FROM s UNION SELECT src FROM r JOIN g ON dst = path)"


@query(f"{REACH_SQL} SELECT path FROM r")
def b23_reachable(spark, d):
    return G.reachable(part_edges(spark, d), spark.createDataFrame([(s,) for s in SEEDS], "path long"), "dst", "src")


@query(f"{REACH_SQL} SELECT p_partkey, p_type, 'known' AS seeds FROM part WHERE p_partkey IN (SELECT path FROM r) UNION ALL SELECT p_partkey, p_type, 'unknown' FROM part")
def b24_incremental(spark, d):
    edges = part_edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    parts = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_partkey").cast("string").alias("file"))
    nodes = parts.select(F.col("file").alias("path"))
    changed = lambda *more: spark.createDataFrame([(str(s),) for s in (*SEEDS, *more)], "path string")
    some, _ = G.incremental_tasks(parts, nodes, edges, changed())
    every, _ = G.incremental_tasks(parts, nodes, edges, changed("no such part"))
    return some.select("p_partkey", "p_type", F.lit("known").alias("seeds")).unionByName(every.select("p_partkey", "p_type", F.lit("unknown").alias("seeds")))


@query("""
SELECT doc_id, c AS combo, CASE c WHEN 'PSHADER' THEN 'PSHADER' WHEN 'PSHADER_VR' THEN 'PSHADER,VR' WHEN 'VSHADER' THEN 'VSHADER' ELSE 'VSHADER,VR' END AS defines
FROM documents, (SELECT unnest(['PSHADER', 'PSHADER_VR', 'VSHADER', 'VSHADER_VR']) AS c)
""")
def b25_combos(spark, d):
    return R.with_combos(table(spark, d, "documents").select("doc_id")).select("doc_id", "combo", F.array_join("defines", ",").alias("defines"))


@query("""
SELECT 'features/F' || l_partkey % 7 || '/x.hlsl' AS path, l_partkey AS line, ['t', 'u', 's', 'b'][l_partkey % 4 + 1] || l_partkey % 16 AS register, 'F' || l_partkey % 7 AS feature,
  ['SRV', 'UAV', 'Sampler', 'CBV'][l_partkey % 4 + 1] AS register_type, 'n' || l_partkey AS name, bool_or(l_returnflag = 'A') AS pshader, bool_or(l_returnflag = 'R') AS vshader, bool_or(l_returnflag = 'N') AS vr,
  array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ',') AS combos FROM lineitem GROUP BY l_partkey
""")
def b26_registers(spark, d):
    key = F.col("l_partkey")
    text = lambda c: c.cast("string")
    define = F.when(F.col("l_returnflag") == "A", "PSHADER").when(F.col("l_returnflag") == "R", "VSHADER").otherwise("VR")
    found = table(spark, d, "lineitem").select(F.concat(F.lit("features/F"), text(key % 7), F.lit("/x.hlsl")).alias("path"), key.alias("line"), F.concat("l_returnflag", "l_linestatus").alias("combo"), F.array(define).alias("defines"), F.concat(F.lit("n"), text(key)).alias("name"), F.lit("T").alias("type"), F.lit(None).cast("string").alias("template_type"), F.get(F.array(*map(F.lit, "TUSB")), (key % 4).cast("int")).alias("register_class"), (key % 16).alias("number"))
    return S.registers(found).select("path", "line", "register", "feature", "register_type", "name", "pshader", "vshader", "vr", F.array_join("combos", ",").alias("combos"))


@query("""
SELECT p_type, p_size::BIGINT AS p_size, count(DISTINCT p_brand) AS features, array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS feature_list FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_brand) > 1
""")
def b27_conflicts_by_unit(spark, d):
    return S.conflicts_by_unit(table(spark, d, "part").withColumn("p_size", big("p_size")), ["p_type"], "p_size", "p_brand")


@query("SELECT p_size::BIGINT AS p_size, p_type, count(*) AS uses FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def b28_conflicts_by_combo(spark, d):
    return S.conflicts_by_combo(table(spark, d, "part").withColumn("p_size", big("p_size")), "p_size", "p_type")


@query("SELECT l_orderkey, sum(ceil(l_quantity / 16) * 16)::BIGINT AS aligned, sum(l_quantity::BIGINT)::BIGINT AS packed FROM lineitem GROUP BY 1")
def b29_aligned_size(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(big("l_quantity")).alias("sizes"))
    return lists.select("l_orderkey", C.aligned_size(F.col("sizes")).alias("aligned"), C.packed_size(F.col("sizes")).alias("packed"))


@query("""
WITH f AS (SELECT l_orderkey, list(CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 16 + 4 ELSE -1 END ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place,
                  list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_extendedprice) AS size FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, list_reduce(list_prepend([0::BIGINT, 0::BIGINT], list_transform(range(1, len(size) + 1), lambda i: [place[i]::BIGINT, size[i]])),
        lambda s, x: [CASE WHEN x[1] >= 0 THEN greatest(s[1], x[1]) ELSE ((s[1] + 3) // 4) * 4 END + x[2],
                      greatest(s[2], CASE WHEN x[1] >= 0 THEN greatest(s[1], x[1]) ELSE ((s[1] + 3) // 4) * 4 END + x[2])]) AS s FROM f)
SELECT l_orderkey, ((s[2] + 15) // 16 * 16)::BIGINT AS size FROM r
""")
def b30_packoffset_size(spark, d):
    pack = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.lit(".y")))
    one = F.struct("l_linenumber", "l_partkey", "l_extendedprice", big("l_quantity").alias("size"), pack.alias("packoffset"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("fields"))
    return lists.select("l_orderkey", C.packoffset_size(F.col("fields")).alias("size"))


@query("""
WITH l AS (SELECT list_sort(list(DISTINCT l_partkey % 20)) AS v FROM lineitem GROUP BY l_orderkey), u AS (SELECT v, count(*) AS n FROM l GROUP BY 1)
SELECT sum(n)::BIGINT AS total_lists, count(*) AS unique_lists, count(*) FILTER (n > 1) AS shared_lists, sum(n - 1)::BIGINT AS references_saved, max(n) AS most_uses FROM u
""")
def b31_list_statistics(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 20)).alias("v"))
    return V.list_statistics(lists, "v")


def name_pairs(spark, d) -> DataFrame:
    # p_name has few distinct values (colours); the pairs are the report's own full comparison of two name lists
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b")))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT x.p_name AS a, y.p_name AS b, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) AS score FROM n x, n y
""")
def b32_jaro_winkler(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(jaro_winkler_udf()("a", "b"), 6).alias("score"))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part),
p AS (SELECT x.p_name AS a, y.p_name AS b, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) AS score FROM n x, n y WHERE x.p_name <> y.p_name),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM p WINDOW w AS (PARTITION BY a ORDER BY score DESC, b))
SELECT a, b, score, round(score - second, 6) AS gap FROM r WHERE rank = 1
""")
def b33_best_candidate(spark, d):
    score = F.round(jaro_winkler_udf()("a", "b"), 6)
    scored = name_pairs(spark, d).where("a <> b").select(F.xxhash64("a").alias("shader_id"), F.col("a").alias("shader_name"), F.lit(False).alias("boosted"), F.col("b").alias("host_name"), F.col("b").alias("host_file"), F.lit(1).alias("host_line"), F.lit(False).alias("flattened"), score.alias("similarity"), score.alias("score"))
    return K.best_candidates(scored).where("rank = 1").select(F.col("shader_name").alias("a"), F.col("host_name").alias("b"), "score", F.round(F.col("score") - F.col("second_score"), 6).alias("gap"))


@query()
def b34_name_similarity(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(name_similarity_udf()("a", "b"), 6).alias("score"))


@query()
def b35_greedy_alignment(spark, d):
    """The type words of every brand against those of every later brand, as layouts."""

    def run(parts):
        for part in parts:
            fields = lambda words: [{"name": w, "type": "float", "size": 4} for w in words]
            reports = [K.align({"name": r.a, "fields": fields(r.left)}, {"name": r.b, "fields": fields(r.right)}) for r in part.itertuples()]
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "score": [round(r["score"], 6) for r in reports], "matches": [r["field_matches"] for r in reports], "missing": [r["missing_fields"] for r in reports]})

    words = table(spark, d, "part").select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_type", "p_name"), "[^A-Za-z0-9]+")).alias("w"))
    lists = words.groupBy("p_brand").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    left, right = lists.select(F.col("p_brand").alias("a"), F.col("ws").alias("left")), lists.select(F.col("p_brand").alias("b"), F.col("ws").alias("right"))
    return left.crossJoin(right).where("a < b").mapInPandas(run, "a string, b string, score double, matches long, missing long")


@query("SELECT event_id, count(*) OVER (ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def b36_sliding_count(spark, d):
    rows = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return D.sliding_count(rows, F.col("ms"), 86_400_000).select("event_id", "in_window")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def b37_moving_average(spark, d):
    return D.moving_average(table(spark, d, "events"), "value", "event_id").select("event_id", F.round("average", 6).alias("average"))


@query("""
WITH w AS (SELECT event_id, event_type, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS context FROM events)
SELECT event_id, context FROM w WHERE event_type = 'error'
""")
def b38_context(spark, d):
    found = D.context_lines(table(spark, d, "events"), F.col("event_type") == "error", "event_id", "event_type", ["user_id"])
    return found.select("event_id", F.array_join("context", ",").alias("context"))


@query("""
SELECT r_name, array_to_string(list(s_suppkey::VARCHAR ORDER BY n_nationkey, s_suppkey), ',') AS leaves FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
""")
def b39_nested_flatten(spark, d):
    """Regions, nations and suppliers as layouts that hold each other, flattened."""
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))

    def layout(rows: DataFrame, name: Column, order: Column, member: Column, type_: Column) -> DataFrame:
        field = F.struct(member.alias("name"), type_.alias("type"), F.lit(4).alias("size"), F.lit(1).alias("array_size"), F.lit(False).alias("is_unknown_type"), F.lit(None).cast("string").alias("packoffset"))
        grouped = rows.groupBy(name.alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), field.alias("f")))), lambda x: x["f"]).alias("fields"))
        return grouped.select(F.lit("shader").alias("language"), "name", "fields", F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(False).alias("is_cbuffer"))

    key = lambda c: F.concat(F.lit("nation"), F.col(c).cast("string"))
    regions = layout(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("r_name"), F.col("n_nationkey"), F.col("n_name"), key("n_nationkey"))
    nations = layout(supplier, key("s_nationkey"), F.col("s_suppkey"), F.col("s_suppkey").cast("string"), F.lit("float"))
    # a nation without suppliers has no layout and would stay as a field, as an unknown type does
    flat = K.flatten(regions.unionByName(nations)).where(~F.col("name").startswith("nation"))
    leaves = F.transform(F.filter("flat", lambda f: f["type"] == "float"), lambda f: f["name"])
    return flat.select(F.col("name").alias("r_name"), F.array_join(leaves, ",").alias("leaves")).where("leaves <> ''")


@query(r"""
SELECT p_partkey, regexp_extract(t, '^([\w:]+)\s+(\w+)', 1) AS type, regexp_extract(t, '^([\w:]+)\s+(\w+)', 2) AS name,
  CASE regexp_extract(t, '^([\w:]+)', 1) WHEN 'float4' THEN 16 WHEN 'float3' THEN 12 ELSE 4 END::BIGINT AS size, regexp_extract(t, '^([\w:]+)', 1) NOT IN ('float4', 'float3') AS is_unknown_type
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'float4 ' WHEN 1 THEN 'float3 ' ELSE 'half2 ' END || replace(p_name, ' ', '_') AS t FROM part)
""")
def b40_parse_field(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "float4 ").when(F.col("p_size") % 3 == 1, "float3 ").otherwise("half2 ")
    text = F.concat(kind, F.replace("p_name", F.lit(" "), F.lit("_")))
    part = lambda i: F.regexp_extract(text, r"^([\w:]+)\s+(\w+)", i)
    size = C.field_size(part(1), F.lit(1))
    return table(spark, d, "part").select("p_partkey", part(1).alias("type"), part(2).alias("name"), big(size["size"]).alias("size"), size["is_unknown_type"].alias("is_unknown_type"))


@query(r"""
WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '_Pad' || p_size WHEN 1 THEN p_name || 'padding[3]' WHEN 2 THEN p_name || '_OUTPUT' ELSE p_name || '[' || p_size || ']' END AS name FROM part)
SELECT p_partkey, regexp_replace(name, '\[.*?\]$', '') AS bare, regexp_matches(lower(split_part(name, '[', 1)), '^_?pad|pad(ding)?$') AS padding, regexp_matches(upper(name), '_(IN|OUT)PUT$') AS io FROM n
""")
def b41_name_predicates(spark, d):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("_Pad"), size)).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit("padding[3]"))).when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit("_OUTPUT"))).otherwise(F.concat(F.col("p_name"), F.lit("["), size, F.lit("]")))
    return table(spark, d, "part").select("p_partkey", C.strip_array(name).alias("bare"), C.is_padding(name).alias("padding"), C.is_io_name(name).alias("io"))


@query("""
SELECT page_id, '/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/c' AS path FROM pages
""")
def b42_relative_path(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", C.relative_path(F.concat(F.lit("//a/../"), host, F.lit("/./b\\..//c/"))).alias("path"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type])), ',') AS defines, array_to_string([x for x in [p_brand, 'DEBUG=1', p_type] if x <> 'DEBUG=1'] || ['D3DCOMPILE_AVOID_FLOW_CONTROL'], ',') AS stripped FROM part
""")
def b43_defines(spark, d):
    nested = F.array(F.array("p_brand", F.lit(None).cast("string")), F.array("p_type", "p_brand"))
    stripped = C.strip_defines(F.array(F.col("p_brand"), F.lit("DEBUG=1"), F.col("p_type")), ["debug"])
    return table(spark, d, "part").select("p_partkey", F.array_join(C.flatten_defines(nested), ",").alias("defines"), F.array_join(stripped, ",").alias("stripped"))


@query(f"""WITH {HALVES_SQL}, k AS (SELECT warning_key || ':' || entry || ':' || location AS warning_key, old FROM h)
SELECT warning_key FROM k WHERE old EXCEPT SELECT warning_key FROM k WHERE NOT old""")
def b44_eliminated(spark, d):
    old, new = (x.select(F.concat_ws(":", "warning_key", "entry", "location").alias("warning_key")) for x in halves(spark, d))
    return D.eliminated(old, new)


#: The events as a log: event n is written at n milliseconds, on line 2n; an error also has a diagnostic on line 2n + 1.
LOG_SQL = EVENTS_SQL.replace("(epoch_us(ts) // 1000)", "event_id")
ENTRY_SQL = "'e' || user_id % 3 || ':Pixel:' || user_id % 10"


def event_log(spark, d) -> DataFrame:
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    time = F.concat(F.lit("["), two(F.floor(n / 3600000) % 24), F.lit(":"), two(F.floor(n / 60000) % 60), F.lit(":"), two(F.floor(n / 1000) % 60), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("] ["), F.col("user_id").cast("string"), F.lit("] [D] "))
    entry = F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"), F.lit(":Pixel:"), (F.col("user_id") % 10).cast("string"))
    opens = F.concat(time, F.lit("Compiling Data/Shaders/f"), (F.col("user_id") % 5).cast("string"), F.lit(".hlsl "), entry, F.lit(" to A=1 B"))
    diagnostic = F.concat(F.lit("Data\\Shaders\\W.hlsl("), (n % 50).cast("string"), F.lit("): warning X"), (n % 3).cast("string"), F.lit(": M"))
    lines = F.when(F.col("event_type") == "signup", F.array(opens)).when(F.col("event_type") == "purchase", F.array(F.concat(time, F.lit("Compiled shader "), entry))).otherwise(F.array(F.concat(time, F.lit("Shader logs:")), diagnostic))
    rows = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return rows.select(n, F.posexplode(lines).alias("p", "line")).select((2 * n + F.col("p")).cast("long").alias("line_no"), "line")


@query(f"""WITH {LOG_SQL}, {PAIR_SQL}
SELECT 2 * seq AS seq, user_id::VARCHAR AS process_id, {ENTRY_SQL} AS entry_point, 'Data/Shaders/f' || user_id % 5 || '.hlsl' AS file_path, 'A=1,B' AS defines, start_ms % 86400000 AS start_ms, end_ms % 86400000 AS end_ms FROM t""")
def b45_log_tasks(spark, d):
    return L.log_tasks(event_log(spark, d)).withColumn("defines", F.array_join("defines", ","))


@query(f"""WITH {LOG_SQL}, {PAIR_SQL}, {ASOF_SQL}
SELECT 'x' || event_id % 3 || ':m' AS warning_key, 'X' || event_id % 3 AS code, 'M' AS message, 'w.hlsl:' || event_id % 50 AS location, {ENTRY_SQL} AS entry, min(2 * event_id + 1) AS seq FROM q GROUP BY ALL""")
def b46_log_warnings(spark, d):
    lines = event_log(spark, d)
    return L.log_warnings(lines, checkpoint(L.log_tasks(lines)))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber::INT AS a, (1 + l_partkey % 8)::INT AS b, least(l_linenumber, l_quantity::INT % 4) AS exact, l_suppkey % 3 AS high, (l_partkey % 100) / 100.0 AS score,
             CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 100) / 100.0 END AS second, l_quantity::INT * 4 AS size, (l_orderkey % 100) / 100.0 AS names, l_linenumber % 4 AS diff FROM lineitem),
r AS (SELECT *, least(a, b) AS low, greatest(a, b) AS top, least(a, b) / greatest(a, b) AS ratio, (exact + high) / least(a, b) AS good FROM s),
j AS (SELECT *, CASE WHEN score < 0.5 THEN false WHEN ratio < (CASE WHEN top <= 3 THEN 0.4 ELSE 0.6 END) THEN false WHEN good < (CASE WHEN low <= 3 THEN 0.3 ELSE 0.5 END) THEN false
             WHEN names > 0.8 THEN score > 0.4 AND good > 0.2 WHEN size > (CASE WHEN top > 5 THEN 128 ELSE 64 END) THEN false
             ELSE NOT (second IS NOT NULL AND score - second < 0.05 AND score < 0.6) END AS accepted FROM r)
SELECT l_orderkey, l_linenumber, score, accepted, CASE WHEN NOT accepted OR diff / low > 0.5 OR score < 0.75 THEN 'Unmatched' WHEN diff = 0 THEN 'Matched' ELSE 'Mismatched (H)' END AS status FROM j
""")
def b47_acceptance(spark, d):
    q = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("total_fields"), (1 + F.col("l_partkey") % 8).cast("int").alias("host_total_fields"), F.least(F.col("l_linenumber"), q % 4).alias("exact_matches"),
        (F.col("l_suppkey") % 3).alias("high_sim_matches"), (F.col("l_partkey") % 100 / 100.0).alias("score"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 100 / 100.0).alias("second_score"), (q * 4).alias("size_difference"),
        (F.col("l_orderkey") % 100 / 100.0).alias("names"), (F.col("l_linenumber") % 4).alias("field_diff_count"), F.lit("H").alias("host_name"),
    )
    judged = rows.withColumn("accepted", K.good_enough(F.col("names"))).withColumn("status", K.status())
    return judged.select("l_orderkey", "l_linenumber", "score", "accepted", "status")

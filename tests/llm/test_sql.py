import pytest
import xxhash

from compare import assert_same, duck
from logloom.llm.entries import ORACLE_SQL
from logloom.llm.oracles import xxh64_sql


def test_xxh64_of_all_lengths():
    texts = ["é" * 20, "a b", *("xyz0" * 30 for _ in range(1)), *("qwertyuiop"[i % 10] * i for i in range(80))]
    con = duck()
    con.execute("CREATE TABLE src AS SELECT unnest(?) AS s", [texts])
    got = dict(con.execute(f"WITH RECURSIVE {xxh64_sql('src')} SELECT s, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t, 42) for t in texts}


@pytest.mark.parametrize("name,sf", [(n, "sf0.001") for n in sorted(ORACLE_SQL)] + [("op1_simhash", "sf0.01"), ("op8_license_scan", "sf0.01")])
def test_query_equals_sql(spark, name, sf):
    assert_same(spark, name, f"/root/testdata/{sf}")

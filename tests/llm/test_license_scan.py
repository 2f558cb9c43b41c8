import random

from logloom.llm.license_scan import TEMPLATES, scan_licenses, shingles_of, words_of


def slow(docs, templates=TEMPLATES, threshold=0.8):
    """Every template against every run of the text of as many shingles as the template's window."""
    out = set()
    for i, text in docs:
        words = words_of(text or "")
        for name, template in templates.items():
            want = shingles_of(template)
            size = len(want[0].split())
            have = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
            span = 1 << (len(want) - 1).bit_length()
            best = max((len(set(want) & set(have[k : k + span])) / len(want) for k in range(len(have))), default=0)
            if best >= threshold:
                out.add((i, name, round(best, 6)))
    return out


def fast(df):
    return {(r.doc_id, r.license_id, round(r.containment, 6)) for r in df.collect()}


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = fast(entry.queries()["op8_license_scan"](spark, sf))
    assert found == slow(docs) and len({n for _, n, _ in found}) >= 4


def test_edited_notices_and_edges_of_the_input(spark):
    rng = random.Random(3)
    docs = [(1, None), (2, ""), (3, "released  UNDER\nthe mit-license"), (4, "released under the MIT")]
    for i, (name, text) in enumerate(sorted(TEMPLATES.items()) * 4):
        words = text.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zzz"
        docs.append((10 + i, " ".join(rng.choices(["the", "of", "lorem"], k=30) + words + ["this", "work"] * 5)))
    docs += [(90, "Licensed under CC BY-NC 4.0. " * 3000), (91, "x " * 40000)]
    df = spark.createDataFrame([(i, t, "b") for i, t in docs + docs[:4]], "doc_id long, text string, band string")
    assert fast(scan_licenses(df)) == slow(docs)
    assert scan_licenses(df.where("doc_id > 1000")).count() == 0
    short = {"a": "two words", "b": "one"}
    few = spark.createDataFrame([(1, "Two. words"), (2, "only one here"), (3, "two")], "doc_id long, text string")
    assert fast(scan_licenses(few, short)) == {(1, "a", 1.0), (2, "b", 1.0)}

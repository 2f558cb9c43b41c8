import random

from logloom.operators.lifecycle import pair_lifo
from logloom.streaming.lifecycle import pair_stream


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(str(rng.randint(1, 2)), i, rng.choice([1, 1, -1]), f"e{rng.randint(1, 2)}", i * 10) for i in range(120)]
    schema = "process_id string, seq long, kind int, entry_point string, ms long"
    events = spark.createDataFrame(rows, schema)
    for n, part in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = pair_stream(stream).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seq, r.end_seq) for r in spark.table("paired").where("what = 'closed'").collect()}
    want = {(r.seq, r.end_seq) for r in pair_lifo(events, ["process_id", "entry_point"], "seq", "kind").where("end_seq is not null").collect()}
    assert got == want and got

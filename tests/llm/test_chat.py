import random

from pyspark.sql import functions as F

from compare import assert_same
from logloom.llm import chat


def test_query_equals_sql(spark):
    assert_same(spark, "op7_chat_formatting")


def test_escape_round_trip(spark):
    rng = random.Random(1)
    bits = ["&", "<", "&lt;", "&amp;", "[INST]", "[/INST]", "&#91;INST", "<|end|>", "<|turn|>", "\n", "a", "é", "😀", "&#10;", "<|image:0|>"]
    rows = [(i, k, rng.choice(["user", "assistant", "we\nird<", None]), "".join(rng.choices(bits, k=rng.randint(0, 9))) if rng.random() > 0.1 else None) for i in range(60) for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df)
    read = out.select("conv_id", chat.read_back(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])
        assert [(t.role, t.text) for t in r.read] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")


def test_parts_are_flattened_in_order(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="i.png", width=57, height=28), part("text", text=" and "), part("audio", ref="a.wav", seconds=1.5), part("film", ref="f")]),
        (1, 1, "assistant", [part("document", ref="d.pdf", pages=3), part("text", text="ok"), part("text", text=None)]),
        (2, 0, "user", []),
        (2, 1, "assistant", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chats(df, parts=F.col("parts")).collect()}
    assert got[1].formatted == "<|turn|>user\nsee &lt;<|image:0|> and <|audio:1|><|other:2|><|end|>\n<|turn|>assistant\n<|document:0|>ok<|end|>\n"
    assert [(a.turn, a.attachment.place, a.attachment.kind, a.attachment.ref, a.attachment.tokens) for a in got[1].attachments] == [(0, 0, "image", "i.png", 3), (0, 1, "audio", "a.wav", 38), (0, 2, "other", "f", 0), (1, 0, "document", "d.pdf", 768)]
    assert got[2].formatted == "<|turn|>user\n<|end|>\n<|turn|>assistant\n<|end|>\n" and got[2].attachments == []


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z" * 300000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    assert (got[None].n_turns, got[1].n_turns, got[1].loss_chars) == (1, 3, 300000)
    assert chat.digest(chat.format_chats(df.where("conv_id = 5"))).count() == 0

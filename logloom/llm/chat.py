"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts: text, image, audio or document. The visitor `flatten` turns
it into one string: text is escaped, any other part becomes a placeholder `<|kind:k|>` numbered through the
turn, and an attachment record keeps its kind, reference, place and the number of tokens it expands to.
A conversation is its turns in order, each `<|turn|>role NEWLINE content<|end|>NEWLINE`, with the spans of
assistant content as loss mask.

Escaping is reversible: `&` becomes `&amp;`, then `<` becomes `&lt;`, and `[INST` / `[/INST` lose their
bracket to `&#91;`; so no control string of this or the bracketed templates survives inside a text.

Defined results: null text is empty; a null role is empty; line ends inside a role are escaped; an unknown
kind of part becomes a placeholder of kind `other` with no tokens; rows are ordered by turn, then role, then
text, nulls first; repeated rows stay as turns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<kind: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>"


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ("[INST", "&#91;INST"), ("[/INST", "&#91;/INST")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, plain in (("&#91;", "["), ("&lt;", "<"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def expanded_tokens(part: Column, patch: int = 14, merge: int = 2, audio_rate: int = 25, page_tokens: int = 256) -> Column:
    """Tokens that replace a placeholder: merged patches of an image, frames of audio, pages of a document."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / (patch * merge))
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * page_tokens)
        .otherwise(F.lit(0))
        .cast("long")
    )


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    names = ["kind", "text", "ref", "width", "height", "seconds", "pages"]
    values = [F.lit("text"), F.coalesce(text, F.lit(""))] + [F.lit(None)] * 5
    return F.array(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]).cast(PART))


def flatten(parts: Column) -> Column:
    """struct(content, attachments) of an array of parts."""
    known = ("image", "audio", "document")
    is_text = lambda p: F.coalesce(p["kind"] == "text", F.lit(False))
    kind = lambda p: F.when(p["kind"].isin(*known), p["kind"]).otherwise(F.lit("other"))
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: ~is_text(p))
    seen = F.transform(
        parts,
        lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), kind(p), F.lit(":"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: ~is_text(q))).cast("string"), F.lit("|>"))
        ),
    )
    records = F.transform(others, lambda p, i: F.struct(i.cast("long").alias("place"), kind(p).alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.struct(F.array_join(seen, "").alias("content"), records.alias("attachments"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points from 0), attachments (with turn number)."""
    flat = flatten(text_part(F.col(text_col)) if parts is None else parts)
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        flat.alias("flat"),
    )
    one = F.struct(
        "turn",
        "role",
        F.col("flat.content").alias("content"),
        F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"),
        F.col("flat.attachments").alias("attachments"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def step(state, t):
        begin, length = state["at"] + F.length(t["head"]), F.length(t["content"])
        span = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct(
            (begin + length + len(END)).alias("at"),
            F.when(t["role"] == trained_role, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.cast("long").alias("turn"), a.alias("attachment"))))).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay in the text."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: F.length(t) > 0)
    cut = lambda t: F.locate("\n", t)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(t.substr(F.lit(1), cut(t) - 1)).alias("role"),
            unescape(t.substr(cut(t) + 1, F.length(t) - cut(t) - len(END))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return unescape(F.array_join(F.transform(spans, lambda s: formatted.substr(s["start"] + 1, s["length"])), ""))


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back of each formatted conversation."""
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("read"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are another template's control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))

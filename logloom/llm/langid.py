"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent 1- to 3-grams over words of letters padded by one space. A
document's most frequent n-grams are compared with every profile by out-of-place distance: the sum over
the document's n-grams of the difference of ranks, or `top` where the profile lacks the n-gram.

Profiles are fitted on a hash sample of about `sample_per_language` labelled rows of each language; that
bound and `most_languages` are the documented limits of the fit. Their n-gram counts are summed by a shuffle on (language, n-gram) and
only the `top` of each language reach the driver. Prediction is map-only over whole texts.

Defined results: a null text or one without letters is `und` with score 0; rows with a null language
don't train; with no training rows everything is `und`; ties of distance go to the smaller language name;
repeated rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import batches, ddl, id_and_text, keep, record_batch, utf8

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

def _is_letter() -> np.ndarray:
    """By code point: a letter, in the sense of str.isalpha."""
    return keep("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def letters(text: str) -> np.ndarray:
    """The text's letters as code points, a single space (32) before, between and after its words; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, points, np.uint32(32))[keep]
    if not len(chars):
        return chars
    return np.concatenate(([32], chars, [32]) if chars[-1] != 32 else ([32], chars)).astype(np.uint32)


def grams(chars: np.ndarray, start: int, end: int) -> np.ndarray:
    """The 1- to 3-grams that begin at start..end, as integers of 21 bits a character; a space stands alone nowhere."""
    part = chars[start : end + 2].astype(np.int64)
    one = part[: end - start]
    two = part[:-1] << 21 | part[1:]
    three = two[:-1] << 21 | part[2:]
    inside = part[1 : 1 + len(three)] != 32
    return np.concatenate((one[one != 32], two[: end - start], three[inside][: end - start]))


def counts(text: str, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts; long texts are counted in steps, which see two letters further."""
    keys, n, chars = np.zeros(0, np.int64), np.zeros(0, np.int64), letters(text)
    for at in range(0, len(chars), step):
        found = np.sort(grams(chars, at, min(len(chars), at + step)))
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(found)), bool), found[1:] != found[:-1])))
        new, size = found[first], np.diff(np.append(first, len(found)))
        if len(keys):
            both, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
            keys, n = both, np.bincount(where, np.concatenate((n, size)), len(both)).astype(np.int64)
        else:
            keys, n = new, size
    return keys, n


def top_grams(keys: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the n-gram's number."""
    most = np.flatnonzero(n >= np.partition(n, len(n) - top)[len(n) - top]) if len(n) > top else np.arange(len(n))
    return keys[most[np.argsort(-n[most], kind="stable")]][:top]


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, 100):
        for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            keys, n = counts(text.decode("utf-8", "replace"))
            if len(keys):
                yield record_batch(GRAMS, [[lang] * len(keys), keys, n])


class Profiles:
    """rank[i, l] is the rank of n-gram keys[i] in the profile of langs[l], or top if absent."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int) -> None:
        self.top, self.langs = top, sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), top, np.int64)
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.keys, gram), self.langs.index(lang)] = rank

    def predict(self, text: str) -> tuple[str, float]:
        found = top_grams(*counts(text), self.top)
        if not len(found) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, found)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == found
        ranks = self.rank[np.where(hit, at, len(self.keys))]
        own = np.arange(len(found))[:, None]
        distance = np.where(ranks < self.top, np.abs(ranks - own), self.top).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(found))


def _predict(profiles: Profiles):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 1000):
            ids, texts = (c.to_pylist() for c in part.columns)
            if ids:
                labels, scores = zip(*(profiles.predict(t.decode("utf-8", "replace")) for t in texts), strict=True)
                yield record_batch(PREDICTED, [ids, labels, scores])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 400, sample_per_language: int = 2000, most_languages: int = 1000) -> Profiles:
    """Profiles from a hash sample of about so many rows of each language (all rows where there are fewer).

    Of more than `most_languages` labels, the most frequent ones are learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    sized = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["n"] for r in sized.collect()}
    if not sizes:
        return Profiles([], top)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_per_language / n))])
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0))), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000
    counted = rows.where(drawn).select(F.col(lang_col).alias("lang"), utf8(text_col).alias("t")).mapInArrow(_count, ddl(GRAMS))
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    return Profiles([(r["lang"], r["gram"], r["r"] - 1) for r in best.select("lang", "gram", "r").collect()], top)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_predict(profiles), ddl(PREDICTED))


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that never train: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _keep(profiles: Profiles, column: int, least: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 1000):
            found = (profiles.predict(t or "") for t in part.column(column).to_pylist())
            yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return run


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.15) -> DataFrame:
    """The rows of docs, all columns, whose language is one of the profiles' with at least this score."""
    return docs.mapInArrow(_keep(profiles, docs.columns.index(text_col), least), docs.schema)

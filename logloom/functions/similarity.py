"""String similarities that have no built-in: Ratcliff-Obershelp names and Jaro-Winkler types.

Plain functions are the definition; the pandas UDFs apply them to Arrow batches and remember pairs within
a batch, since names repeat.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from logloom import schemas

NAME_BOUND = 0.7


def _bare(name: str) -> str:
    return re.sub(r"\[.*?\]$", "", name)


def _overlap(a: str, b: str) -> tuple[float, float]:
    """(ratio, matched characters over the longer name)."""
    matcher = difflib.SequenceMatcher(None, a, b)
    longer = max(len(a), len(b))
    matched = sum(m.size for m in matcher.get_matching_blocks())
    return matcher.ratio(), matched / longer if longer else 0.0


@lru_cache(maxsize=200_000)
def name_similarity(a: str, b: str) -> float:
    """Not symmetric. Containment lifts the score: to 0.9 where 70 % of the longer name is covered, else to 0.85."""
    a, b = a.lower(), b.lower()
    full, (bare_a, bare_b) = max(_overlap(a, b)), (_bare(a), _bare(b))
    bare = max(_overlap(bare_a, bare_b))
    shorter, longer = sorted((bare_a, bare_b), key=len)
    if shorter not in longer:
        return max(full, bare - 0.01)
    covered = bool(longer) and len(shorter) >= 0.7 * len(longer)
    return max(full, bare, 0.9 if covered else 0.85)


@lru_cache(maxsize=50_000)
def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1, boost_from: float = 0.7) -> float:
    """The common prefix (up to four) counts where the Jaro similarity exceeds `boost_from`; two empty strings: 0."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    n = len(left)
    score = (n / len(a) + n / len(b) + (n - moved) / n) / 3
    if score > boost_from:
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        score += prefix * prefix_weight * (1 - score)
    return score


def type_similarity(shader_type: str, host_type: str) -> float:
    """1 for equal types, a vector counting as its array; else Jaro-Winkler, 0 below 0.7."""
    m = re.match(r"(\w+)\[(\d+)\]", host_type)
    if schemas.ARRAY_TWINS.get(shader_type, shader_type) == (m[0] if m else host_type):
        return 1.0
    score = jaro_winkler(shader_type, host_type)
    return score if score >= 0.7 else 0.0


def _over_pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, "double")


def name_similarity_udf():
    return _over_pairs(name_similarity)


def jaro_winkler_udf():
    return _over_pairs(jaro_winkler)


def type_similarity_udf():
    return _over_pairs(type_similarity)

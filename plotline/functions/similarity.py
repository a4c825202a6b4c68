"""comparison of two texts, as Arrow UDFs on candidate pairs.

F13's ratio is difflib's by definition. Rows that cannot reach the floor are removed
natively first: a ratio never exceeds 2 * min(len) / (len + len).
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions.names import caseless

SEGMENTS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()),
                                     T.StructField("text", T.StringType())]))


@F.pandas_udf(T.DoubleType())
def ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """Similarity of two texts, older text first."""
    pairs = zip(old, new, strict=True)
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in pairs], dtype="float64")


def kept_places(before: list, after: list) -> list[tuple[int, int]]:
    """Places of what both lists keep, rising in both.

    The n-th occurrence of a value is paired with its n-th occurrence in the other list; of
    these pairs the longest rising run stays, found by the smallest last place for each length.
    """
    places: dict = {}
    for j, value in enumerate(after):
        places.setdefault(value, []).append(j)
    for held in places.values():
        held.reverse()
    lasts, ends, links = [], [], []
    for i, value in enumerate(before):
        if places.get(value):
            j = places[value].pop()
            n = bisect_left(lasts, j)
            links.append((i, j, ends[n - 1] if n else None))
            lasts[n:n + 1], ends[n:n + 1] = [j], [len(links) - 1]
    run, at = [], ends[-1] if ends else None
    while at is not None:
        i, j, at = links[at]
        run.append((i, j))
    return run[::-1]


@F.pandas_udf(SEGMENTS)
def word_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """runs of words kept (equal), gone (del) and new (ins), by ``kept_places``."""
    def segments(old: list[str], new: list[str]) -> list[dict]:
        marked = []
        kept = [*kept_places(old, new), (len(old), len(new))]
        for (a, b), (i, j) in zip([(-1, -1), *kept], kept):
            marked += [("del", w) for w in old[a + 1:i]] + [("ins", w) for w in new[b + 1:j]] + [("equal", w) for w in old[i:i + 1]]
        return [{"op": op, "text": " ".join(w for _, w in run)} for op, run in groupby(marked, key=lambda x: x[0])]
    return pd.Series([segments(a.split(" "), b.split(" ")) for a, b in zip(before, after, strict=True)])


def ratio_bound(a: Column, b: Column) -> Column:
    """The largest ratio two texts of these lengths can reach."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


def scene_score_bound(old_heading, new_heading, old_body, new_body) -> Column:
    return 0.3 * ratio_bound(caseless(old_heading), caseless(new_heading)) + 0.7 * ratio_bound(old_body, new_body)


def scene_score(old_heading, new_heading, old_body, new_body) -> Column:
    return (0.3 * ratio(caseless(old_heading), caseless(new_heading))
            + 0.7 * ratio(old_body, new_body))

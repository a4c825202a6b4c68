"""Sorted, searched and paged lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.names import fold
from plotline.functions.text import strip

PAGE_SIZES = (25, 50, 100)
# How severities and states weigh in an ordering.
SEVERITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}
STATUS_WEIGHT = {"open": 3, "dismissed": 2, "resolved": 1}


@dataclass(frozen=True)
class Listing:
    """One page of rows and the size of the whole match."""

    rows: DataFrame
    totals: DataFrame


def opens_ascending(key: str, default: str, numeric: bool) -> bool:
    """Dates, numbers and the default column open newest or largest first."""
    return not (key in (default, "when") or numeric)


def page(rows: DataFrame, cells: list[str], sort: str, numeric: bool, unique: str,
         ascending: bool, number: int = 1, size: int = 25, q: str = "",
         lead: str | None = None) -> Listing:
    """O1, O2: search, order, and cut one page.

    The totals are one combined aggregate whose single row decides the page: a
    number past the end clamps to the last one. The page itself is a top-k with
    an offset, so only its own rows are ranked. ``unique`` breaks ties.
    """
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    text = F.lower(F.concat_ws(" ", *cells))
    hit = F.contains(text, F.lit(q.strip().lower())) if q.strip() else F.lit(True)
    key = F.coalesce(F.col(sort).try_cast("double"), F.lit(0.0)) if numeric else F.lower(
        F.coalesce(F.col(sort).cast("string"), F.lit("")))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matching"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("matching") / size))
    totals = totals.withColumn("pages", pages).withColumn(
        "page", F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages")))
    start = (totals.first()["page"] - 1) * size
    first = [F.col(lead).desc()] if lead else []
    order = [*first, key.asc() if ascending else key.desc(), F.col(unique)]
    cut = rows.filter(hit).orderBy(*order).offset(start).limit(size)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) + start
    return Listing(cut.withColumn("_k", place), totals)


def weight(c: Column, weights: dict[str, int]) -> Column:
    """O3: an ordering key from a closed vocabulary."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[c], F.lit(0))


def natural_scene_key(number: Column) -> list[Column]:
    """Plain numbers first and by value, everything else after."""
    digits = number.rlike(r"^\d+$")
    return [(~digits).asc(), F.when(digits, number.try_cast("long")).asc_nulls_last(), number.asc()]


def find_scenes(asked: DataFrame, scenes: DataFrame) -> DataFrame:
    """The scene each request means: its printed number, its place, or its heading.

    ``asked``: request_id, script_id, wanted. ``scenes``: scene_id, script_id,
    number, heading, sequence_index. Three equi joins, the best rule wins.
    """
    bare = strip(F.col("wanted"))
    scened = F.lower(bare).startswith("scene")
    word = F.when(scened, F.btrim(F.substr(bare, F.lit(6)), F.lit(" .:"))).otherwise(bare)
    w = asked.withColumn("_w", word)
    keys = scenes.select(
        "script_id", "scene_id", "sequence_index", strip(F.col("number")).alias("_number"),
        (F.col("sequence_index") + 1).cast("string").alias("_place"),
        fold(F.col("heading")).alias("_heading"))
    w = w.withColumn("_plain", F.regexp_replace("_w", r"^0+(?=\d)", "")).withColumn(
        "_folded", fold(F.col("_w")))

    def by(rule, left, right):
        hits = w.filter(F.col(left) != "").join(
            keys.withColumnRenamed(right, left), ["script_id", left])
        return hits.select("request_id", F.struct(
            F.lit(rule).alias("rule"), "sequence_index", "scene_id").alias("hit"))
    hits = by(1, "_w", "_number").unionByName(by(2, "_plain", "_place")).unionByName(
        by(3, "_folded", "_heading"))
    best = hits.groupBy("request_id").agg(F.min("hit").alias("hit"))
    return asked.select("request_id").join(best, "request_id", "left").select(
        "request_id", F.col("hit.scene_id").alias("scene_id"), F.col("hit.rule").alias("rule"))


def newest(rows: DataFrame, at: str, unique: str, n: int) -> DataFrame:
    """The newest n rows, a top-k without a full sort."""
    return rows.orderBy(F.col(at).desc(), F.col(unique).desc()).limit(n)

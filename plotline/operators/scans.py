"""Segmented scans: ordered work over keys of any size.

A window over one key runs in one task. Most keys are small and that is the right plan; a
key that holds a large share of all rows is not. ``Scan`` finds the keys over ``hot_rows``
by a map-side combined count. If there are none, it is a plain window. Otherwise the rows of
those keys are dealt by sampled quantiles of (keys, order) into blocks of about half that
many rows and written once with their block numbers. Blocks are scanned apart; what a row
needs from beyond its block comes from one summary row per block, rolled up over the blocks
before it, behind it, or all of its key. Rows with equal keys and order stay together.

Summaries compose: sums add, the last value seen is the last of the blocks' last values, the
next row of a block's last row is the next block's first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plotline.session import durable

HOT_ROWS = 1_000_000
#: Blocks of one scan at most: beyond this times ``hot_rows`` / 2 rows, blocks grow instead.
MOST_BLOCKS = 20_000
_BLOCK, _PLACE = "_block", "_place"
BEFORE = (Window.unboundedPreceding, -1)
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def null_safe(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


class Scan:
    """A frame whose rows are scanned in ``order`` within ``keys``; methods add columns."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], hot_rows: int | None = None):
        self.keys, self.order = keys, order
        limit = HOT_ROWS if hot_rows is None else hot_rows
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
        rows = sizes.agg(F.sum("_rows")).first()[0] or 0
        self.cut = rows > 0
        if not self.cut:
            self.frame = df.withColumn(_BLOCK, F.lit(None).cast("int"))
            return
        # At most one row for each ``limit`` rows; shuffled on the key, all rows of a hot key would be one task.
        hot = sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
        marked = df.join(F.broadcast(hot), null_safe(df, hot, {k: f"_hot_{k}" for k in keys}), "left").drop(*[f"_hot_{k}" for k in keys])
        blocks = min(MOST_BLOCKS, -(-2 * rows // limit))
        dealt = marked.filter("_hot").drop("_hot").repartitionByRange(blocks, *keys, *order)
        cold = marked.filter("_hot IS NULL").drop("_hot").withColumn(_BLOCK, F.lit(None).cast("int"))
        self.frame = durable(dealt.withColumn(_BLOCK, F.spark_partition_id())).unionByName(cold)

    def window(self) -> WindowSpec:
        """The rows of one block."""
        return Window.partitionBy(*self.keys, _BLOCK).orderBy(*self.order)

    def add(self, columns: dict[str, Column]) -> Scan:
        self.frame = self.frame.withColumns(columns)
        return self

    def carry(self, parts: dict[str, tuple[Column, Callable[[Column], Column]]], reach: tuple[int, int] = BEFORE,
              behind: bool = False) -> Scan:
        """Join what the other blocks of a row's key within ``reach`` come to; null where there are none.

        ``parts`` maps a column to (aggregate of one block, roll-up of blocks in their order).
        With ``behind`` the blocks are taken from the last one on.
        """
        if not self.cut:
            blocks = self.frame.groupBy().agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
            shape = blocks.groupBy().agg(*[roll(F.col(name)).alias(name) for name, (_, roll) in parts.items()]).schema
            return self.add({field.name: F.lit(None).cast(field.dataType) for field in shape})
        summary = (self.frame.filter(F.col(_BLOCK).isNotNull()).groupBy(*self.keys, _BLOCK)
                   .agg(*[agg.alias(name) for name, (agg, _) in parts.items()]))
        over = Window.partitionBy(*self.keys).orderBy(F.col(_BLOCK).desc() if behind else F.col(_BLOCK)).rowsBetween(*reach)
        rolled = summary.select(
            *[F.col(k).alias(f"_c_{k}") for k in self.keys], F.col(_BLOCK).alias("_c_block"),
            *[roll(F.col(name)).over(over).alias(name) for name, (_, roll) in parts.items()])
        condition = (null_safe(self.frame, rolled, {k: f"_c_{k}" for k in self.keys})
                     & (self.frame[_BLOCK] == rolled["_c_block"]))
        self.frame = self.frame.join(rolled, condition, "left").drop("_c_block", *[f"_c_{k}" for k in self.keys])
        return self

    def done(self, *extra: str) -> DataFrame:
        return self.frame.drop(_BLOCK, _PLACE, *extra)

    def _placed(self) -> Scan:
        """The place of each row in its block, by which first and last rows are told."""
        return self if _PLACE in self.frame.columns else self.add({_PLACE: F.row_number().over(self.window())})

    def ordinal(self, name: str, counted: Column | None = None) -> Scan:
        """1-based position of each row in its key, or of the rows for which ``counted`` holds so far."""
        one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
        return self.total(name, one, inclusive=True)

    def total(self, name: str, value: Column, inclusive: bool = False) -> Scan:
        """The sum of ``value`` over earlier rows of the key (0 at first), with ``inclusive`` the row's own too."""
        self.add({"_value": value}).carry({"_before": (F.sum("_value"), F.sum)})
        inside = F.sum("_value").over(self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        self.add({name: F.coalesce(inside, F.lit(0)) + F.coalesce("_before", F.lit(0))})
        self.frame = self.frame.drop("_value", "_before")
        return self

    def of_key(self, parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> Scan:
        """Aggregates of all rows of the key, each with the roll-up that joins its blocks' values."""
        self.carry({f"_all_{name}": part for name, part in parts.items()}, WHOLE)
        block = Window.partitionBy(*self.keys, _BLOCK)
        self.add({name: F.coalesce(f"_all_{name}", agg.over(block)) for name, (agg, _) in parts.items()})
        self.frame = self.frame.drop(*[f"_all_{name}" for name in parts])
        return self

    def previous(self, columns: dict[str, Column]) -> Scan:
        """The values of the row before, null for the first of a key."""
        return self._neighbour(columns, F.lag, F.max_by, False)

    def following(self, columns: dict[str, Column]) -> Scan:
        """The values of the row behind, null for the last of a key."""
        return self._neighbour(columns, F.lead, F.min_by, True)

    def _neighbour(self, columns, step, pick, behind) -> Scan:
        self._placed().add({"_value": F.struct(*[c.alias(name) for name, c in columns.items()])})
        self.carry({"_border": (pick("_value", _PLACE), F.last)}, behind=behind)
        self.add({"_beside": F.coalesce(step("_value").over(self.window()), F.col("_border"))})
        self.add({name: F.col("_beside")[name] for name in columns})
        self.frame = self.frame.drop("_value", "_border", "_beside")
        return self

    def last_seen(self, name: str, value: Column) -> Scan:
        """The last value that is not null, up to and with the row."""
        return self._seen(name, value, F.max_by, False)

    def next_seen(self, name: str, value: Column) -> Scan:
        """The first value that is not null, from the row on."""
        return self._seen(name, value, F.min_by, True)

    def _seen(self, name, value, pick, behind) -> Scan:
        self._placed().add({"_value": value})
        place = F.when(F.col("_value").isNotNull(), F.col(_PLACE))
        self.carry({"_border": (pick("_value", place), lambda c: F.last(c, ignorenulls=True))}, behind=behind)
        # A frame that reaches to the end is summed up anew for every row, so rows behind are taken backwards.
        along = Window.partitionBy(*self.keys, _BLOCK).orderBy(F.col(_PLACE).desc()) if behind else self.window()
        inside = F.last("_value", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
        self.add({name: F.coalesce(inside, F.col("_border"))})
        self.frame = self.frame.drop("_value", "_border")
        return self


def ordinal(df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return Scan(df, keys, order, hot_rows).ordinal(name).add({name: F.col(name).cast("long")}).done()


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                hot_rows: int | None = None) -> DataFrame:
    """The sum of ``value`` over strictly earlier rows of the key (0 at first)."""
    return Scan(df, keys, order, hot_rows).total(name, value).done()


def bursts(df: DataFrame, keys: list[str], ts: str, tiebreak: str, gap_seconds: int, name: str,
           hot_rows: int | None = None) -> DataFrame:
    """The first timestamp of the burst each row belongs to.

    A burst ends when the next row of the key comes strictly more than
    ``gap_seconds`` later; a gap of exactly that length stays inside.
    """
    scan = Scan(df, keys, [F.col(ts), F.col(tiebreak)], hot_rows).previous({"_previous": F.col(ts)})
    limit = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    opens = F.when(F.col("_previous").isNull() | (F.col(ts) > F.col("_previous") + limit), F.col(ts))
    return scan.last_seen(name, opens).done("_previous")

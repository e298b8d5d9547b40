"""Lookups by time: the last value before each row, and the intervals that each row lies in. No key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.cluster import in_ranges

#: Rows of a range of (key, time); points of a cell above which it is split, where that is also a thousandth of all points.
RANGE_ROWS, CELL_POINTS = 500_000, 10_000


def as_of(rows: DataFrame, history: DataFrame, by: str, ts: str, value: str, order: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``value`` of the last row of ``history`` of the same ``by`` at or before ``ts``; null where there is none.

    Of history at one time the last in ``order`` counts, which defaults to the value. Rows and history are put into ranges of (by, ts)
    together. A range finds its own rows' values; for rows in front of a range's first history, the last history of the
    ranges before is carried over, one row for each key and range. Rows with a null key or time have no value, and history with a
    null key or time counts for none. A null in history is a value like others.
    """
    columns = rows.columns
    order = order or [value]
    last = history.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, ts, F.struct(F.lit(True).alias("there"), F.col(value).alias("value")).alias("h_"), F.struct(*order).alias("o_"))
    asked = rows.select(F.col(by), F.col(ts), F.struct(*columns).alias("r_"))
    # History comes before rows of the same time.
    both = asked.withColumn("side_", F.lit(1)).unionByName(last.withColumn("side_", F.lit(0)), allowMissingColumns=True)
    dealt, _ = in_ranges(both, [by, ts, "side_"], range_rows, "asof")
    inside = Window.partitionBy(by, "slice_").orderBy(ts, "side_", "o_").rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("own_", F.last("h_", ignorenulls=True).over(inside)).where("side_ = 1")
    ends = dealt.groupBy(by, "slice_").agg(F.max_by("h_", F.when(F.col("side_") == 0, F.struct(ts, "o_"))).alias("end_"))
    carried = ends.select(by, "slice_", F.last("end_", ignorenulls=True).over(Window.partitionBy(by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    found = own.join(carried, [by, "slice_"], "left")  # null keys find nothing, as they should
    return found.select("r_.*", F.coalesce("own_", "carried_")["value"].alias(value))


def inside_intervals(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, cell_points: int = CELL_POINTS) -> DataFrame:
    """Every row of ``points`` beside every row of ``intervals`` with the same ``by`` and start <= at < end, all columns of both.

    ``at``, ``start`` and ``end`` are whole numbers, such as microseconds; columns besides ``by`` have different names.
    Intervals are sorted by length into grids, each with cells four times as long as the last: an interval is a row for each of
    the two cells of its grid that it touches at most, however long it is. A point is a row for each grid in use. Cells of many
    points are split: their points are dealt out by hash and their intervals repeated for each share. Empty intervals, nulls
    and rows with a null key match nothing.
    """
    spans = intervals.where(F.col(start) < F.col(end)).withColumn("grid_", _grid(F.col(end) - F.col(start)))
    used = [r[0] for r in spans.select("grid_").distinct().collect()]  # 32 at most
    if not used:
        used = [0]
    spans = spans.withColumn("cell_", F.explode(F.sequence(F.expr(f"shiftright({start}, 2 * grid_)"), F.expr(f"shiftright({end} - 1, 2 * grid_)"))))
    spots = points.where(F.col(at).isNotNull() & F.col(by).isNotNull()).withColumn("grid_", F.explode(F.array(*map(F.lit, sorted(used))))).withColumn("cell_", F.expr(f"shiftright({at}, 2 * grid_)"))
    keys = [by, "grid_", "cell_"]
    counts = spots.groupBy(*keys).agg(F.count("*").alias("n_"))
    total = points.count()
    most = max(cell_points, total // 1000)
    # At most a thousand cells of each grid are hot.
    hot = counts.where(F.col("n_") > most).select(*keys, F.ceil(F.col("n_") / most).cast("int").alias("shares_"))
    dealt = spots.join(F.broadcast(hot), keys, "left").withColumn("share_", F.pmod(F.xxhash64(*points.columns), F.coalesce("shares_", F.lit(1))).cast("int")).drop("shares_")
    repeated = spans.join(F.broadcast(hot), keys, "left").withColumn("share_", F.explode(F.sequence(F.lit(0), F.coalesce("shares_", F.lit(1)) - 1))).drop("shares_")
    met = dealt.join(repeated, [*keys, "share_"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return met.drop("grid_", "cell_", "share_")


def _grid(length: Column) -> Column:
    """The least g with 4 ** g >= length."""
    bits = F.length(F.bin(length - 1))
    return F.when(length <= 1, 0).otherwise(F.floor((bits + 1) / 2)).cast("int")

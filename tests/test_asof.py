import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import asof, summaries
from tidemill.plans import catalogue


@pytest.mark.parametrize("range_rows", [10**6, 60, 7])
def test_as_of_equals_brute_force(spark, range_rows):
    """One key has most rows and history; ties, nulls, keys without history, rows before and after all history."""
    rng = random.Random(range_rows)
    key = lambda: rng.choice([0] * 8 + [1, 2, 3, None])
    history = [(key(), rng.choice([None, *range(200)]), f"s{rng.randrange(9)}" if rng.random() < 0.9 else None, i) for i in range(400)]
    rows = [(i, rng.choice([0] * 8 + [1, 2, 4, None]), rng.choice([None, *range(-5, 210)])) for i in range(500)]
    want = {}
    for i, k, t in rows:
        seen = [(ht, n, s) for hk, ht, s, n in history if None not in (k, t, ht) and hk == k and ht <= t]
        want[i] = max(seen, key=lambda x: x[:2])[2] if seen else None
    r = spark.createDataFrame(rows, "i int, k int, t int").repartition(5)
    h = spark.createDataFrame(history, "k int, t int, state string, n int").repartition(3)
    got = asof.as_of(r, h, "k", "t", "state", ["n"], range_rows=range_rows).collect()
    assert len(got) == len(rows) and {x.i: x.state for x in got} == want


def test_as_of_one_hot_key(spark):
    """All rows of one key: ranges are tasks of their own, and what is carried is a row for each."""
    r = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"), (F.col("id") * 3 + 1).alias("t"))
    h = spark.range(0, 100, 1, 2).select(F.lit(1).alias("k"), (F.col("id") * 6000).alias("t"), F.col("id").alias("state"))
    got = asof.as_of(r, h, "k", "t", "state", range_rows=10_000)
    assert got.where("state <> t div 6000").count() == 0 and got.count() == 200_000
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_as_of_nothing(spark):
    r, h = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, t int, state string")
    assert [tuple(x) for x in asof.as_of(r, h, "k", "t", "state").collect()] == [(1, 2, None)]
    assert asof.as_of(r.limit(0), h, "k", "t", "state").count() == 0


def _inside(spark, points, intervals, **more):
    p = spark.createDataFrame(points, "i int, k int, at long").repartition(4)
    s = spark.createDataFrame(intervals, "j int, k int, s long, e long").repartition(3)
    return asof.inside_intervals(p, s, "k", "at", "s", "e", **more)


@pytest.mark.parametrize("cell_points", [10_000, 20])
def test_intervals_equal_brute_force(spark, cell_points):
    """Intervals from one unit to very long ones, negative times, hot cells that are split."""
    rng = random.Random(4)
    points = [(i, rng.choice([0, 0, 0, 1, None]), rng.choice([rng.randrange(-1000, 1000), rng.randrange(-(10**12), 10**12), 17, None])) for i in range(600)]
    intervals = [(j, rng.choice([0, 1, 2, None]), s, s + rng.choice([-3, 0, 1, 2, 5, 64, 10**3, 10**7])) for j, s in ((j, rng.randrange(-1100, 1000)) for j in range(300))]
    intervals += [(900, 0, -(10**12), 10**12), (901, 0, 17, 18), (902, 1, None, 5), (903, 1, 5, None), (904, 0, -(2**61), 2**61)]
    want = sorted((i, j) for i, k, t in points for j, q, s, e in intervals if None not in (k, t, s, e) and k == q and s <= t < e)
    got = _inside(spark, points, intervals, cell_points=cell_points)
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want and len(want) > 1000


def test_a_very_long_interval_is_two_cells(spark):
    points = [(i, 1, i * 1000) for i in range(2000)]
    got = _inside(spark, points, [(0, 1, 0, 10**15), *((j, 1, j * 10, j * 10 + 5) for j in range(1, 400))])
    assert got.where("j = 0").count() == 2000 and got.count() == 2000 + 3
    assert _inside(spark, points, []).count() == 0 and _inside(spark, [], [(0, 1, 0, 5)]).count() == 0


def test_summaries_add_up_within_their_error(spark):
    small = spark.createDataFrame([("a", d, str(i)) for d in range(3) for i in range(d, d + 10)] + [("b", 0, None)], "keyword string, day int, id string")
    added = summaries.added_up(summaries.summarised(small, ["keyword", "day"]), ["keyword"])
    assert {r.keyword: r.n for r in added.select("keyword", summaries.counted(F.col("summary")).alias("n")).collect()} == {"a": 12, "b": 0}
    big = spark.range(0, 400_000, 1, 8).select((F.col("id") % 4).alias("day"), F.expr("cast(id div 2 as string)").alias("id"))
    held = spark.range(150_000, 300_000).select(F.col("id").cast("string").alias("id"))
    seen = summaries.added_up(summaries.summarised(big, ["day"]), []).withColumn("held", summaries.summarised(held, []).scalar())
    s, h = F.col("summary"), F.col("held")
    n, both, new, size = seen.select(summaries.counted(s), summaries.shared(s, h), summaries.missing(s, h), F.length(s)).first()
    error = 4 / 2 ** (summaries.LOG_SIZE / 2)  # four standard errors
    assert abs(n / 200_000 - 1) < error and abs(both - 50_000) < error * 300_000 and abs(new - 150_000) < error * 300_000
    assert size <= 8 * 2**summaries.LOG_SIZE + 64


def test_lists_add_up_with_null_ids(spark):
    rows = [("a", d, str(i)) for d in range(3) for i in range(d, d + 10)] + [("a", 1, None), ("b", 0, None), (None, 2, "007"), (None, 0, "7")]
    days = summaries.listed(spark.createDataFrame(rows, "keyword string, day int, id string"), ["keyword", "day"])
    held = spark.createDataFrame([("3",), ("3",), ("7",), (None,)], "id string")
    got = summaries.compared(summaries.listed(days, ["keyword"]), held, ["keyword"]).collect()
    assert {tuple(r) for r in got} == {("a", 12, 2, 10), ("b", 0, 0, 0), (None, 2, 1, 1)} and len(got) == 3


@pytest.mark.parametrize("null_held", [False, True])
def test_seen_summaries_are_exact_beyond_a_sketch(spark, tmp_path, null_held):
    """More ids of a keyword, and more held ids, than a sketch keeps; ids come on several days."""
    ids = {"en": range(20_000), "fr": range(15_000, 20_001), "de": range(4)}
    urls = [f"https://h/{k}/{i % len(of) + of[0]}.html" for k, of in ids.items() for i in range(2 * len(of))]
    spark.createDataFrame(list(enumerate([*urls, None, "https://h/it/1"])), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i,) for i in range(3, 18_000)] + [(None,)] * null_held, "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(k, len(of), len(h := {*of} & {*range(3, 18_000)}), 0 if null_held else len(of) - len(h)) for k, of in ids.items()}
    assert {tuple(r) for r in catalogue.QUERIES["seen_summaries"](spark, str(tmp_path)).collect()} == want

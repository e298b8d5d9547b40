import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemill.operators import hits, outcomes, runs, turns


def _brute(pages, found, held, order, cap):
    """One keyword after another; ``order`` lists (keyword, limit)."""
    held, out = set(held), []
    for t, (k, limit) in enumerate(order):
        new, got = {}, []
        for page in sorted({p for w, p, _, _ in found if w == k} | {p for w, p in pages if w == k}):
            if page > cap:
                break
            fresh = 0
            for _, p, pos, i in sorted(x for x in found if x[0] == k and x[1] == page):
                if i is not None and i not in held and i not in new:
                    new[i] = (p, pos)
                    fresh += 1
            if not fresh and (k, page) in pages:
                break
            got = list(new.items())
        for n, (i, (p, pos)) in enumerate(got[: max(0, limit)], 1):
            out.append((t, k, p, pos, i, n))
            held.add(i)
    return sorted(out)


def _make(spark, pages, found, held):
    return (
        spark.createDataFrame(sorted(pages), "keyword string, page int").repartition(3),
        spark.createDataFrame(found, "keyword string, page int, pos int, id string").repartition(4),
        spark.createDataFrame([(x,) for x in held], "id string"),
    )


def _corpus(rng, n_keywords, n_ids, n_pages, links):
    found, pages = [], set()
    for i in range(n_keywords):
        k = f"k{i}"
        for p in range(1, rng.randint(1, n_pages) + 1):
            if rng.random() < 0.95:
                pages.add((k, p))
            for pos in range(rng.randint(0, links)):
                found.append((k, p, pos, f"{int(n_ids * rng.random() ** 2)}"))
    return pages, found


@pytest.mark.parametrize("seed", range(4))
def test_turns_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    pages, found = _corpus(rng, 25, 60, 6, 6)
    found += [("k3", 1, 90, None), ("k4", 2, 91, "0")]
    held = [str(rng.randrange(60)) for _ in range(5)]
    order = [(f"k{rng.randrange(25)}", rng.choice([0, 1, 3, 8])) for _ in range(30)]  # some twice, some never
    own = spark.createDataFrame([(t, k, lim) for t, (k, lim) in enumerate(order)], "turn long, keyword string, lim int")
    want, frames = _brute(pages, found, held, order, 5), _make(spark, pages, found, held)
    for block_rows in (10**6, 40):
        report = []
        got = turns.in_turn(*frames, own, cap=5, block_rows=block_rows, report=report)
        assert sorted(map(tuple, got.collect())) == want
        assert report[0] == 1 if block_rows > 1000 else report[0] > 1


def test_turns_equal_the_fold(spark):
    rng = random.Random(11)
    pages, found = _corpus(rng, 6, 30, 5, 5)
    p, h, held = _make(spark, pages, found, ["1", "2"])
    names = [f"k{i}" for i in (3, 0, 5, 1, 4, 2)]
    step = lambda k, held: hits.search(p.where(F.col("keyword") == k), h.where(F.col("keyword") == k), held, 4, 4)
    want = sorted((r.keyword, r.page, r.pos, r.id, r.n) for r in outcomes.fold(names, held, step).collect())
    own = spark.createDataFrame(list(enumerate(names)), "turn long, keyword string")
    got = turns.in_turn(p, h, held, own, 4, 4, block_rows=15)
    assert sorted((r.keyword, r.page, r.pos, r.id, r.n) for r in got.collect()) == want


def test_two_thousand_keywords_that_all_want_the_same(spark):
    """Each keyword's ids are those of all others: k takes the k-th three. The number of jobs does not follow the keywords."""
    jobs = {}
    for n in (200, 2000):
        rows = spark.range(n).select(F.concat(F.lit("k"), "id").alias("keyword"), F.explode(F.sequence(F.lit(0), F.least(F.lit(3) * (F.col("id") + 1), F.lit(300)).cast("int"))).alias("pos"))
        rows = rows.select("keyword", F.lit(1).alias("page"), "pos", F.col("pos").cast("string").alias("id"))
        own = spark.range(n).select(F.col("id").alias("turn"), F.concat(F.lit("k"), "id").alias("keyword"))
        tracker, group = spark.sparkContext.statusTracker(), f"turns-{n}"
        spark.sparkContext.setJobGroup(group, "")
        got = turns.in_turn(rows.select("keyword", "page"), rows, spark.createDataFrame([], "id string"), own, 3).collect()
        spark.sparkContext.setJobGroup(None, None)
        jobs[n] = len(tracker.getJobIdsForGroup(group))
        taken = {}
        for r in got:
            taken.setdefault(r.turn, []).append(int(r.id))
        assert all(sorted(taken[t]) == [3 * t, 3 * t + 1, 3 * t + 2] for t in range(min(100, n))) and sum(map(len, taken.values())) == 301
    assert jobs[2000] <= jobs[200] + 10  # adaptive plans differ by a few


def test_turns_of_nothing(spark):
    p, h, held = _make(spark, {("k", 1)}, [("k", 1, 0, "a")], [])
    own = spark.createDataFrame([(0, "k")], "turn long, keyword string")
    assert turns.in_turn(p, h, held, own.limit(0)).count() == 0
    assert turns.in_turn(p, h.limit(0), held, own).count() == 0
    assert turns.in_turn(p, h, held, own, 0).count() == 0
    assert [r.id for r in turns.in_turn(p, h, held, own).collect()] == ["a"]


def test_one_keyword_has_all_rows(spark):
    """Ranks and first occurrences of one key, without a window over the key's rows."""
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("k").alias("keyword"), F.expr("cast(id div 40 as int)").alias("page"), F.col("id").alias("pos"), F.expr("cast(id % 30000 as string)").alias("id"))
    held = spark.createDataFrame([("5",)], "id string")
    got = hits.search(rows.select("keyword", "page"), rows, held, 25_000, 10_000)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(keyword" in plan and all("chunk_" in x[:60] or "page" in x[:60] for x in plan.split("windowspecdefinition(keyword")[1:])
    want = [(p // 40, p, str(p), n) for n, p in enumerate((p for p in range(30_000) if p != 5), 1)][:25_000]
    assert sorted((r.page, r.pos, r.id, r.n) for r in got.collect()) == want
    total = hits.page_progress(rows, held).agg(F.max("total"), F.sum("n_new"), F.sum("n_held")).first()
    assert tuple(total) == (29_999, 29_999, 2)


def test_a_run_is_stopped_while_it_is_under_way(spark):
    """The keyword under way is broken off, those before it stay, none is begun behind it."""
    run, begun = runs.Run(spark), []
    slow = F.udf(lambda i: time.sleep(0.5) or i, "long")

    def step(k, held):
        begun.append(k)
        rows = spark.range(2 if k != "c" else 4000, numPartitions=2)
        ids = rows.select(F.lit(k).alias("keyword"), F.concat(F.lit(k), "id").alias("id"))
        return ids if k != "c" else rows.select(F.lit(k).alias("keyword"), slow("id").cast("string").alias("id"))

    def stop():
        while "c" not in begun:
            time.sleep(0.05)
        time.sleep(2)
        runs.Run(spark, run.name).stop()

    thread = threading.Thread(target=stop)
    thread.start()
    at = time.time()
    got = outcomes.fold(list("abcde"), spark.createDataFrame([], "id string"), step, run).collect()
    thread.join()
    assert sorted(r.id for r in got) == ["a0", "a1", "b0", "b1"] and begun == ["a", "b", "c"] and time.time() - at < 120
    with pytest.raises(RuntimeError, match="stopped before"):
        outcomes.fold(["d"], spark.createDataFrame([], "id string"), step, run)
    run.clear()
    assert outcomes.fold(["d"], spark.createDataFrame([], "id string"), step, run).count() == 2
    with pytest.raises(ValueError, match="own"), run.step():
        raise ValueError("own")

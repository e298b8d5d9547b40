"""Filter interaction audit by a histogram of failure masks.

Every text gets a mask of five bits, one for each filter that it fails; native expressions find four of them, and grouping by
text the fifth: a row fails it where its doc_id is larger than the smallest one of its text. Rows are reduced to (text
digest, mask, part, labels) with their number and smallest doc_id, so however many copies a text has, one row of
each part stands for them before digests meet. What is left are 32 cells for each part, and all orders of the filters are
computed from these: no text is looked at again.

Texts are compared by SHA-256 and length. Null texts count as empty, and so are copies of each other and of empty texts. A null
doc_id is never larger than another nor smaller, and has no labels. Rows that repeat a doc_id with its text are the same
smallest row: none of them fails for the other. Of several labels of one doc_id the largest counts; null labels count as 0.
A null source is the part ''. An empty table gives no rows. Columns other than doc_id, text, source and the labels'
doc_id, quality, toxic are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import spread, table

# The filters, their thresholds and characters. White space is \x20 and \x09-\x0D.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, "[#$%&*|]"
_COPY = 1 << FILTERS.index("E")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions of the filters that look at one text alone; ``words`` are its words."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MOST_UPPER,
        "D": text.rlike(SYMBOLS),
    }


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): what the audit needs of each row; the mask lacks the filter for copies."""
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(F.col("text"), F.col("words")).items()]
    return rows.select("doc_id", "part", F.struct(F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("n")).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, 32 rows a part at most."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # Repeated rows become one with a count, so that the number of rows with the smallest doc_id is known.
    rows = masked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("times"))
    # Null doc_ids meet no label; a second key deals them out.
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0)
    seen = rows.withColumn("deal", deal).join(marked.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left")
    flags = [F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    seen = seen.select("doc_id", "part", "digest", "mask", "times", *flags)
    groups = seen.groupBy("digest", "mask", "part", "quality", "toxic").agg(
        F.sum("times").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("times"))), F.lit(0)).alias("never"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("first"),
    )
    # A digest has as many rows here as parts hold it, times four: copies are counted already.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    original = F.col("never") + F.when(F.col("first.doc_id") == least, F.col("first.times")).otherwise(0)
    split = groups.withColumn("original", original).select("part", "quality", "toxic", F.explode(F.array(F.struct("mask", F.col("original").alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - F.col("original")).alias("n")))).alias("c"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0))
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def _pairs() -> list[tuple[int, int, int, list[str]]]:
    """(filters before, the filter, step, the orders that have them so): the 80 cases that the orders' steps come down to."""
    found: dict[tuple[int, int, int], list[str]] = {}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            found.setdefault((before, bit, step), []).append("".join(order))
            before |= bit
    return [(*k, v) for k, v in found.items()]


def interactions(found: DataFrame) -> DataFrame:
    """A row for each part, order and step from the ``cells``; every part has all of them."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    cases = F.array(*(F.struct(F.lit(p).alias("before"), F.lit(f).alias("bit"), F.lit(s).alias("step"), F.array(*map(F.lit, orders)).alias("orders")) for p, f, s, orders in _pairs()))
    rows = parts.select("part", "cells", F.explode(cases).alias("k")).select("part", "cells", "k.*")

    def total(value: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), c[value]).otherwise(0))

    before, bit = F.col("before"), F.col("bit")
    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    out = {
        "kept": total("n", lambda m: ~fails(m) & ~gone(m)),
        "removed": total("n", lambda m: fails(m) & ~gone(m)),
        "redundant": total("n", lambda m: fails(m) & gone(m)),
        "unique_fails": total("n", lambda m: m == bit),
        "good_lost": total("good", lambda m: fails(m) & ~gone(m)),
        "toxic_lost": total("toxic", lambda m: fails(m) & ~gone(m)),
        # In as many of the 120 orders as its filter comes before all others that a document fails.
        "shapley": F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), F.expr("120").cast("long") * c["n"] / F.bit_count(c["mask"])).otherwise(0).cast("long")),
    }
    return rows.select("part", "step", "orders", *(c.alias(k) for k, c in out.items())).select("part", F.explode("orders").alias("filter_order"), "step", *out)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT w.*, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
      regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w),
m AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p JOIN x q ON q.k <> p.k JOIN x r ON r.k NOT IN (p.k, q.k) JOIN x s ON s.k NOT IN (p.k, q.k, r.k) JOIN x t ON t.k NOT IN (p.k, q.k, r.k, s.k)),
g AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS i)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & CAST(before + bit AS INT) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & bit <> 0 AND mask & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM h, g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

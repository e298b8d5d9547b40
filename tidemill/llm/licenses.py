"""License scan by diagonal voting.

Every document gives rolling hashes of its k-word windows; Spark joins them to the positions of the same windows in the
templates (k = 2, so that two-word phrases count). A hit votes for the diagonal (place in the text minus place in the
template). Diagonals at most ``SLACK`` apart make a band, so that a passage with a word more or less stays one; no band is
wider, so a span is at most ``SLACK`` windows longer than its template. Bands that hold enough different windows are verified:
the longest chain of hits that go forward both in the text and in the template, as a share of the template's windows, must
reach ``MIN_SHARE``. Of bands that overlap the one with the longest chain counts, ties to the first.
Words are compared as strings, not only as hashes. Only A-Z are lower-cased.

Base phrases count wherever their words stand consecutively, that is where one diagonal holds all their windows.
An empty table gives no rows; other columns may have any names. Nulls are empty texts: no words, no labels, null places. Every row gives one row, repeated rows too. A text full of one
phrase is only as many rows as it has words; no list is gathered over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import spread, table, texts

SLACK = 3
MIN_SHARE = 0.75
# Base phrases and templates, as (words, label).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
)
#: What stands between words once A-Z are lower-cased; taking texts apart there is far cheaper than finding each word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of a template that one long integer marks.
MARKS = 62


def positions(spark: SparkSession, phrases, templates) -> DataFrame:
    """(t, tpos, a, b, h, need, base, label): each two-word window of each template. A few hundred rows by construction."""
    rows = []
    for t, (words, label) in enumerate((*phrases, *templates)):
        w = words.split()
        rows += [(t, i, w[i], w[i + 1], len(w) - 1, t < len(phrases), label) for i in range(len(w) - 1)]
    return spark.createDataFrame(rows, "t int, tpos int, a string, b string, need int, base boolean, label string").withColumn("h", F.xxhash64("a", "b"))


def _chain(members: Column, diagonal: Column, need: Column, slack: int) -> Column:
    """The longest chain of hits in a band, each further on in the text and in the template than the one before.

    Place by place of the template, ``a[i][k]`` is the longest chain so far that ends before place i on the band's k-th diagonal. A hit
    on diagonal k follows one on diagonal j if it lies at least max(0, j - k) + 1 places behind it.
    """
    offsets = range(slack + 1)

    def held(k: int) -> Column:
        return F.try_element_at(F.filter(members, lambda x: x["d"] == diagonal + k), F.lit(1))["m"]

    marks = F.array(*map(held, offsets))

    def place(a: Column, i: Column) -> Column:
        new = []
        for k in offsets:
            bit = F.get(F.get(marks, F.lit(k)), F.floor(i / MARKS).cast("int"))
            hit = F.coalesce(F.call_function("getbit", bit, (i % MARKS).cast("int")) == 1, F.lit(False))
            best = F.greatest(*(F.get(F.get(a, F.greatest(F.lit(0), i - max(0, j - k))), F.lit(j)) for j in offsets))
            old = F.get(F.get(a, i), F.lit(k))
            new.append(F.when(hit, F.greatest(old, best + 1)).otherwise(old))
        return F.concat(a, F.array(F.array(*new)))

    ends = F.aggregate(F.sequence(F.lit(0), need - 1), F.array(F.array(*(F.lit(0) for _ in offsets))), place)
    return F.array_max(F.element_at(ends, -1))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, min_share: float = MIN_SHARE, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row of ``docs``.

    ``spans`` lists the verified spans: label, first word, last word and share of the template.
    """
    spark = docs.sparkSession
    words = spread(texts(docs)).select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(F.translate("text", _UPPER, _LOWER), BETWEEN), "").alias("w"))
    windows = words.select("doc_id", "row", F.size("w").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("y"))).alias("pos", "g"))
    windows = windows.select("doc_id", "row", "n_words", "pos", F.col("g.x").alias("x"), F.col("g.y").alias("y"), F.xxhash64("g.x", "g.y").alias("h"))
    at = F.broadcast(positions(spark, phrases, templates))  # bounded by the templates' words
    # The first window of a text stays without a hit, so that every text has a row.
    hits = windows.join(at, "h", "left").where((F.coalesce(F.col("pos"), F.lit(0)) == 0) | ((F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))))
    same = (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    hits = hits.select("doc_id", "row", "n_words", *(F.when(same, F.col(c)).alias(c) for c in ("t", "need", "base", "label", "tpos")), F.when(same, F.col("pos") - F.col("tpos")).alias("diagonal"), F.when(same, F.col("pos")).alias("pos"))
    # Which windows of its template a diagonal or span holds, as bits of as many integers as the longest template takes.
    longest = max((len(w.split()) for w, _ in (*phrases, *templates)), default=1)
    marks = {f"m{i}": F.when(F.expr(f"tpos div {MARKS}") == i, F.expr(f"shiftleft(1L, tpos % {MARKS})")) for i in range(-(-longest // MARKS))}
    votes = hits.groupBy("row", "doc_id", "n_words", "t", "need", "base", "label", "diagonal").agg(F.count("pos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), *(F.bit_or(c).alias(m) for m, c in marks.items()))
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    band, around = by.rangeBetween(0, slack), by.rangeBetween(-slack, slack)
    cover = sum((F.coalesce(F.bit_count(F.bit_or(m).over(band)), F.lit(0)) for m in marks), F.lit(0))
    member = F.struct((F.col("diagonal")).alias("d"), F.array(*marks).alias("m"))
    bands = votes.withColumn("cover", cover).withColumn("members", F.collect_list(member).over(band)).withColumn("from", F.min("lo").over(band)).withColumn("upto", F.max("hi").over(band) + 1)
    enough = ~F.col("base") & (F.col("cover") >= min_share * F.col("need"))
    bands = bands.withColumn("chain", F.when(enough, _chain(F.col("members"), F.col("diagonal"), F.col("need"), slack)).otherwise(0))
    bands = bands.withColumn("best", F.max(F.struct("chain", -F.col("diagonal"))).over(around)).withColumn("share", F.col("chain") / F.col("need"))
    spans = bands.withColumn("ok", F.coalesce(~F.col("base") & (F.col("share") >= min_share) & (F.col("best") == F.struct("chain", -F.col("diagonal"))), F.lit(False)))
    whole, ok = F.col("base") & (F.col("votes") == F.col("need")), F.col("ok")
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(whole).cast("long").alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(whole, F.col("label")))).alias("b"),
        F.array_sort(F.collect_set(F.when(whole | ok, F.col("label")))).alias("l"),
        F.coalesce(F.max(F.when(whole, 1.0).when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(whole | ok, F.struct("label", F.col("from").alias("lo"), F.col("upto").alias("hi"), F.when(whole, 1.0).otherwise(F.col("share")).alias("share"))))).alias("spans"),
    )
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join("l", ",").alias("labels"), "score", "spans")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")

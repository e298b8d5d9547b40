"""From links to hits: extraction, anti-join to held ids, first occurrence, page-stop rule and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import canonical_url

#: Up to this limit the planner cuts each task's rows of a key to the limit before they are shuffled, so a window by key sees few.
GROUP_LIMIT = 1000


def extracted(links: DataFrame, pattern: str, prefix: str, href: str = "href", id_group: int = 1, slug_group: int | None = 2) -> DataFrame:
    """Links with id, slug and canonical url; links that are empty or do not match are dropped."""
    h = F.coalesce(F.col(href), F.lit(""))
    out = links.where((h != "") & h.rlike(pattern)).withColumn("id", F.regexp_extract(h, pattern, id_group))
    out = out.withColumn("slug", F.regexp_extract(h, pattern, slug_group) if slug_group else F.lit(""))
    return out.withColumn("url", canonical_url(prefix, F.col("id"), F.col("slug")))


def rejects(links: DataFrame, pattern: str, href: str = "url") -> DataFrame:
    """All links with the id or the reason why there is none."""
    h = F.col(href)
    found = F.regexp_extract(h, pattern, 1)
    return links.withColumn("id", F.when(found != "", found)).withColumn("reason", F.when(h.isNull() | (h == ""), "empty").when(found == "", "no document id"))


def first_wins(hits: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in an explicit order, by an aggregate: however many rows a key has, each task sends one of them."""
    keys = [F.col(c) for c in by]
    rest = [c for c in hits.columns if c not in by]
    first = hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_"))
    return first.select(*by, "first_.*").select(*hits.columns)


def ranked(rows: DataFrame, by: str, page: str, order: list[str | Column], name: str = "n") -> DataFrame:
    """``rows`` with their running number within ``by``, over pages and within each page in ``order``.

    Rows are counted by page and pages are added up in chunks, so a task sorts one page's rows, one chunk's pages or one
    key's chunks, never a key's rows.
    """
    before = running(rows.groupBy(by, page).agg(F.count("*").alias("rows_")), by, page, "rows_", "upto_").select(by, page, (F.col("upto_") - F.col("rows_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy(by, page).orderBy(*order))
    return rows.withColumn("own_", own).join(before, [by, page]).withColumn(name, (F.col("before_") + F.col("own_")).cast("int")).drop("own_", "before_")


def running(pages: DataFrame, by: str, page: str, value: str, name: str, chunk: int = 1024) -> DataFrame:
    """``pages`` (one row for each page of a key) with the running total of ``value`` over the pages, in chunks of page numbers."""
    split = pages.withColumn("chunk_", F.floor(F.col(page) / chunk))
    sums = split.groupBy(by, "chunk_").agg(F.sum(value).alias("sum_"))
    base = sums.withColumn("base_", F.sum("sum_").over(Window.partitionBy(by).orderBy("chunk_")) - F.col("sum_")).drop("sum_")
    own = F.sum(value).over(Window.partitionBy(by, "chunk_").orderBy(page))
    return split.withColumn("own_", own).join(base, [by, "chunk_"]).withColumn(name, F.col("base_") + F.col("own_")).drop("chunk_", "own_", "base_")


def not_held(hits: DataFrame, held: DataFrame) -> DataFrame:
    """Without hits whose id is held. The planner broadcasts ``held`` where its size allows."""
    return hits.join(held.select("id"), "id", "left_anti")


def held_count(hits: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """(by, n_links, skipped_existing)."""
    mark = held.select("id").distinct().withColumn("h_", F.lit(True))
    return hits.join(mark, "id", "left").groupBy(by).agg(F.count("*").alias("n_links"), F.count_if(F.coalesce("h_", F.lit(False))).alias("skipped_existing"))


def stop_pages(pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """(keyword, stop): the first page of ``pages`` (keyword, page) on which no hit of ``fresh`` is new; null if none."""
    new = fresh.groupBy("keyword", "page").agg(F.count("*").alias("n_new"))
    every = pages.select("keyword", "page").distinct().join(new, ["keyword", "page"], "left")
    return every.groupBy("keyword").agg(F.min(F.when(F.coalesce("n_new", F.lit(0)) == 0, F.col("page"))).alias("stop"))


def search(pages: DataFrame, hits: DataFrame, held: DataFrame, limit: int, cap: int) -> DataFrame:
    """The hits a paged search keeps: not held, first of their id, before the stop page, within page cap and limit.

    ``hits`` has keyword, page, pos and id; the result adds ``n``, the running number within the keyword.
    """
    seen = hits.where(F.col("page") <= cap)
    fresh = first_wins(not_held(seen, held), ["keyword", "id"], ["page", "pos"])
    stop = stop_pages(pages.where(F.col("page") <= cap), fresh)
    kept = fresh.join(stop, "keyword").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")
    if limit <= GROUP_LIMIT:
        return kept.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy("page", "pos"))).where(F.col("n") <= limit)
    return ranked(kept, "keyword", "page", ["pos"]).where(F.col("n") <= limit)


def page_progress(hits: DataFrame, held: DataFrame) -> DataFrame:
    """(keyword, page, n_links, n_held, n_new, total): total is the number of new ids up to the page, itself included."""
    mark = held.select("id").distinct().withColumn("h_", F.lit(True))
    seen = hits.join(mark, "id", "left").withColumn("h_", F.coalesce("h_", F.lit(False)))
    links = seen.groupBy("keyword", "page").agg(F.count("*").alias("n_links"), F.count_if("h_").alias("n_held"))
    first = seen.where(~F.col("h_")).groupBy("keyword", "id").agg(F.min("page").alias("page"))
    new = first.groupBy("keyword", "page").agg(F.count("*").alias("n_new"))
    pages = links.join(new, ["keyword", "page"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    return running(pages, "keyword", "page", "n_new", "total")

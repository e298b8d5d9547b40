"""Keywords in turn over one shared folder, in one plan: what an earlier keyword takes is held for all later ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.cluster import forget, in_ranges, stored
from tidemill.operators.hits import first_wins, not_held, ranked

#: Candidates of one block of successive keywords, which one task reads as a stream.
BLOCK_ROWS = 1_000_000
_TAKEN = "turn long, page long, at long, id string, n int"


def candidates(pages: DataFrame, hits: DataFrame, held: DataFrame, turns: DataFrame, limit: int, cap: int) -> tuple[DataFrame, list[DataFrame]]:
    """(turn, keyword, page, pos, id, lim, listed): what each keyword may look at, whatever the others take; and the stored tables it reads.

    Ids that are held are gone, as are all pages from a keyword's first listed page on that has nothing left then. So is what
    comes behind the keyword's limit in ids that no other keyword has: nobody can take those from it. ``listed`` tells whether
    the page is in ``pages``, for only such a page ends a search.
    """
    own = turns.select("turn", "keyword", *(["lim"] if "lim" in turns.columns else [F.lit(limit).alias("lim")])).where("lim > 0")
    listed = pages.where(F.col("page") <= cap).select("keyword", "page").distinct().join(own.select("turn", "keyword"), "keyword").select("turn", "page", F.lit(True).alias("listed"))
    listed = stored(listed, "turns-pages")  # this and the next two are read several times
    seen = not_held(hits.where(F.col("page") <= cap).select("keyword", "page", "pos", "id"), held).join(own, "keyword")
    first = stored(first_wins(seen, ["turn", "id"], ["page", "pos"]), "turns-first")
    some = first.select("turn", "page").distinct().withColumn("some", F.lit(True))
    dry = listed.join(some, ["turn", "page"], "left").where("some IS NULL").groupBy("turn").agg(F.min("page").alias("dry"))
    open_ = first.join(dry, "turn", "left").where("dry IS NULL OR page < dry").drop("dry").join(listed, ["turn", "page"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    open_ = stored(open_, "turns-open")
    private = open_.join(open_.groupBy("id").agg(F.count("*").alias("n_turns")).where("n_turns = 1").select("id"), "id", "left_semi")
    last = ranked(private, "turn", "page", ["pos"]).where("n = lim").select("turn", F.struct("page", "pos").alias("last"))
    found = open_.join(last, "turn", "left").where(F.col("last").isNull() | (F.struct("page", "pos") <= F.col("last"))).drop("last")
    return found, [listed, first, open_]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, turn, page, at, id, lim, listed, gone) in order of block, turn, page and place: the rows that the turns take,
    each turn knowing what those before it in its block took. Rows pass by; only the ids that the block has taken are kept."""
    block = turn = page = None
    taken: set[str] = set()
    n, fresh, was_listed, over = 0, False, False, False
    for b in batches:
        out: list[tuple] = []
        for blk, t, p, at, id_, lim, listed, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if blk != block:
                block, turn, taken = blk, None, set()
            if t != turn:
                turn, page, n, over = t, None, 0, False
            elif over:
                continue
            if p != page:
                # A listed page on which nothing was new has ended the search.
                if page is not None and was_listed and not fresh:
                    over = True
                    continue
                page, fresh, was_listed = p, False, listed
            if gone or id_ in taken:
                continue
            fresh = True
            n += 1
            taken.add(id_)
            out.append((t, p, at, id_, n))
            over = n >= lim
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["turn", "page", "at", "id", "n"])


def in_turn(pages: DataFrame, hits: DataFrame, held: DataFrame, turns: DataFrame, limit: int = 10, cap: int = 10, block_rows: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """(turn, keyword, page, pos, id, n): what keywords take one after another, in the order of ``turn`` (a distinct long).

    ``hits`` has keyword, page, pos and id (text), ``pages`` keyword and page, ``turns`` turn and keyword and may have ``lim``, a
    limit for each keyword. A keyword may come up more than once. A null id is nobody's.

    Keywords are cut into blocks of successive ones. All blocks run at once, each keyword in its turn within the block, and hold
    what blocks before theirs took in the round before; the earliest claimant wins. Page stops and limits are worked out anew
    until no claim moves. The first block is right after one round, the next after two at most, and so on; blocks
    whose keywords meet in few ids settle together. So the number of jobs depends on how long such chains of blocks are, not on
    the keywords: one block, up to ``block_rows`` candidates, takes one round.
    """
    spark = hits.sparkSession
    found, used = candidates(pages, hits.where("id IS NOT NULL"), held, turns, limit, cap)
    blocks, n_blocks = in_ranges(found, ["turn"], block_rows, "turns", "block", for_all_cores=False)
    # Places as numbers, whatever the type of pos: within a page of a turn.
    rows, at = blocks, F.row_number().over(Window.partitionBy("turn", "page").orderBy("pos")).cast("long")
    rows = stored(rows.withColumn("page", F.col("page").cast("long")).withColumn("at", at), "turns-rows")
    forget(blocks, *used)
    claims, before, rounds = None, None, 0
    while True:
        gone = F.lit(False)
        now = rows
        if claims is not None:
            now = rows.join(claims, "id", "left")
            gone = F.coalesce(F.col("claimed") < F.col("block"), F.lit(False))
        now = now.select("block", "turn", "page", "at", F.col("id").cast("string").alias("id"), F.col("lim").cast("int").alias("lim"), "listed", gone.alias("gone"))
        now = now.repartition(n_blocks, "block").sortWithinPartitions("block", "turn", "page", "at")
        taken = stored(now.mapInArrow(_scan, _TAKEN), "turns-taken")
        rounds += 1
        if n_blocks == 1:
            break
        if before is not None:
            moved = taken.withColumn("s", F.lit(1)).unionByName(before.withColumn("s", F.lit(-1))).groupBy("turn", "id").agg(F.sum("s").alias("s")).where("s <> 0")
            still = moved.isEmpty()
            forget(before)
            if still:
                break
        before = taken
        claims = taken.join(rows.select("turn", "block").distinct(), "turn").groupBy("id").agg(F.min("block").alias("claimed"))
    if report is not None:
        report.append(rounds)
    return taken.join(rows.select("turn", "keyword", "page", "at", "pos"), ["turn", "page", "at"]).select("turn", "keyword", "page", "pos", "id", "n")

"""Mixing sources to target weights.

Each source's documents, in a fixed pseudorandom order, are one stream of words, cut into blocks of ``block_words``.
Every output shard of ``shard_slots`` slots draws its source counts by itself: each source gets the whole part of its
expected count, and what is left of the shard is drawn from the multinomial of the fractional parts (a residual
multinomial draw, which keeps small mixes near their targets). The counts of all shards, added up, decide how many blocks
a source gives. A slot's number within its source goes through the source's pseudorandom permutation (a Feistel network)
to a block, and slots meet the words of their blocks in a join by (source, block). Within a shard the slots are in random
order; the mix is laid out by shard and slot.

The draw decides what the whole parts leave, fewer slots of a shard than there are sources (about 1 % with 20 sources); the
rest of the mix follows from the targets. A source's slots count whole passes over its stream first. Slots beyond ``most`` (2) passes stay empty, so no word is taken
more than twice. Taken words are whole blocks: they come within a few blocks of the target.

Nulls: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order. Sources are
ordered by code point. Repeated rows are separate rows; a text of any length is a row, cut at blocks. An empty table gives no
rows, and other columns may have any names. Sources are collected to the driver, at most ``MAX_SOURCES``; all
else stays distributed, and prefix sums over a hot source go through hashed buckets, those over shards through chunks of
shards, so no task holds a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import partitions_for, ship, stored, table

#: Bounds of what the driver holds: sources, and sums of chunks of shards by source.
MAX_SOURCES, MAX_SUMS = 100_000, 32_000_000
BLOCK_WORDS, SHARD_SLOTS, SEED = 256, 1024, 20_240_607
# The weights of the query's sources, by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to weights, none above ``most`` times its size; what is over is shared out again by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), applied to ``i``: four Feistel rounds on the next even power of two, walked
    until the value is inside."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (((f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)) & mask
            left, right = right, left ^ f
        out[todo] = left << half | right
        todo[todo] = out[todo] >= np.uint64(n)
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """How the sources share the slots of every shard."""

    sizes: np.ndarray  # words
    blocks: np.ndarray
    share: np.ndarray  # expected share of the slots
    slots: int
    block_words: int
    shard_slots: int
    seed: int
    most: int

    @staticmethod
    def of(sizes: list[int], targets: list[float], block_words: int, shard_slots: int, seed: int, most: int) -> Plan:
        size = np.array(sizes, np.int64)
        blocks = -(-size // block_words)
        # A source's blocks hold size / blocks words on average, as the last one may be short.
        want = np.array(targets, float) * blocks / np.maximum(size, 1)
        return Plan(size, blocks, want / max(want.sum(), 1e-300), round(want.sum()), block_words, shard_slots, seed, most)

    @property
    def shards(self) -> int:
        return -(-self.slots // self.shard_slots)

    def whole(self) -> np.ndarray:
        """What each full shard gives each source without a draw."""
        return np.floor(self.share * self.shard_slots).astype(np.int64)

    def drawn(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots each source gets without a draw, sources drawn, slots they get by the draw) of a shard."""
        room = min(self.shard_slots, self.slots - shard * self.shard_slots)
        whole = self.whole() if room == self.shard_slots else np.floor(self.share * room).astype(np.int64)
        left = room - int(whole.sum())
        part = np.cumsum(self.share * room - whole)
        at = np.searchsorted(part, np.random.default_rng([self.seed, 0, shard]).random(left) * part[-1], "right")
        return whole, *np.unique(np.minimum(at, len(part) - 1), return_counts=True)

    def slot_blocks(self, source: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pass, block) of slots ``j`` of a source; those beyond the last pass are left out."""
        n = int(self.blocks[source])
        again, i = np.divmod(j[j < n * self.most], max(n, 1))
        return again, permute(i, n, self.seed + source)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of the text of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))  # doc_id and h find the text again


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (of src, size, doc_id, h and more) with the start of each in its source's stream.

    The order is by hashed bucket, then doc_id. Bucket sums are summed up per source, then each bucket alone; with as many
    buckets as the square root of the rows neither is large.
    """
    buckets = max(16, math.isqrt(n_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    base = sums.withColumn("base", F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("src", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    inside = rows.withColumn("own", F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return inside.join(base, ["src", "bucket"]).withColumn("start", F.col("base") + F.col("own")).drop("bucket", "base", "own")


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """(shard, slot, src, pass, block) of all slots.

    Shards are worked on in chunks, as many as the square root of their number. A first run adds up what each chunk draws;
    the driver adds these sums (chunks times sources numbers), and each chunk gets those before it, which tell where its
    slots begin within their sources.
    """
    chunk = max(8, math.isqrt(plan.shards))
    chunks, n_sources = -(-plan.shards // chunk), len(plan.sizes)
    if chunks * n_sources > MAX_SUMS:
        raise ValueError(f"{chunks} chunks of shards for {n_sources} sources; their product may be at most {MAX_SUMS}")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for c in b.column(0).to_pylist():
                total = np.zeros(n_sources, np.int64)
                for shard in range(c * chunk, min((c + 1) * chunk, plan.shards)):
                    _, src, n = plan.drawn(shard)
                    total[src] += n
                sums.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary())], ["chunk", "sums"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                drawn = np.frombuffer(before, np.int64).copy()
                for shard in range(c * chunk, min((c + 1) * chunk, plan.shards)):
                    whole, src, n = plan.drawn(shard)
                    first, counts = drawn + shard * plan.whole(), whole.copy()
                    counts[src] += n
                    drawn[src] += n
                    sources = np.flatnonzero(counts).tolist()
                    made = [plan.slot_blocks(i, first[i] + np.arange(counts[i])) for i in sources]
                    src = np.repeat(np.array(sources, np.int32), [len(x) for _, x in made])
                    again, block = (np.concatenate([m[k] for m in made]) for k in range(2))
                    order = np.random.default_rng([plan.seed, 1, shard]).permutation(len(src))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard, np.int64)), pa.array(order), pa.array(src), pa.array(again), pa.array(block)], ["shard", "slot", "src", "pass", "block"])

    parts = min(max(1, chunks), partitions_for(spark, chunks, 1))
    got = spark.range(0, chunks, 1, parts).mapInArrow(add, "chunk long, sums binary").collect()
    sums = np.zeros((chunks + 1, n_sources), np.int64)
    for r in got:
        sums[r["chunk"] + 1] = np.frombuffer(bytes(r["sums"]), np.int64)
    sums = sums.cumsum(0)
    starts = spark.createDataFrame([(c, sums[c].tobytes()) for c in range(chunks)], "id long, before binary")
    return starts.repartitionByRange(parts, "id").mapInArrow(fill, "shard long, slot long, src int, pass long, block long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: int = 2, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(empty, pieces).

    ``pieces`` has one row for each part of a document that the mix takes, and once with 0 words what it does not take:
    doc_id, h (hash of the text), source, source_size, target, size, shard, slot, pass, first word and number n of words.
    ``empty`` has the rows without words.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(sized(docs), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n_rows = sum(r["n"] for r in totals)
    sizes = [int(r["size"]) for r in totals]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total_share * sum(sizes), most)
    named = spark.createDataFrame([(r["source"], i, sizes[i], float(targets[i])) for i, r in enumerate(totals)], "source string, src int, source_size long, target double")
    named = F.broadcast(named)  # at most MAX_SOURCES rows
    rows = rows.alias("r").join(named.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "inner").drop(F.col("s.source"))
    empty, at = rows.where("size = 0"), placed(rows.where("size > 0"), n_rows)
    parts = at.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    parts = parts.withColumn("lo", F.greatest("start", F.col("block") * block_words)).withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("lo"))
    # Slots grow with the input, which the planner cannot know of rows made in Python: never broadcast them.
    pieces = parts.join(slots(spark, Plan.of(sizes, targets, block_words, shard_slots, seed, most)).hint("merge"), ["src", "block"], "left")
    pieces = pieces.withColumn("n", F.when(F.col("shard").isNull(), 0).otherwise(F.col("n")).cast("long")).withColumn("first", F.col("lo") - F.col("start"))
    return empty, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard) of each row: the words the mix takes, repeats counted, and
    the first shard that has some of them."""
    empty, pieces = mix(docs, **options)
    # src and start tell rows apart, repeated ones too
    whole = pieces.groupBy("src", "start", "doc_id", "size", "source_size", "target").agg(F.sum("n").alias("taken"), F.first("source").alias("source"), F.min("shard").alias("shard"))
    names = ("doc_id", "source", "size", "source_size", "target", "taken", "shard")
    return whole.select(*names).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).withColumn("shard", F.lit(None).cast("long")).select(*names))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: one row for each part taken, its text cut out with the white space around
    its words. Partitions hold whole shards; rows lie by shard, slot and place in the source's stream.
    Of rows equal in doc_id and text the other columns come from one of them; n_chars follows the text.
    A null doc_id stays null; any other column names may occur."""
    _, pieces = mix(docs, **options)
    names = docs.columns
    h, others = F.xxhash64("text"), [F.col(f"`{c}`") for c in names if c != "text"]
    # Rows without a doc_id are found again by their text.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), h).alias("id"), h.alias("h"), F.col("text").alias("whole"), F.struct(*others).alias("row")).dropDuplicates(["id", "h"])
    cut = F.struct(F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n"), "shard", "slot", F.col("start").alias("start"))
    # src and start tell repeated rows apart: a list holds the parts of one text, so it is bounded by that text.
    parts = pieces.where("n > 0").groupBy(F.coalesce("doc_id", "h").alias("id"), "h", "src", "start").agg(F.array_sort(F.collect_list(cut)).alias("parts")).drop("src", "start")
    words = F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"), F.lit(0))
    # The outer transform holds the words, so that they are found once for a text and not once for each part.
    texts = F.flatten(F.transform(F.array(words), lambda w: F.transform("parts", lambda p: F.struct(F.array_join(F.slice(w, p["first"] + 1, p["n"]), "").alias("part"), p["shard"].alias("shard"), p["slot"].alias("slot"), p["start"].alias("start"), p["first"].alias("first")))))
    out = rows.join(parts, ["id", "h"]).select("row", F.explode(texts).alias("cut"))
    out = out.repartition("cut.shard").sortWithinPartitions("cut.shard", "cut.slot", "cut.start", "cut.first")
    new = {"text": F.col("cut.part")}
    if "n_chars" in names:
        new["n_chars"] = F.length("cut.part").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in names))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))

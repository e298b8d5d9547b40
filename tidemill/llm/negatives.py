"""Hard negatives by distributed radix selection.

Vectors become whole numbers and lie in tiles of some thousand rows; anchors lie in tiles of their own. A task gets one tile of
rows and one of anchors and multiplies them, so memory is bounded by two tiles and no tile is broadcast.

Round 0 finds each anchor's positives: each tile gives its k best rows of the anchor's label, the best of these are
the positives. An anchor and a positive make a window of scores, from ``low`` share of the positive's score up to that score,
in which rows of other labels are negatives. Then each round counts, for each window, the scores of a tile by one digit of 8 bits,
the highest first; the sums of all tiles show in which digit the k-th score lies, and the next round looks only there. After the
last digit the k-th score is known. The last round gathers what lies above it, fewer than k rows, and of the rows
that have exactly that score as many of the smallest ids as are missing, for each tile; the smallest of these stay.

Vectors that are null or hold null or non-finite components take no part, nor do null ids and null labels. Empty vectors
score 0, shorter ones count as padded with zeros. Components of any finite size are multiplied exactly; a score beyond a
long counts as the nearest long. Candidates of an anchor are rows with another id; of repeated rows each is a candidate, equal anchors
(id, label and vector) are answered once, unequal ones with one id each by themselves. Ties go to the smaller id. A window
above a negative score is empty. An empty table gives no rows. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import forget, ship, stored, table

#: Rows of a tile of rows and of one of anchors, for vectors of up to 256 components; fewer for longer ones.
TILE_ROWS, ANCHOR_ROWS, TILE_CELLS = 16_384, 1024, 16_384 * 256
DIGIT, MOST_PARTITIONS = 8, 100_000
#: Components up to this size multiply in doubles or longs without loss.
MOST = 1 << 26
_LONG = (1 << 63) - 1


def whole(vectors: DataFrame, scale: float, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, wide, v): components as whole doubles, of the rows that take part."""
    x = F.col("x")
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # Doubles beyond 2**53 are whole; scaled ones beyond all doubles count as the largest double.
    big = lambda c: F.greatest(F.least(c * scale, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308))
    v = F.transform(x, lambda c: F.when(F.abs(c * scale) < float(1 << 53), F.floor(c * scale).cast("double")).otherwise(big(c)))
    return rows.select("id", "label", F.exists(x, lambda c: F.abs(c * scale) > MOST).alias("wide"), v.alias("v"))


TILE = "wide boolean, n int, dim int, ids binary, labels binary, x binary"


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """The rows as tiles of at most ``size`` rows and ``TILE_CELLS`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        longest = {False: 0, True: 0}

        def out(wide: bool) -> pa.RecordBatch:
            x = np.zeros((len(held[wide]), longest[wide]), "<f8" if wide else "<i4")
            for i, r in enumerate(held[wide]):
                x[i, : len(r[2])] = r[2]
            parts = [wide, len(x), longest[wide], *(np.array([r[c] for r in held[wide]], "<i8").tobytes() for c in (0, 1)), zlib.compress(x.tobytes(), 1)]
            held[wide], longest[wide] = [], 0
            types = (pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([p], t) for p, t in zip(parts, types, strict=True)], [c.split()[0] for c in TILE.split(", ")])

        for b in batches:
            flat, off = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            for i, (id_, label, wide) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                v = flat[off[i] : off[i + 1]].copy()
                if held[wide] and (len(held[wide]) + 1) * max(longest[wide], len(v)) > TILE_CELLS:
                    yield out(wide)
                held[wide].append((id_, label, v))
                longest[wide] = max(longest[wide], len(v))
                if len(held[wide]) >= size:
                    yield out(wide)
        for wide in (False, True):
            if held[wide]:
                yield out(wide)

    return rows.mapInArrow(run, TILE)


def _tile(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(ids, labels, components, wide) of the one tile in ``t``."""
    wide, n, dim = (t.column(c)[0].as_py() for c in ("wide", "n", "dim"))
    ids, labels = (np.frombuffer(t.column(c)[0].as_py(), "<i8") for c in ("ids", "labels"))
    x = np.frombuffer(zlib.decompress(t.column("x")[0].as_py()), "<f8" if wide else "<i4").reshape(n, dim)
    return ids, labels, x, wide


def products(a: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Whole inner products of the rows of ``a`` with those of ``x`` as longs; beyond a long, the nearest one."""
    d = min(a.shape[1], x.shape[1])
    a, x = a[:, :d], x[:, :d]
    if wide:
        p, q = ([[int(c) for c in r] for r in m.tolist()] for m in (a, x))
        return np.array([[min(_LONG, max(-_LONG - 1, sum(map(int.__mul__, r, s)))) for s in q] for r in p], np.int64).reshape(len(a), len(x))
    most = [int(np.abs(m.astype(np.int64)).max(initial=0)) for m in (a, x)]
    if most[0] * most[1] * max(1, d) < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    if most[0] * most[1] * max(1, d) < 1 << 63:
        return np.stack([x.astype(np.int64) @ r for r in a.astype(np.int64)]) if len(a) else np.zeros((0, len(x)), np.int64)
    return products(a.astype(float), x.astype(float), True)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        place = np.flatnonzero(score >= kth)
    else:
        place = np.arange(len(score))
    return place[np.lexsort((ids[place], -score[place].astype(object) if len(place) and score[place].min() == -_LONG - 1 else -score[place]))][:k]


#: What a window is: its anchor's place in the tile of anchors, the positive, the scores that the next round looks at, how many rows are sought there.
WINDOW = "tile long, place int, positive_id long, positive_score long, turn int, low long, high long, k int"


def _over(rows: DataFrame, anchors: DataFrame, windows: DataFrame | None, n_rows: int, n_anchors: int, each, schema: str) -> DataFrame:
    """``each(anchor tile, row tile, windows)`` for every pair of tiles, as a group of its own."""
    left = rows.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors - 1).cast("long"))))
    right = anchors if windows is None else anchors.join(windows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "positive_id", "positive_score", "low", "high", "k"))).alias("windows")), "tile")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))

    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32()}[t] for t in types]
    windowed = windows is not None

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if a.num_rows and b.num_rows:  # an anchor tile without windows is not there
            ids, labels, x, wide = _tile(a)
            own, own_labels, q, wide_too = _tile(b)
            got = each(key[0].as_py(), own, own_labels, products(q, x, wide or wide_too), ids, labels, b.column("windows")[0].as_py() if windowed else None)
        return pa.table({f: pa.array([r[i] for r in got], t) for i, (f, t) in enumerate(zip(names, types, strict=True))})

    # A partition for each pair: few bytes are much work, so they must not be put together.
    n = min(n_rows * n_anchors, MOST_PARTITIONS)
    left, right = (side.repartition(n, "tile", "part").groupBy("tile", "part") for side in (left, right))
    return left.cogroup(right).applyInArrow(run, schema)


def _positives(k: int):
    def each(tile, own, own_labels, score, ids, labels, _):
        out = []
        for i in range(len(own)):
            same = np.flatnonzero((labels == own_labels[i]) & (ids != own[i]))
            for j in same[_best(score[i][same], ids[same], k)]:
                out.append((tile, i, int(ids[j]), int(score[i][j])))
        return out

    return each


def _others(score: np.ndarray, own_labels: np.ndarray, labels: np.ndarray, windows: list[dict]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each window with the places and scores of the rows of other labels; windows come in order of their anchors."""
    last, place, s = -1, None, None
    for w in windows:
        if w["place"] != last:
            last = w["place"]
            place = np.flatnonzero(labels != own_labels[last])
            s = score[last][place]
        yield w, place, s


def _counted(shift: int):
    """Counts of the digit at ``shift`` of the scores between each window's ends, from its low end."""

    def each(tile, own, own_labels, score, ids, labels, windows):
        out = []
        for w, _, s in _others(score, own_labels, labels, windows):
            digit = (s[(s >= w["low"]) & (s <= w["high"])] - w["low"]) >> shift
            n = np.bincount(digit, minlength=1)
            out += [(tile, w["place"], w["turn"], int(d), int(n[d])) for d in np.flatnonzero(n)]
        return out

    return each


def _gathered(tile, own, own_labels, score, ids, labels, windows):
    """Rows of each window above its ``low``, the k-th score, and as many of the smallest ids that have it as are missing."""
    out = []
    for w, place, s in _others(score, own_labels, labels, windows):
        above = place[(s > w["low"]) & (s <= w["positive_score"])]
        tied = place[s == w["low"]]
        for j in (*above, *tied[np.argsort(ids[tied], kind="stable")[: w["k"]]]):
            out.append((int(own[w["place"]]), tile, w["place"], w["turn"], w["positive_id"], int(ids[j]), w["positive_score"], int(score[w["place"]][j])))
    return out


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k_positive: int = 5, k_negative: int = 5, low: tuple[int, int] = (4, 5), scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", tile_rows: int = TILE_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors for which ``is_anchor`` (over
    column id) holds. Negatives score at least ``low`` (a fraction) of the positive and no more than it."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(whole(vectors, scale, key, vector, label), "negatives-rows")
    n = rows.count()
    parts = max(1, -(-n // tile_rows), min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    held = stored(numbered(tiles(rows.repartition(parts), tile_rows), "part"), "negatives-tiles")
    asked = rows.where(is_anchor).dropDuplicates(["id", "label", "v"])
    n_asked = asked.count()
    anchors = stored(numbered(tiles(asked.repartition(max(1, -(-n_asked // anchor_rows))), anchor_rows), "tile"), "negatives-anchors")
    n_rows, n_anchors = held.count(), anchors.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_rows or not n_anchors:
        return empty
    best = _over(held, anchors, None, n_rows, n_anchors, _positives(k_positive), "tile long, place int, positive_id long, positive_score long")
    turn = F.row_number().over(Window.partitionBy("tile", "place").orderBy(F.desc("positive_score"), "positive_id"))
    num, den = low
    # The least score is the fraction rounded up; decimals keep longs exact. Below 0 it is above the positive's.
    least = F.expr(f"cast((cast(positive_score AS decimal(20,0)) * {num} + {den - 1}) div {den} AS long)")
    windows = best.withColumn("turn", turn).where((F.col("turn") <= k_positive) & (F.col("positive_score") >= 0)).withColumn("low", least).withColumn("high", F.col("positive_score")).withColumn("k", F.lit(k_negative))
    windows = stored(windows.select([c.split()[0] for c in WINDOW.split(", ")]), "negatives-windows")
    longest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    if longest is None:
        return empty
    digits = max(1, -(-longest.bit_length() // DIGIT))
    for shift in range(DIGIT * (digits - 1), -1, -DIGIT):
        counts = _over(held, anchors, windows, n_rows, n_anchors, _counted(shift), "tile long, place int, turn int, digit long, n long")
        before, windows = windows, stored(_narrowed(windows, counts, shift), "negatives-windows")
        forget(before)
    found = _over(held, anchors, windows, n_rows, n_anchors, _gathered, "anchor_id long, tile long, place int, turn int, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("tile", "place", "turn").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k_negative).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def numbered(found: DataFrame, name: str) -> DataFrame:
    """With a running number over all rows, a few thousand components each: as many rows as tiles."""
    kept = stored(found.withColumn("at_", F.monotonically_increasing_id()), "negatives-numbered")
    places = kept.select("at_").withColumn(name, (F.row_number().over(Window.orderBy("at_")) - 1).cast("long"))
    return kept.join(places, "at_").drop("at_")


def _narrowed(windows: DataFrame, counts: DataFrame, shift: int) -> DataFrame:
    """Each window cut to the digit that holds its k-th score, with what is sought there; to its low end where it has fewer rows."""
    by = ["tile", "place", "turn"]
    total = counts.groupBy(*by, "digit").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("digit"))) - F.col("n")
    at = total.withColumn("above", above).join(windows.select(*by, F.col("k").alias("sought")), by).where("above < sought AND above + n >= sought").select(*by, "digit", "above")
    joined = windows.join(at, by, "left")
    begin = F.col("low") + F.shiftleft("digit", shift)
    end = begin + F.least(F.col("high") - begin, F.lit((1 << shift) - 1).cast("long"))
    some = F.col("digit").isNotNull()
    return joined.select("tile", "place", "positive_id", "positive_score", "turn", F.when(some, begin).otherwise(F.col("low")).alias("low"), F.when(some, end).otherwise(F.col("low")).alias("high"), F.when(some, (F.col("k") - F.col("above")).cast("int")).otherwise(F.col("k")).alias("k"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS score
      FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE rank <= 5
"""

"""Exact top-k by inner product over a bit-sliced index.

Components are integers floor(scale * x). Rows are gathered into blocks; of each attribute a block keeps bitmaps, one for
each of its highest ``SLICES`` bits. For a query, slices are added with bitmap arithmetic: multiplying by a weight is
shifting and adding, a negative weight takes complemented slices, and carry-save adders turn the bitmaps of one place
value into those of the sum. From the most significant slice of the sum downward, bitmaps select the rows that can be
among the k best. Quantising both sides leaves an error below a bound that is known for each block and query, so all rows
within it of the k-th are boundary rows, and these alone are scored with whole integers. No row that belongs in the result
can be lost.

The index is stored once, a row for each block, and so are the queries. Every block of the index meets every block of queries in a
group of its own, which holds these two blocks and nothing else; no query passes through the driver, and none is broadcast.
Each pair gives at most k rows a query. Where blocks are fewer than cores, queries lie in smaller blocks.

Vectors that are null or hold null or non-finite components (before or after scaling) take no part, nor does a null id; an
empty vector scores 0. Components of any size are exact: rows or queries with one beyond 2**26 after scaling (``wide``) are kept in
blocks of their own and scored in Python integers. Ranks are by the exact score; a score beyond a long is returned as the
nearest long. Shorter vectors count as padded with zeros. Candidates of a query are all rows with another id; repeated rows
are candidates each, and equal queries are answered once. Ties go to the smaller id. An empty table gives no rows; columns other than
id and vector are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import ship, stored, table
from tidemill.llm.negatives import MOST_PARTITIONS, numbered

#: Rows of a block and of one of queries (bounded by bytes too, for long vectors).
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS, SENT_BYTES = 32_768, 32 << 20, 1024, 8 << 20
SLICES, WEIGHT_BITS, MOST = 6, 4, 1 << 26
#: Slack for the rounding of the error bound itself.
ROUNDING = 1 + 1e-9


def _words(bits: np.ndarray) -> np.ndarray:
    """Bitmap of a boolean array, in 64-bit words."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate((raw, np.zeros(-len(raw) % 8, np.uint8))).view(np.uint64)


def _bits(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n].astype(bool)


class BitSliced:
    """Slices of the attributes of some rows; ``x`` holds 64-bit or Python integers."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n = len(x)
        # Narrow components have sums below 2**53, which doubles hold exactly and multiply fast.
        self.fast = x.astype(float) if x.dtype != object and (not x.size or float(np.abs(x).max()) ** 2 * x.shape[1] < 1 << 53) else None
        low = x.min(0) if self.n else np.zeros(x.shape[1], np.int64)
        spread = int((x - low).max()) if x.size else 0
        self.shift = max(0, spread.bit_length() - SLICES)
        above = x - low
        u = (above >> self.shift).astype(np.int64)
        # Values lie in low + [u, u + 1) << shift and are taken as their middle; errors are in units of 1 << shift.
        unit = 1 << self.shift
        part = ((above - (u.astype(x.dtype) << self.shift)) / unit).astype(float) - 0.5
        self.slices = [[_words((u[:, d] >> b & 1).astype(bool)) for b in range(min(SLICES, spread.bit_length()))] for d in range(x.shape[1])]
        self.rest = float(np.sqrt((part**2).sum(1).max())) if x.size else 0.0
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt(((x / unit).astype(float) ** 2).sum(1).max())) if x.size else 0.0
        self.full = _words(np.ones(self.n, bool))

    def add(self, q: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Slices of the quantised score of every row, the lowest first, in units of 1 << (shift of rows and of q); error in units."""
        cut = max(0, int(np.abs(q).max()).bit_length() - WEIGHT_BITS)
        half = (1 << cut) >> 1
        w = (((np.abs(q) + half) >> cut) * np.where(q < 0, -1, 1)).astype(np.int64)
        places: list[list[np.ndarray]] = []
        for d in np.flatnonzero(w):
            weight, negative = abs(int(w[d])), w[d] < 0
            for b, s in enumerate(self.slices[d]):
                if negative:
                    s = s ^ self.full
                for e in range(weight.bit_length()):
                    if weight >> e & 1:
                        while len(places) <= b + e:
                            places.append([])
                        places[b + e].append(s)
        out = []
        i = 0
        while i < len(places):
            here = places[i]
            while len(here) > 1:
                if len(here) == 2:
                    a, c = here
                    here, carry = [a ^ c], a & c
                else:
                    a, c, d = here.pop(), here.pop(), here.pop()
                    t = a ^ c
                    here.insert(0, t ^ d)
                    carry = (a & c) | (t & d)
                if i + 1 == len(places):
                    places.append([])
                places[i + 1].append(carry)
            out.append(here[0] if here else np.zeros_like(self.full))
            i += 1
        # score = sum q x; x = middle + (u << shift) + e, |e| <= rest; q = (w << cut) + f
        f = ((q - (w.astype(q.dtype) << cut)) / (1 << cut)).astype(float)
        return out, (self.rest * float(np.sqrt((w.astype(float) ** 2).sum())) + self.norm * float(np.sqrt((f**2).sum()))) * ROUNDING

    def boundary(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k with the highest score."""
        if self.n <= k:
            return np.arange(self.n)
        slices, error = self.add(q)
        if not math.isfinite(error):  # components too far apart for the bound
            return np.arange(self.n)
        best, tied, have, value = np.zeros_like(self.full), self.full, 0, 0
        # The value of the k-th best quantised score, from the most significant slice downward.
        for i in range(len(slices) - 1, -1, -1):
            ones = tied & slices[i]
            c = int(np.bitwise_count(ones).sum())
            if have + c >= k:
                tied, value = ones, value | 1 << i
            else:
                best, have, tied = best | ones, have + c, tied & ~slices[i]
        # All rows whose quantised score is at least that less twice the error.
        least = value - int(np.ceil(2 * error)) - 1
        if least <= 0:
            return np.arange(self.n)
        over, same = np.zeros_like(self.full), self.full
        for i in range(len(slices) - 1, -1, -1):
            if least >> i & 1:
                same = same & slices[i]
            else:
                over |= same & slices[i]
                same = same & ~slices[i]
        return np.flatnonzero(_bits(over | same, self.n))


def top(index: BitSliced, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """(ids, scores) of the k best rows but ``own``; ties to the smaller id."""
    if not len(q):  # a query or rows without components: all score 0
        least = np.sort(ids[ids != own])[:k]
        return least, [0] * len(least)
    copies = int((ids == own).sum())
    rows = index.boundary(q, k + copies)
    rows = rows[ids[rows] != own]
    if index.fast is not None and q.dtype != object and (not len(q) or float(np.abs(q).max()) * float(np.abs(index.x).max(initial=0)) * len(q) < 1 << 53):
        score = (index.fast[rows] @ q.astype(float)).astype(np.int64)
    else:
        score = index.x[rows].astype(object) @ q.astype(object) if len(rows) else np.zeros(0, np.int64)
    if len(rows) > k and score.dtype != object:
        kth = np.partition(score, len(rows) - k)[len(rows) - k]
        rows, score = rows[score >= kth], score[score >= kth]
    best = sorted(zip((-v for v in score.tolist()), ids[rows].tolist(), strict=True))[:k]
    return np.array([i for _, i in best], np.int64), [-v for v, _ in best]


def quantised(vectors: DataFrame, scale: float, key: str, vector: str) -> DataFrame:
    """(id, wide, v): whole components, as doubles, of the rows that take part."""
    x = F.col("x")
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(x.isNotNull() & F.col("id").isNotNull())
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    # The floor of a double beyond 2**53 is that double; Spark's floor would cut it to a long.
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < float(1 << 53), F.floor(c * scale).cast("double")).otherwise(c * scale))
    return v.where(fine).select("id", F.exists(x, lambda c: F.abs(c * scale) > MOST).alias("wide"), whole.alias("v"))


def _matrix(raw: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    """Integers of a block: 32-bit where they fit, else doubles that are whole, as Python integers."""
    if not wide:
        return np.frombuffer(zlib.decompress(raw), "<i4").reshape(n, dim).astype(np.int64)
    flat = np.frombuffer(zlib.decompress(raw), "<f8")
    out = np.empty(len(flat), object)
    out[:] = [int(v) for v in flat.tolist()]
    return out.reshape(n, dim)


def blocks(rows: DataFrame, size: int, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows as blocks of at most ``size`` and some ``most_bytes``: (wide, ids, dim, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        words = {False: 0, True: 0}

        def out(wide: bool) -> pa.RecordBatch:
            dim = max(len(v) for _, v in held[wide])
            x = np.zeros((len(held[wide]), dim), "<f8" if wide else "<i4")
            for i, (_, v) in enumerate(held[wide]):
                x[i, : len(v)] = v
            ids = np.array([r[0] for r in held[wide]], "<i8").tobytes()
            held[wide], words[wide] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([ids], pa.binary()), pa.array([dim], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["wide", "ids", "dim", "x"])

        for b in batches:
            flat, off = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            for i, (id_, wide) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held[wide].append((id_, flat[off[i] : off[i + 1]].copy()))
                words[wide] += int(off[i + 1] - off[i])
                if len(held[wide]) >= size or words[wide] * 8 >= most_bytes:
                    yield out(wide)
        for wide in (False, True):
            if held[wide]:
                yield out(wide)

    return rows.mapInArrow(run, "wide boolean, ids binary, dim int, x binary")


def _best(index: DataFrame, queries: DataFrame, n_index: int, n_queries: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block of ``index`` (part) the k best rows of each query of each block of ``queries`` (tile)."""

    def run(_: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        flat = []
        for wide, raw, dim, x in zip(*(rows.column(c).to_pylist() for c in ("wide", "ids", "dim", "x")), strict=True):
            ids = np.frombuffer(raw, "<i8")
            x = _matrix(x, len(ids), dim, wide)
            sliced: dict[int, BitSliced] = {}  # queries may be shorter than rows
            for wide_q, raw_q, dim_q, q in zip(*(asked.column(c).to_pylist() for c in ("wide", "ids", "dim", "x")), strict=True):
                own = np.frombuffer(raw_q, "<i8")
                both = min(dim, dim_q)
                if both not in sliced:
                    sliced[both] = BitSliced(x[:, :both])
                for i, v in zip(own.tolist(), _matrix(q, len(own), dim_q, wide_q), strict=True):
                    flat += [(i, j, str(s)) for j, s in zip(*top(sliced[both], ids, v[:both], i, k), strict=True)]
        return pa.table({c: pa.array([r[n] for r in flat], t) for n, (c, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string())))})

    left = index.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    right = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_index - 1).cast("long"))))
    # A partition for each pair: few bytes are much work, so they must not be put together.
    n = min(n_index * n_queries, MOST_PARTITIONS)
    left, right = (side.repartition(n, "tile", "part").groupBy("tile", "part") for side in (left, right))
    return left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score string")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``is_query`` holds (over column id)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors, scale, key, vector)
    # Small partitions make small blocks; whole ones are made of as few partitions as hold them.
    index = stored(numbered(blocks(rows.coalesce(max(1, -(-rows.count() // block_rows))), block_rows), "part"), "index")
    asked = stored(rows.where(is_query).dropDuplicates(["id", "v"]), "asked")
    n_index, n_asked = index.count(), asked.count()
    if not n_index or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = min(QUERY_ROWS, max(8, -(-n_asked * n_index // (2 * spark.sparkContext.defaultParallelism))))
    queries = stored(numbered(blocks(asked.repartition(-(-n_asked // each)), each, sent_bytes), "tile"), "queries")
    found = _best(index, queries, n_index, queries.count(), k)
    # Scores may be longer than a long: by sign, number of digits and digits they order like the integers.
    number = F.col("score").try_cast("decimal(38,0)")
    minus, digits = F.col("score").startswith("-"), F.ltrim(F.col("score"), F.lit("-"))
    size = F.when(minus, -F.length(digits)).otherwise(F.length(digits))
    flip = F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(minus, F.desc(size), F.desc(flip), "vec_id"))
    most = F.lit((1 << 63) - 1)
    fits = F.when(number.between(F.lit(-(1 << 63) + 1).cast("decimal(38,0)"), most.cast("decimal(38,0)")), number.cast("long")).otherwise(F.when(minus, F.lit(-(1 << 63) + 1) - 1).otherwise(most))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.alias("score"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP6_SQL = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS score
      FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, CAST(least(greatest(score, -9223372036854775808), 9223372036854775807) AS BIGINT) AS score FROM k WHERE rank <= 5
"""

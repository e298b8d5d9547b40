"""Lexical retrieval packing: the unused neighbours that a sharded BM25 index finds for a seed document fill its window.

Texts are tokenised once and stored, each with a *route*: four min-hashes of the pairs of successive ids of its piece (what
is left of it beside whole windows). Sorted by route, pieces that agree in the first min-hash lie together, among them
those that agree in the second, and so on; pieces of near copies meet with about the probability of their overlap. The sorted
pieces are dealt out by range of (route, row), so that one route of many pieces, such as copies, spreads over as many partitions
as it needs, and each partition cuts its run into shards of up to ``shard_tokens`` tokens or ``SHARD_DOCS`` pieces.

A shard has an inverted index of its pieces. The pieces of a shard are scored for a seed with BM25 over all its terms;
document frequencies and the mean length are those of the whole corpus. Seeds are taken in order; the unused pieces with the best scores
fill the seed's window, and a piece that does not fit is cut, its rest being the next seed. What is left of a shard, less
than a window, goes to the next one, and what is left of a partition to the next round, which has some thousand times fewer
partitions. The last round has one; what remains then, less than one window, is laid out in sequences whose lengths are powers of
two, which need no padding. So every id lies in exactly one piece and nothing is padded. The work grows with the input, as
shards have the same size at every size of it; a seed's neighbours are those of its shard, which the route decides.

A null text is empty and packs its end id alone; an empty table gives no rows. Other columns may have any names. Every row is packed, repeated rows and rows without a doc_id too. Ties in
score go to the earlier piece. Memory of a task is bounded by a shard, or by one document if that is larger; the driver
holds document frequencies, one number for each id of the vocabulary, and nothing for each row. Ids are kept in 16 bits: a
tokenizer with more than 65,536 ids is an error. Scores are sums in single precision.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import words as W
from tidemill.llm.common import release, ship, spread, stored, table, texts
from tidemill.llm.tokens import TOKENIZER, encoder_of

WINDOW, END_ID = 4096, 2
#: Tokens and pieces of a shard, and tokens of a partition of shards.
SHARD_TOKENS, SHARD_DOCS, PART_TOKENS = 2_000_000, 4_096, 8_000_000
#: Ids of the vocabulary whose document frequencies one row holds.
SEEN = 4096
#: BM25 constants.
K1, B = 1.2, 0.75
#: Ids that more than so many of 32 pieces have keep their weights for all pieces, others in postings.
OFTEN = 1
_A = np.random.default_rng(4096).integers(1, 1 << 62, 4, dtype=np.uint64) * W.U(2) + W.U(1)


def routes(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The route of each piece ids[off[i]:off[i + 1]]; equal pieces have equal routes. Pieces must not be empty."""
    n = len(off) - 1
    if not n:
        return np.zeros(0, np.int64)
    # The last id of a piece pairs with nothing; a piece of one id has just that pair.
    following = np.concatenate((ids[1:], [0])).astype(W.U)
    following[off[1:] - 1] = 1 << 16
    pair = W.mix(ids.astype(W.U) << W.U(20) | following)
    out = np.zeros(n, W.U)
    for a in _A:
        least = np.minimum.reduceat(pair * a, off[:-1])
        out = out << W.U(16) | W.mix(least) >> W.U(48)
    return (out >> W.U(1)).astype(np.int64)


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, ids, n, route, whole, seen), stored in the shared folder.

    ids are 16-bit little-endian ids of each text with the end id, n their number and ``row`` a key of its own: doc_id may
    repeat or be null. ``whole`` is the number of the first sequence that the row's whole windows fill. Each partition adds rows in
    which only ``n`` and ``seen`` stand: how many of its documents have each of SEEN ids from ``n`` on, as 32-bit integers.
    """
    from tokenizers import Tokenizer

    ship(docs.sparkSession)
    vocabulary = Tokenizer.from_file(public_tokenizers.path(tokenizer)).get_vocab_size()
    if max(vocabulary, end_id + 1) > 1 << 16:
        raise ValueError(f"{vocabulary} ids do not fit 16 bits")
    names = ["row", "doc_id", "ids", "n", "route", "whole", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u2")
        row = TaskContext.get().partitionId() << 36
        whole = 1 << 61 | row
        seen = np.zeros(vocabulary, "<u4")
        for b in batches:
            if not b.num_rows:
                continue
            each = [np.concatenate((x.astype("<u2"), end)) for x in encoder.ids(b.column(1))]
            n = np.array([len(x) for x in each], np.int64)
            every = np.concatenate(each)
            owner = np.repeat(np.arange(len(n)), n)
            for lo in range(0, len(n), 1 << 16):
                s = slice(int(n[:lo].sum()), int(n[: lo + (1 << 16)].sum()))
                both = np.sort((owner[s] - lo).astype(np.uint32) << np.uint32(16) | every[s])
                seen += np.bincount(both[np.concatenate(([True], both[1:] != both[:-1]))] & np.uint32(0xFFFF), minlength=vocabulary).astype("<u4")
            # Routes are those of the last piece, or of the last window where that is all there is.
            tail = np.where(n % window, n % window, window)
            end_at = np.cumsum(n)
            part = np.arange(len(every)) >= (end_at - tail)[owner]
            route = routes(every[part], np.concatenate(([0], np.cumsum(tail))))
            windows = n // window
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), b.column(0), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(n), pa.array(route), pa.array(whole + np.cumsum(windows) - windows), pa.nulls(len(n), pa.binary())], names)
            row, whole = row + len(n), whole + int(windows.sum())
        first = np.arange(0, vocabulary, SEEN)
        nothing = {c: pa.nulls(len(first), pa.binary() if c == "ids" else pa.int64()) for c in names} | {"n": pa.array(first)}
        yield pa.RecordBatch.from_arrays([*(nothing[c] for c in names[:-1]), pa.array([seen[i : i + SEEN].tobytes() for i in first.tolist()], pa.binary())], names)

    return stored(spread(texts(docs)).mapInArrow(run, "row long, doc_id long, ids binary, n long, route long, whole long, seen binary"), "tokens")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Document frequency of each id of the vocabulary over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        end = 0
        for b in batches:
            for first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = np.frombuffer(raw, "<u4")
                total[first : first + len(seen)] += seen
                end = max(end, first + len(seen))
        at = np.concatenate((np.flatnonzero(total), [end]))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate((total, [0]))[at])], ["term", "n"])

    # As many sums as cores go through the shuffle, however many partitions wrote one.
    each = tokens.where("seen IS NOT NULL").select("n", "seen").coalesce(max(1, tokens.sparkSession.sparkContext.defaultParallelism))
    got = each.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    df = np.zeros(int(got["term"].max()) if len(got) else 0, np.int64)
    got = got[got["n"] > 0]
    df[got["term"]] = got["n"]
    return df


class Shard:
    """Some pieces and their inverted index."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.pieces = len(ids)
        size = np.array([len(x) for x in ids], np.int64)
        both = np.sort(np.concatenate(ids).astype(np.uint32) << np.uint32(16) | np.repeat(np.arange(len(ids), dtype=np.uint32), size))
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        tf = np.diff(np.concatenate((first, [len(both)])))
        term, piece = (both[first] >> np.uint32(16)).astype(np.int64), (both[first] & np.uint32(0xFFFF)).astype(np.int64)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[piece] / max(mean, 1.0)))).astype(np.float32)
        # The inverted index: pieces and weights of a term begin at its ``at``.
        self.terms, at = np.unique(term, return_index=True)
        self.at = np.concatenate((at, [len(term)]))
        self.term, self.piece, self.weight = np.repeat(np.arange(len(at)), np.diff(self.at)), piece, weight
        self.by_piece = np.argsort(piece, kind="stable")
        self.own = np.searchsorted(piece[self.by_piece], np.arange(self.pieces + 1))
        often = np.flatnonzero(np.diff(self.at) * 32 > OFTEN * self.pieces)
        self.column = np.full(len(at), -1)
        self.column[often] = np.arange(len(often))
        column = self.column[self.term]
        some = column >= 0
        self.dense = np.zeros((len(often), self.pieces), np.float32)
        self.dense[column[some], piece[some]] = weight[some]

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all pieces: sums over all terms of the seed."""
        term = self.term[self.by_piece[self.own[seed] : self.own[seed + 1]]]
        column = self.column[term]
        rare = term[column < 0]
        n = self.at[rare + 1] - self.at[rare]
        post = np.repeat(self.at[rare] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.piece[post], self.weight[post], self.pieces).astype(np.float32) + self.dense[column[column >= 0]].sum(0)


def windows(length: list[int], scores: Callable[[int], np.ndarray], window: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows, as lists of (piece, first id, number of ids), and what is left. ``scores`` gives those of a seed."""
    start, left = np.zeros(len(length), np.int64), np.array(length, np.int64)
    total, full, rest, first = int(left.sum()), [], -1, 0
    while total >= window:
        if rest < 0:
            while not left[first]:
                first += 1
            rest = first
        seed, items, room = rest, [], window
        free = np.flatnonzero(left)
        free = free[free != seed]
        rest = -1
        for p in [seed, *free[np.argsort(-scores(seed)[free], kind="stable")].tolist()]:
            take = min(int(left[p]), room)
            items.append((p, int(start[p]), take))
            start[p] += take
            left[p] -= take
            room -= take
            if not room:
                rest = p if left[p] else -1
                break
        full.append(items)
        total -= window
    # The rest of a cut piece goes on as the first seed.
    order = ([rest] if rest >= 0 else []) + [p for p in np.flatnonzero(left).tolist() if p != rest]
    return full, [(p, int(start[p]), int(left[p])) for p in order]


def powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Less than a window of (piece, first id, number of ids), as sequences whose lengths are powers of two."""
    left, size, rest = sum(p[2] for p in pieces), window, list(pieces)
    while left:
        while size > left:
            size //= 2
        sequence, room = [], size
        while room:
            p, s, n = rest.pop(0)
            take = min(n, room)
            sequence.append((p, s, take))
            room -= take
            if take < n:
                rest.insert(0, (p, s + take, n - take))
        left -= size
        yield sequence


PIECE = "row long, doc_id long, n long, route long, start long, ids binary"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _placed(with_ids: bool):
    """A function that makes a row of SCHEMA for ids of a document."""

    def row(doc, start: int, ids: np.ndarray, n: int, sequence: int, offset: int) -> tuple:
        raw = ids.astype("<u4").tobytes()
        return (doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, raw if with_ids else None)

    return row


def _columns(rows: list[tuple], types: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in types.split(", ")]
    cells = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cells, fields, strict=True)], [f for f, _ in fields])


def _round(pieces: DataFrame, number: int, parts: int, idf: np.ndarray, mean: float, window: int, shard_tokens: int, with_ids: bool) -> DataFrame:
    """Rows of SCHEMA for what fits whole windows; what is left of each partition has null sequence_id and, behind SCHEMA,
    row and route. With one partition nothing is left."""
    make = _placed(with_ids)
    sent = pieces.sparkSession.sparkContext.broadcast((idf, mean))  # one number for each id of the vocabulary
    schema = f"{SCHEMA}, row long, route long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weights, mean_length = sent.value
        sequence = number << 58 | TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (row, doc_id, n, route, start, ids)
        size = 0

        def pack() -> list[tuple]:
            nonlocal held, size, sequence
            ids = [p[5] for p in held]
            full, left = windows([len(x) for x in ids], Shard(ids, weights, mean_length).scores, window)
            out = []
            for items in full:
                offset = 0
                for p, s, k in items:
                    _, doc, n, _, start, x = held[p]
                    out.append((*make(doc, start + s, x[s : s + k], n, sequence, offset), None, None))
                    offset += k
                sequence += 1
            held = [(*held[p][:4], held[p][4] + s, held[p][5][s : s + k]) for p, s, k in left]
            size = sum(len(p[5]) for p in held)
            return out

        for b in batches:
            for row, doc, n, route, start, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, "<u2")
                if size >= window and (size + len(x) > shard_tokens or len(held) >= SHARD_DOCS):
                    yield _columns(pack(), schema)
                held.append((row, doc, n, route, start, x))
                size += len(x)
        if size >= window:
            yield _columns(pack(), schema)
        out = []
        if parts == 1:
            for items in powers([(p, 0, len(h[5])) for p, h in enumerate(held)], window):
                offset = 0
                for p, s, k in items:
                    _, doc, n, _, start, x = held[p]
                    out.append((*make(doc, start + s, x[s : s + k], n, sequence, offset), None, None))
                    offset += k
                sequence += 1
        else:
            out = [(doc, start, len(x), None, n, None, None, x.tobytes(), row, route) for row, doc, n, route, start, x in held]
        yield _columns(out, schema)

    dealt = pieces.repartition(1) if parts == 1 else pieces.repartitionByRange(parts, "route", "row", "start")
    return stored(dealt.sortWithinPartitions("route", "row", "start").mapInArrow(run, schema), f"round{number}")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, part_tokens: int = PART_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian 32-bit integers (null without ``with_ids``)."""
    tokens = tokenised(docs, tokenizer, end_id, window)
    df, rows = frequencies(tokens), tokens.where("row IS NOT NULL")
    tail = F.col("n") % window
    n_docs, n_ids, left = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(tail), F.lit(0))).first()
    idf, mean = np.log1p((n_docs - df + 0.5) / (df + 0.5)), min(n_ids / max(n_docs, 1), window)
    make = _placed(with_ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, raw, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, "<u2")
                for lo in range(0, n // window, 1024):
                    some = range(lo, min(lo + 1024, n // window))
                    yield _columns([make(doc, i * window, x[i * window : (i + 1) * window], n, first + i, 0) for i in some], SCHEMA)

    out = rows.where(F.col("n") >= window).select("doc_id", "ids", "n", "whole").mapInArrow(whole, SCHEMA)
    ids = F.when(F.col("n") < window, F.col("ids")).otherwise(F.expr(f"substring(ids, cast(2 * (n - n % {window}) + 1 as int), cast(2 * (n % {window}) as int))"))
    pieces = rows.where(tail > 0).select("row", "doc_id", "n", "route", (F.col("n") - tail).alias("start"), ids.alias("ids"))
    number = 1
    while left:
        parts = -(-left // part_tokens)
        done = _round(pieces, number, parts, idf, mean, window, shard_tokens, with_ids)
        out = out.unionByName(done.where("sequence_id IS NOT NULL").select(*NAMES))
        if parts == 1:
            break
        rest = done.where("sequence_id IS NULL")
        left = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        pieces = rest.select("row", "doc_id", F.col("doc_tokens").alias("n"), "route", "start", "ids")
        number += 1
    return out


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")

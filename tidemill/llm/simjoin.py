"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (a text of one to four words is one shingle). Texts with equal sets are one
class from the start, so copies are never compared. A set is represented by a sketch of ``COORDINATES`` sampled shingles
(minima under random hash functions); sets that share a fraction J of their shingles agree in a coordinate with
probability J.

The join runs ``runs`` trees at once. At a node one coordinate, or with the probability that makes 1 / J on average two, is
chosen from the node's own randomness, and the sets of the node go to children by the token sampled there. Buckets of up to
``bucket`` sets are compared by brute force; larger ones are split again, up to ``depth`` times, and buckets that
are still larger (many near copies) are compared in blocks against blocks. Pairs whose sketches agree in ``least`` of the
coordinates or more are candidates. ``runs`` follows from the target recall of a pair at the threshold: over all numbers of
coordinates in which it may agree, it has to be a candidate and to stay together down to the deepest level in one of the runs.

A bucket gives the spanning links of its candidate pairs, so its rows grow with its sets and not with its pairs. Their
components are small candidate groups, in which all pairs are then compared exactly on whole shingle sets. Groups of more
than ``block`` sets or ``BLOCK_SHINGLES`` shingles are cut into blocks, and pairs of blocks are compared, so that a task
holds a bounded part of a group (or two sets, where these alone are larger). The links found there give each text its number of links, and their components its class. Classes are
chains of links: two texts of a class need not be similar themselves.

An empty table gives no rows; other columns may have any names. Null texts and texts without words are classes of their own, without links. Rows that share a doc_id and a set are copies
of each other like others. Rows without a doc_id take part; the class_id is null only where no row of a class has one. Shingles are 64-bit hashes of words as they stand (case and punctuation count).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import words as W
from tidemill.llm.common import meet, release, ship, spread, stored, table, texts
from tidemill.llm.components import components, tree

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99
COORDINATES, BUCKET, DEPTH = 128, 512, 4
#: Sets and shingles of a block of a candidate group, and bytes of tables that may be broadcast.
BLOCK, BLOCK_SHINGLES, BROADCAST_BYTES = 512, 2_000_000, 32 << 20
_RNG = np.random.default_rng(1729)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_agreement(similarity: float) -> int:
    """Coordinates in which the sketches of a candidate pair agree: three deviations below the threshold."""
    return math.ceil((similarity - 3 * math.sqrt(similarity * (1 - similarity) / COORDINATES)) * COORDINATES)


def survival(depth: int, similarity: float, agreement: float | None = None) -> float:
    """Probability that a pair that agrees in this share of coordinates shares a node after ``depth`` levels of a tree for ``similarity``."""
    two, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        one = 1 - (similarity if agreement is None else agreement) * (1 - lost)
        lost = (1 - two) * one + two * one * one
    return 1 - lost


def recall_of(runs: int, depth: int, similarity: float, pair: float | None = None) -> float:
    """Probability that a pair of similarity ``pair`` (the threshold) is found by ``runs`` trees."""
    j, total = similarity if pair is None else pair, 0.0
    for m in range(least_agreement(similarity), COORDINATES + 1):
        there = math.comb(COORDINATES, m) * j**m * (1 - j) ** (COORDINATES - m)
        total += there * (1 - (1 - survival(depth, similarity, m / COORDINATES)) ** runs)
    return total


def runs_for(recall: float, depth: int, similarity: float) -> int:
    """The fewest runs that reach the recall at the threshold."""
    for runs in range(1, 1000):
        if recall_of(runs, depth, similarity) >= recall:
            return runs
    raise ValueError(f"no number of runs reaches a recall of {recall}")


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some rows at a time: their number, offsets of their sets, and the sets (sorted distinct hashes) end to end."""
    for lo, hi, buf, off in W.steps(text):
        n = hi - lo
        row, start, end = W.spans(buf, off, W.NOT_SPACE)
        h = W.hashes(buf, start, end)
        _, owner, g = W.grams(row, h, k)
        total = W.count(row, n)
        # Short texts: all their words as one shingle, told apart from others by their number.
        short = np.flatnonzero((total > 0) & (total < k))
        if len(short):
            at = np.cumsum(total) - total
            more = np.array([W.mix(np.array([(int(total[r]) + sum(int(h[at[r] + j]) * (j + 3) for j in range(int(total[r])))) & 0xFFFFFFFFFFFFFFFF], W.U))[0] for r in short], W.U)
            owner, g = np.concatenate((owner, short)), np.concatenate((g, more))
        order = np.lexsort((g, owner))
        owner, g = owner[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        owner, g = owner[new], g[new]
        yield n, np.concatenate(([0], np.cumsum(W.count(owner, n)))), g


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key to find a text again: the doc_id, or for a row without one (``nameless``) its text's hash."""
    return texts(docs).withColumn("nameless", F.col("doc_id").isNull()).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, nameless, key, sid, sketch, shingles): the digest of each row's set, its sampled shingles and its size; null for
    texts without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sids, out, sizes = [], [], []
            for n, off, sets in shingle_sets(b.column(1)):
                sizes.append(np.diff(off))
                full = np.flatnonzero(off[1:] > off[:-1])
                least = np.empty((len(full), COORDINATES), "<u4")
                if len(full):
                    for i in range(COORDINATES):
                        least[:, i] = np.minimum.reduceat((sets * _A[i] + _B[i]) >> np.uint64(32), off[full])
                at = dict(zip(full.tolist(), range(len(full)), strict=True))
                for r in range(n):
                    sids.append(_digest(sets[off[r] : off[r + 1]]) if r in at else None)
                    out.append(least[at[r]].tobytes() if r in at else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sids, pa.binary()), pa.array(out, pa.binary()), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], ["doc_id", "nameless", "key", "sid", "sketch", "shingles"])

    return spread(_keyed(docs)).mapInArrow(run, "doc_id long, nameless boolean, key long, sid binary, sketch binary, shingles long")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _children(key: np.ndarray, sketch: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys of the child nodes they go to) for the node ``key`` of each row."""
    coin = W.mix(key ^ W.U(0xA5A5A5A5A5A5A5A5))
    two = (coin >> W.U(11)).astype(float) / float(1 << 53) < 1 / similarity - 1
    rows = np.arange(len(key))
    for nth in range(2):
        r = rows if nth == 0 else rows[two]
        coordinate = (W.mix(key[r] + W.U(0x9E3779B97F4A7C15) * W.U(nth + 1)) % W.U(COORDINATES)).astype(np.int64)
        yield r, W.mix(key[r] * W.U(0xC2B2AE3D27D4EB4F) + (coordinate.astype(W.U) << W.U(32)) + sketch[r, coordinate].astype(W.U))


def _split(nodes: DataFrame, runs: int, similarity: float) -> DataFrame:
    """(key, sid) of the children of ``nodes`` (key, sid, sketch); a null key stands for the roots of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sketch = _matrix(b.column(2), "<u4", COORDINATES)
            if b.column(0).null_count:
                roots = [np.full(b.num_rows, r + 1, W.U) for r in range(runs)]
            else:
                roots = [b.column(0).to_numpy().view(W.U)]
            for root in roots:
                for rows, keys in _children(W.mix(root), sketch, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1).take(pa.array(rows))], ["key", "sid"])

    return nodes.select("key", "sid", "sketch").mapInArrow(run, "key long, sid binary")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for i in range(keys):
            c = b.column(i).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(b.column(i)[s].as_py() for i in range(keys)) if s == 0 else None
            if held and (s > 0 or key != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def spanning(n: int, like: Callable[[int], np.ndarray]) -> np.ndarray:
    """Labels of the components of n rows; like(i) marks the rows that row i links to. Stops once all are one."""
    label, parts = np.arange(n), n
    for i in range(n):
        hit = np.unique(label[like(i)])
        if len(hit) > 1:
            label[np.isin(label, hit)] = hit[0]
            parts -= len(hit) - 1
            if parts == 1:
                break
    return label


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` with i, j: of a group that is cut into several ``blocks`` every row goes to all pairs that have its own.

    Groups that fit have the pair (0, 0). Every pair of rows of a group meets in exactly one pair of blocks, up to pairs
    of one block, which meet in (i, i).
    """
    k = F.greatest(F.lit(1), blocks).cast("long")
    own = F.pmod(F.xxhash64("sid"), k)
    return rows.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), k - 1))).withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("o")


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def candidates(reps: DataFrame, similarity: float, recall: float, bucket: int, depth: int) -> DataFrame:
    """Links (a, b) that span the candidate pairs of ``reps`` (sid, sketch)."""
    runs = runs_for(recall, depth, similarity)
    least = least_agreement(similarity)
    nodes, leaves = _split(reps.select(F.lit(None).cast("long").alias("key"), "sid", "sketch"), runs, similarity), []
    for level in range(1, depth + 1):
        level_rows = stored(nodes.distinct() if level > 1 else nodes, f"level{level}")
        size = level_rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        shared = stored(level_rows.join(size, "key"), f"shared{level}")
        leaves.append(shared if level == depth else shared.where(F.col("size") <= bucket))
        large = shared.where(F.col("size") > bucket)
        if level == depth or large.isEmpty():
            break
        nodes = _split(large.join(reps, "sid"), runs, similarity)
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    rows = _in_blocks(rows.join(reps, "sid"), F.ceil(F.col("size") / bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups(batches, 3):
            sids = g.column("sid").to_pylist()
            low = _matrix(g.column("sketch"), "<u4", COORDINATES).astype(np.uint8)
            if len(sids) == 2:
                label = np.zeros(2, int) if int((low[0] == low[1]).sum()) >= least else np.arange(2)
            else:
                label = spanning(len(sids), lambda i, low=low: np.count_nonzero(low == low[i], axis=1) >= least)
            parts: dict[int, list[bytes]] = {}
            for s, x in zip(sids, label.tolist(), strict=True):
                parts.setdefault(x, []).append(s)
            for part in parts.values():
                for one, other in tree(sorted(part)):
                    a.append(one)
                    b.append(other)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return _sorted(rows.select("key", "i", "j", "sid", "sketch"), "key", "i", "j").mapInArrow(run, "a binary, b binary")


def exact(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of the pairs of sets with at least this Jaccard similarity."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n <= 3:
        both = np.diag(size)
        for i in range(n):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        value, row = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        keep = times[column] > 1
        number = np.cumsum(times > 1) - 1
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((n, n), np.float64)
        step = max(64, min(4096, (32 << 20) // (4 * n)))
        total = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, total, step):
            s, e = np.searchsorted(column, [lo, lo + step])
            m = np.zeros((n, min(step, total - lo)), np.float32)
            m[row[s:e], column[s:e] - lo] = 1
            both += m @ m.T
        both = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    out = both >= similarity * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def verified(docs: DataFrame, grouped: DataFrame, similarity: float, block: int) -> DataFrame:
    """(sid, n_text_links, n_links, root, parent, blocks) from all pairs within the groups of ``grouped``.

    ``grouped`` has (sid, label, copies, shingles, at): at is (nameless, key) of a row with the set. n_links counts copies.
    root is the same for all sets that are connected within a pair of blocks, and links to parents connect them.
    """
    grouped = stored(grouped, "grouped")
    rows = grouped.count()
    size = grouped.groupBy("label").agg(F.count("*").alias("size"), F.sum("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    wanted = meet(grouped.drop("shingles"), size, "label", "size", "sid", rows).select("at.nameless", "at.key", F.col("sid").alias("want"), "label", "copies", blocks.alias("blocks"))
    wanted = stored(wanted, "wanted")
    small = rows * 80 <= BROADCAST_BYTES
    found = _keyed(docs).join(F.broadcast(wanted) if small else wanted, ["nameless", "key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out, r = [], [], 0
            want = b.column("want").to_pylist()
            for n, off, s in shingle_sets(b.column("text")):
                for i in range(n):
                    own = s[off[i] : off[i + 1]]
                    if len(own) and _digest(own) == want[r]:  # another row may share the key
                        keep.append(r)
                        out.append(own.tobytes())
                    r += 1
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("label", "want", "copies", "blocks")), pa.array(out, pa.binary())], ["label", "sid", "copies", "blocks", "set"])

    rows = _in_blocks(found.select("text", "want", "label", "copies", "blocks").mapInArrow(sets, "label binary, sid binary, copies long, blocks long, set binary"), F.col("blocks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            own: dict[bytes, tuple[int, int, np.ndarray]] = {}
            for sid, copies, part, raw in zip(*(g.column(c).to_pylist() for c in ("sid", "copies", "own", "set")), strict=True):
                own[sid] = (copies, part, np.frombuffer(raw, W.U))
            sids = sorted(own)
            link = exact([own[s][2] for s in sids], similarity)
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            if i != j:  # pairs of one block meet elsewhere
                part = np.array([own[s][1] for s in sids])
                link &= part[:, None] != part[None, :]
            copies = np.array([own[s][0] for s in sids], np.int64)
            label = spanning(len(sids), lambda x, link=link: link[x] | (np.arange(len(link)) == x))
            members: dict[int, list[bytes]] = {}
            for s, x in zip(sids, label.tolist(), strict=True):
                members.setdefault(x, []).append(s)
            parent = {b: a for part in members.values() for a, b in tree(part)}
            cut = g.column("blocks")[0].as_py() > 1
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(link.sum(1)), pa.array(link @ copies), pa.array([members[x][0] for x in label.tolist()], pa.binary()), pa.array([parent.get(s, s) for s in sids], pa.binary()), pa.array([cut] * len(sids))], ["sid", "n_text_links", "n_links", "root", "parent", "blocks"])

    by = _sorted(rows.select("label", "i", "j", "sid", "copies", "own", "blocks", "set"), "label", "i", "j")
    return by.mapInArrow(compare, "sid binary, n_text_links long, n_links long, root binary, parent binary, blocks boolean")


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies) of each row of ``docs``.

    class_id is the smallest doc_id of the class. n_links counts the other documents it links to, copies among them;
    n_text_links the different sets, n_copies the rows with the same set, itself included.
    """
    members = stored(sketches(docs), "sketches")
    reps = stored(members.where("sid IS NOT NULL").groupBy("sid").agg(F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles"), F.min("doc_id").alias("carrier"), F.min(F.struct("nameless", "key")).alias("at"), F.count("*").alias("copies")), "sets")
    narrow = reps.select("sid", "carrier", "copies")
    located = reps.select("sid", "at", "copies", "shingles")
    labels = components(candidates(reps.select("sid", "sketch"), similarity, recall, bucket, depth))
    grouped = labels.join(located, labels.v == located.sid).select("sid", "label", "copies", "shingles", "at")
    parts = stored(verified(docs, grouped, similarity, block), "verified")
    linked = parts.groupBy("sid").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_links").alias("n_links"), F.min("root").alias("root"))
    cut = parts.where("blocks")
    if not cut.isEmpty():
        over = components(cut.select(F.col("parent").alias("a"), F.col("sid").alias("b")))
        linked = linked.join(over, linked.sid == over.v, "left").select("sid", "n_text_links", "n_links", F.coalesce("label", "root").alias("root"))
    linked = stored(linked, "linked")
    first = linked.join(narrow, "sid").groupBy("root").agg(F.min("carrier").alias("class_id"), F.count("*").alias("size"))
    known = meet(linked, first, "root", "size", "sid", linked.count()).select("sid", "class_id", "n_text_links", "n_links")
    per_set = narrow.join(known, "sid", "left").select("sid", F.coalesce("class_id", "carrier").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), F.col("copies").alias("n_copies"))
    names = ("doc_id", "class_id", "n_links", "n_text_links", "n_copies")
    # A set with very many copies would be one task of this join.
    with_words = meet(members.where("sid IS NOT NULL").select("doc_id", "sid"), stored(per_set, "classes"), "sid", "n_copies", F.monotonically_increasing_id(), members.count()).select(*names)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return with_words.unionByName(members.where("sid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), one.alias("n_copies")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))

"""Toxic passages by maximum-scoring segments.

Every word has a score: the lower confidence bound of its log-odds between toxic and clean labelled texts, under a Dirichlet
prior that follows the word's share of all labelled texts. Words without such evidence score ``-DRIFT``. A linear scan over
a text's words finds every maximal scoring segment. Extreme-value statistics tell what a segment of a score is worth in a text
of that length: with ``lam`` from the scores of words in clean texts and ``k`` from the best segments of clean texts,
``e = k * words * exp(-lam * score)`` such segments are expected by chance. Segments with ``e`` of at most ``SIGNIFICANT``
are the passages; the logarithms of a text's passages add up (the best segment counts where none is significant), and a
logistic curve, fitted on labelled rows that gave no counts, turns the sum into the probability of label 1.

Counts are of texts that hold a word, in two rounds: in the second a toxic text counts for a word by the word's odds beside the
highest of the text, so that words which merely stand beside toxic ones lose their evidence. A word without evidence of
its own has that of its stem, its first ``STEM`` bytes, which is counted like a word.

The fit reads about ``max_labelled`` labelled rows at most, chosen by hash of doc_id, and keeps at most ``MAX_TOKENS``
words of the highest score; all rows are scored, whole texts, in one pass. Words are runs of ASCII letters and digits and all
characters beyond ASCII, with A-Z lower-cased; equal 64-bit hashes count as equal words.

Null and empty texts have no words and get the probability of a text without evidence, as does every text without words.
Null labels and null doc_ids do not train; of several labels of one doc_id the largest counts. Without labels of both
kinds there is no evidence and every row scores the share of label 1 (0 without labels). Every row gives one row,
repeated rows too; an empty table gives none. Of other columns only doc_id and text are read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import words as W
from tidemill.llm.common import forget, ship, spread, stored, table, texts
from tidemill.llm.langid import fold

MAX_LABELLED, MAX_TOKENS = 50_000, 100_000
#: Score of a word without evidence, standard errors below the estimate, and what the prior is worth in texts.
DRIFT, BOUND, PRIOR = 0.25, 2.0, 5.0
#: Odds by which a text is toxic for no word in it, and bytes of a stem.
NOISE, STEM = 5.0, 5
#: Segments expected by chance, up to which one counts as a passage.
SIGNIFICANT = 0.01
#: Evidence is counted in bins of this width between these ends for the logistic curve.
BIN, LOW, HIGH = 0.25, -20.0, 40.0
_LOWER = np.where((W.BYTES >= 65) & (W.BYTES <= 90), W.BYTES + 32, W.BYTES).astype(np.uint8)
_KEEP = (W.BYTES >= 128) | np.isin(W.BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyz"))


def _hashed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, hash of the stem) of every word."""
    low = _LOWER[buf]
    row, start, end = W.spans(low, off, _KEEP)
    return row, W.hashes(low, start, end), W.hashes(low, start, np.minimum(end, start + STEM))


def _distinct(row: np.ndarray, h: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word and stem once for each row."""
    row, h = np.concatenate((row, row)), np.concatenate((h, stem))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, bound: float = BOUND) -> np.ndarray:
    """Log-odds of words held by so many toxic and clean texts of ``n_toxic`` and ``n_clean``, less ``bound`` standard errors."""
    prior = 0.5 + PRIOR * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + PRIOR + 1 - toxic)) - np.log(b / (n_clean + PRIOR + 1 - clean))
    return odds - bound * np.sqrt(1 / a + 1 / b)


def segments(place: np.ndarray, value: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first word, last word), in order: words at ``place`` have the positive
    ``value``, all others ``-drift``. Each candidate knows the last one that begins lower, so the scan is linear."""
    found: list[list] = []  # sum before, sum behind, first, last, place of the last candidate with a lower sum before
    before = np.cumsum(value) - value - drift * (place - np.arange(len(place)))
    for p, v, low in zip(place.tolist(), value.tolist(), before.tolist(), strict=True):
        new = [low, low + v, p, p, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = found[j][4]
            if j < 0 or found[j][1] >= new[1]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(b - a, s, e) for a, b, s, e, _ in found]


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted hashes
    value: np.ndarray  # their positive scores
    lam: float
    k: float
    curve: tuple[float, float]  # logistic: a + b * evidence
    base: float  # share of label 1 where there is no evidence at all

    def values(self, h: np.ndarray) -> np.ndarray:
        """Scores of words, 0 for those without evidence."""
        if not len(self.tokens) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return np.where(self.tokens[at] == h, self.value[at], 0.0)

    def places(self, h: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the words with evidence."""
        value = self.values(h)
        value = np.where(value > 0, value, self.values(stem))
        hit = np.flatnonzero(value)
        return hit, value[hit]

    def expected(self, words: int, score: float) -> float:
        return self.k * words * math.exp(-min(self.lam * score, 700.0))

    def evidence(self, words: int, found: list[tuple[float, int, int]]) -> float:
        """The sum over passages of -log(expected), or that of the best segment, or of a text without one."""
        if not words:
            return LOW
        worth = [self.lam * s - math.log(self.k * words) for s, _, _ in found]
        strong = [w for w in worth if w >= -math.log(SIGNIFICANT)]
        return min(HIGH, max(LOW, sum(strong) if strong else max(worth, default=-math.log(self.k * words))))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(evidence), self.base)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * evidence, -500, 500)))


def _scan(text: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """For each row its number of words and its segments."""
    for lo, hi, buf, off in W.steps(text):
        row, *hashes = _hashed(buf, off)
        words = W.count(row, hi - lo)
        begin = np.concatenate(([0], np.cumsum(words)))
        place, value = model.places(*hashes)
        cut = np.searchsorted(place, begin)
        for i in range(hi - lo):
            a, b = cut[i], cut[i + 1]
            yield int(words[i]), segments(place[a:b] - begin[i], value[a:b]) if b > a else []


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic, judge) of at most about ``max_labelled`` labelled rows; those with ``judge`` fit the curve, the others count."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    marked = marked.withColumn("h", F.xxhash64("doc_id"))
    share = min(1.0, 0.95 * max_labelled / max(1, marked.count()))
    chosen = marked.where(F.shiftrightunsigned("h", 34) < int(share * (1 << 30)))
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic", (F.pmod("h", F.lit(4)) == 0).alias("judge"))  # bounded by max_labelled


def _presence(rows: DataFrame) -> DataFrame:
    """(h, toxic, clean): texts of either label that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for lo, hi, buf, off in W.steps(b.column(0)):
                row, h = _distinct(*_hashed(buf, off))
                words, at = np.unique(h, return_inverse=True)
                mark = label[lo:hi][row] == 1
                n = [np.bincount(at[m], minlength=len(words)) for m in (mark, ~mark)]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["h", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _shares(rows: DataFrame, model: Model) -> DataFrame:
    """(h, n): texts that hold a word, each counted by the word's odds beside the highest odds of the text and ``NOISE``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo, hi, buf, off in W.steps(b.column(0)):
                row, h = _distinct(*_hashed(buf, off))
                value = m.values(h)
                some = np.flatnonzero(value)
                odds, most = np.exp(value[some]), np.zeros(hi - lo)
                np.maximum.at(most, row[some], odds)
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(odds / (most[row[some]] + NOISE))], ["h", "n"])

    return rows.select("text").mapInArrow(run, "h long, n double").groupBy("h").agg(F.sum("n").alias("n"))


def _rate(value: np.ndarray, share: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of sum(share * exp(lam * value)) = 1, where the words that are left score -drift."""
    rest = max(0.0, 1.0 - float(share.sum()))

    def over(lam: float) -> bool:
        return float((share * np.exp(np.minimum(lam * value, 700.0))).sum()) + rest * math.exp(-lam * drift) > 1.0

    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return low


def _logistic(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[float, float]:
    """a and b >= 0 of the likeliest 1 / (1 + exp(-a - b x)) for counts of either label, with a weak pull to 0 on b."""
    a, b = math.log((n1.sum() + 0.5) / (n0.sum() + 0.5)), 0.1
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n1 - (n1 + n0) * p).sum(), ((n1 - (n1 + n0) * p) * x).sum() - b])
        w = (n1 + n0) * p * (1 - p) + 1e-9
        hess = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if b > 0 else (math.log((n1.sum() + 0.5) / (n0.sum() + 0.5)), 0.0)


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, words, best, evidence) of each of the labelled rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, max((s for s, _, _ in found), default=0.0), sent.value.evidence(n, found)) for n, found in _scan(b.column(0), sent.value)]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64())))], ["toxic", "words", "best", "evidence"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, words long, best double, evidence double")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks."""
    ship(docs.sparkSession)
    rows = stored(spread(_labelled(docs, labels, max_labelled)), "toxicity-rows")
    counting, judging = rows.where("NOT judge"), rows.where("judge")
    n = {(r["judge"], r["toxic"]): r["count"] for r in rows.groupBy("judge", "toxic").count().collect()}
    n1, n0 = n.get((False, 1), 0), n.get((False, 0), 0)
    both = [sum(v for (_, t), v in n.items() if t == label) for label in (0, 1)]
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, (0.0, 0.0), (both[1] + 0.5) / (sum(both) + 1) if sum(both) else 0.0)
    if not n1 or not n0:
        forget(rows)
        return none
    held = stored(_presence(counting), "toxicity-words")
    odds = F.log((F.col("toxic") + F.col("p")) / (n1 + PRIOR + 1 - F.col("toxic"))) - F.log((F.col("clean") + F.col("p")) / (n0 + PRIOR + 1 - F.col("clean")))
    error = F.sqrt(1 / (F.col("toxic") + F.col("p")) + 1 / (F.col("clean") + F.col("p")))
    strong = held.withColumn("p", 0.5 + PRIOR * (F.col("toxic") + F.col("clean")) / (n1 + n0)).withColumn("s", odds - BOUND * error).where("s > 0")
    first = strong.orderBy(F.desc("s"), "h").limit(MAX_TOKENS).select("h", "toxic", "clean").toPandas().sort_values("h")
    h = first["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, toxic, clean = h[order], first["toxic"].to_numpy(float)[order], first["clean"].to_numpy(float)[order]
    model = Model(h, np.maximum(log_odds(toxic, clean, n1, n0, 0.0), 1e-6), 1.0, 1.0, (0.0, 0.0), none.base)
    share = _shares(counting.where("toxic = 1"), model).toPandas()
    weighed = np.zeros(len(h))
    weighed[np.searchsorted(h, share["h"].to_numpy().view(np.uint64))] = share["n"]
    value = np.round(log_odds(weighed, clean, n1, n0), 6)  # the order of summing must not matter
    keep = value > 0
    if not keep.any():
        forget(rows)
        forget(held)
        return none
    total = held.agg(F.sum("clean")).first()[0]
    h, value, clean = h[keep], value[keep], clean[keep]
    lam = _rate(value, (clean + 0.5) / (total + 0.5 * len(value)))
    model = Model(h, value, lam, 1.0, (0.0, 0.0), none.base)
    # k * words * exp(-lam * best) is exponential with mean 1 over clean texts.
    mean = _evidence(counting.where("toxic = 0"), model).where("words > 0").agg(F.avg(F.col("words") * F.exp(-lam * F.col("best")))).first()[0]
    model = Model(h, value, lam, 1.0 / max(round(mean or 1.0, 6), 1e-6), (0.0, 0.0), none.base)
    bins = _evidence(judging, model).groupBy(F.floor(F.col("evidence") / BIN).alias("bin")).agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).toPandas().sort_values("bin")
    curve = _logistic((bins["bin"].to_numpy(float) + 0.5) * BIN, bins["n1"].to_numpy(float), bins["n0"].to_numpy(float))
    forget(rows)
    forget(held)
    return Model(h, value, lam, model.k, curve, none.base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the passages of each row of ``docs``: first and last word, score and expected number by chance."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    passage = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            evidence, spans = [], []
            for n, found in _scan(b.column(1), m):
                evidence.append(m.evidence(n, found))
                spans.append([{"first_word": a, "last_word": z, "score": s, "expected": e} for s, a, z in found if (e := m.expected(n, s)) <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.probability(np.array(evidence, float))), pa.array(spans, pa.list_(passage))], ["doc_id", "score", "passages"])

    return spread(texts(docs)).mapInArrow(run, "doc_id long, score double, passages array<struct<first_word:long,last_word:long,score:double,expected:double>>")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold(table(spark, sf_dir, "labels")).where(~F.col("held_out")))
    out = fold(score(docs, model))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))

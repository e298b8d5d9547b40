"""Quality rules as learned decision lists.

Statistics of every whole text are counted in one map pass. From labelled ones, sequential covering learns an ordered
list of rules against bad documents: each rule is a conjunction of thresholds, grown by information gain on two thirds
of the labelled rows, pruned on the rest, and kept while it stays precise; rows that it covers leave the training set.
The list is emitted as one Spark ``CASE`` expression, which judges all rows.

The fit reads at most ``max_labelled`` labelled rows, chosen by the hash of doc_id; nothing else is bounded.
Nulls are empty texts (all statistics 0); an empty table gives no rows, texts of any length are read whole, a few MB at a
time, and other columns may have any names. Of rules that cover as much the shorter one, then the later feature by name goes first. Null labels are not used; of several labels of one doc_id the largest counts.
Without labels of both kinds the list is empty and keeps everything that the base rules keep. Every row gives one row.
Repeats of words and lines are found by 64-bit hashes within a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import words as W
from tidemill.llm.common import ship, spread, stored, table, texts

MAX_LABELLED = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_chars_all")
# The base rules and their characters.
SYMBOLS = np.isin(W.BYTES, list(b"#*$%&|<>"))
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
_UPPER = np.isin(W.BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_DIGIT = np.isin(W.BYTES, list(b"0123456789"))
_MARK = np.isin(W.BYTES, list(b"!?.,;:()[]{}\"'/\\@^_`~=+-"))
_NOT_TAIL = (W.BYTES & 0xC0) != 0x80
#: What rules may test, as SQL over the statistics.
FEATURES = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words",
}


def _stats(text: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {s: [] for s in STATS}
    for lo, hi, buf, off in W.steps(text):
        n = hi - lo
        row, start, end = W.spans(buf, off, W.NOT_SPACE)
        h = W.hashes(buf, start, end)
        first, owner, g = W.grams(row, h, 3)
        _, inverse, times = np.unique(W.mix(g ^ (owner.astype(W.U) * W.U(0x9FB21C651E98DF25))), return_inverse=True, return_counts=True)
        twice = first[times[inverse] > 1] if len(first) else first
        covered = np.zeros(len(row), bool)
        for j in range(3):
            covered[twice + j] = True
        lrow, ls, le = W.spans(buf, off, W.NOT_NEWLINE)
        seen = np.concatenate(([0], np.cumsum(W.NOT_SPACE[buf])))
        full = seen[le] > seen[ls]
        lrow, lh = lrow[full], W.hashes(buf, ls[full], le[full])
        lines = W.count(lrow, n)
        tail = _NOT_TAIL[buf]
        for k, v in (
            ("n_words", W.count(row, n)),
            ("word_chars", W.tally(W.NOT_SPACE[buf] & tail, off)),
            ("n_symbols", W.tally(SYMBOLS[buf], off)),
            ("n_dup_lines", lines - _distinct(lrow, lh, n)),
            ("n_repeat_words", W.count(row[covered], n)),
            ("n_lines", lines),
            ("n_upper", W.tally(_UPPER[buf], off)),
            ("n_digits", W.tally(_DIGIT[buf], off)),
            ("n_marks", W.tally(_MARK[buf], off)),
            ("n_distinct_words", _distinct(row, h, n)),
            ("n_chars_all", W.tally(tail, off)),
        ):
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    if not len(row):
        return np.zeros(n, np.int64)
    _, first = np.unique(W.mix(h ^ (row.astype(W.U) * W.U(0xC2B2AE3D27D4EB4F))), return_index=True)
    return W.count(row[first], n)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[k]) for k in STATS)], ["doc_id", *STATS])

    return spread(texts(docs)).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


def _covers(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.mask(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, features: tuple[str, ...], cuts: int) -> Test | None:
    """The test with the highest information gain over these rows."""
    p, n = int(bad.sum()), int((~bad).sum())
    if not p or not n:
        return None
    now, best = np.log2(p / (p + n)), (1e-9, None)
    for f in features:
        v = x[f]
        points = np.unique(np.round(np.quantile(v, np.linspace(0, 1, cuts + 1)[:-1]), 6))
        up_p, up_n = (len(a) - np.searchsorted(a, points, "right") for a in (np.sort(v[bad]), np.sort(v[~bad])))
        for above, p1, n1 in ((True, up_p, up_n), (False, p - up_p, n - up_n)):
            gain = p1 * (np.log2(np.maximum(p1, 1e-9) / np.maximum(p1 + n1, 1)) - now)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Test(f, above, float(points[i])))
    return best[1]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, first: Test, most_tests: int, cuts: int) -> list[Test]:
    rule = [first]
    while len(rule) < most_tests:
        m = _covers(rule, x, len(bad))
        more = _best({k: v[m] for k, v in x.items()}, bad[m], tuple(FEATURES), cuts)
        if more is None:
            break
        rule.append(more)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_tests: int = 4, cuts: int = 96, least: int = 5, precision: float = 0.95) -> list[list[Test]]:
    """Ordered rules that mark bad rows; ``fold`` is true for rows that prune.

    Each round grows one rule from the best first test of every feature and keeps, of those precise enough, the one that
    covers the most bad rows.
    """
    rules: list[list[Test]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, v = left & ~fold, left & fold
        grown, found = {k: a[g] for k, a in x.items()}, []

        def worth(r: list[Test]) -> tuple[float, int]:
            m = _covers(r, x, len(bad)) & v
            p, n = int(bad[m].sum()), int((~bad[m]).sum())
            return ((p + 1) / (p + n + 2), -len(r))

        for f in FEATURES:
            if (first := _best(grown, bad[g], (f,), cuts)) is None:
                continue
            rule = _grow(grown, bad[g], first, most_tests, cuts)
            rule = max((rule[:i] for i in range(1, len(rule) + 1)), key=worth)
            m = _covers(rule, x, len(bad)) & left
            p, n = int(bad[m].sum()), int((~bad[m]).sum())
            if p >= least and p / (p + n) >= precision:
                found.append((p - n, -len(rule), f, rule))
        if not found:
            break
        rules.append(max(found, key=lambda r: r[:3])[3])
        left &= ~_covers(rules[-1], x, len(bad))
    return rules


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Test]]:
    """The decision list for labelled rows of ``stats``; ``labels`` has doc_id and quality (1 good, 0 bad)."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.join(marked, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
    # Thin by hash to about twice the bound first, so that partitions do not each send the driver a full sample.
    share = min(1.0, 2 * max_labelled / max(1, rows.count()))
    got = rows.where(F.shiftrightunsigned("h", 34) < int(share * (1 << 30))).orderBy("h", *FEATURES).limit(max_labelled).toPandas()
    bad = got["quality"].to_numpy() == 0
    if not len(got) or bad.all() or not bad.any():
        return []
    return learn({k: got[k].to_numpy() for k in FEATURES}, bad, (got["h"].to_numpy() % 3) == 0)


def verdict(rules: list[list[Test]]) -> Column:
    """The number of the first rule that fits (from 1), else 0, as an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.expr(" AND ".join(t.sql() for t in rule))
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, statistics, base_failed, rule (number of the rule that rejects, else 0) and kept."""
    stats = stored(statistics(docs), "quality")
    rules = fit(stats, labels, max_labelled)
    return stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")

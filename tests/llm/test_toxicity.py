import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import toxicity as T
from tidemill.llm.common import table


def _maximal(scores):
    """Maximal scoring segments by their definition: the best segment (shortest first), then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and j - i < best[2] - best[1])):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    right = [(s, a + j + 1, b + j + 1) for s, a, b in _maximal(scores[j + 1 :])]
    return [*_maximal(scores[:i]), best, *right]


def test_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice([-0.25] * 6 + [0.5, 1.375, 3.0625]) for _ in range(rng.randint(0, 40))]
        place = np.flatnonzero(np.array(scores) > 0)
        got = T.segments(place, np.array(scores)[place])
        want = _maximal(scores)
        assert [(round(s, 9)) for s, _, _ in got] == [round(s, 9) for s, _, _ in want]
        for s, a, b in got:
            assert math.isclose(sum(scores[a : b + 1]), s) and scores[a] > 0 and scores[b] > 0


def test_segments_are_linear():
    n = 300_000
    for value in (np.full(n, 0.5), np.linspace(5, 0.3, n)):
        place = np.arange(n) * 7
        assert len(T.segments(place, value, 0.25)) >= 1


RUDE = ("blargh", "snerf", "glorpish", "glorpen", "glorpo")


def _corpus(n=600, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(RUDE).title() for _ in range(3)]
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, 1, 1 if bad or rng.random() < 0.03 else 0))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, passages string")
    return d, docs, T.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_scores_and_passages_by_brute_force(learned):
    d, docs, model = learned
    value = dict(zip(model.tokens.tolist(), model.value.tolist(), strict=True))

    def hashed(word):
        return int(T.W.hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    got = {r.doc_id: r for r in T.score(d, model).collect()}
    assert len(got) == len(docs)
    for i, text, _, _ in docs:
        words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())]
        scores = [value.get(hashed(w)) or value.get(hashed(w[: T.STEM])) or -T.DRIFT for w in words]
        found = _maximal(scores)
        worth = [model.lam * s - math.log(model.k * len(words)) for s, _, _ in found]
        strong = [w for w in worth if w >= -math.log(T.SIGNIFICANT)]
        x = sum(strong) if strong else max(worth, default=-math.log(model.k * len(words)))
        x = min(T.HIGH, max(T.LOW, x))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-model.curve[0] - model.curve[1] * x)), rel=1e-6)
        assert [(p.first_word, p.last_word) for p in got[i].passages] == [(a, b) for s, a, b in found if model.k * len(words) * math.exp(-model.lam * s) <= T.SIGNIFICANT]


def test_rude_texts_are_found_and_unseen_forms_too(spark, learned):
    _, _, model = learned
    docs, _ = _corpus(300, 9)
    more = [(1000, "a quiet walk by the sea " * 30, "x", "y"), (1001, "a quiet walk " * 40 + "glorpuk glorpino glorpend" + " by the sea" * 3000, "x", "y")]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, score string, passages string")
    got = {r.doc_id: r.score >= 0.5 for r in T.score(d, model).collect()}
    assert sum(got[i] != (i % 5 == 0) for i in range(300)) <= 3
    assert not got[1000] and got[1001]


def test_words_beside_rude_ones_lose_their_evidence(spark):
    """Copies of one text, rude ones among them: only the rude word tells them apart."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(words) + (" blargh" if i % 2 else ""), "") for i in range(60)]
    docs += [(100 + i, " ".join(f"u{rng.randrange(400)}" for _ in range(60)) + (" blargh" if i % 10 == 0 else ""), "") for i in range(400)]
    labels = [(i, 1 if "blargh" in t else 0) for i, t, _ in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score >= 0.5 for r in T.score(d, T.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    assert all(got[i] == bool(t) for i, t in labels)


def test_awkward_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(10, 62)] + [(None, 1), (11, None), (12, 0), (12, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.doc_id in (1, 2, 3)]
    assert len(set(empty)) == 1
    assert T.score(no_docs, model).count() == 0
    assert T.score(docs, T.fit(no_docs, labels)).agg(F.max("score")).first()[0] == 0.0
    assert T.score(docs, T.fit(docs, labels.where("toxic = 0"))).agg(F.max("score")).first()[0] < 0.1
    assert len(T.fit(docs, labels.limit(0)).tokens) == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = T.op11_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.7 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02

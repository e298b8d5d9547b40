import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, place string"


def _brute(rows, anchor, low=(80, 100), k=5):
    """The contract, pair by pair; rows are (id, vector, label)."""
    good = [(i, [int(np.floor(256 * c)) for c in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out, seen = [], set()
    for i, v, l in good:
        if not anchor(i) or (i, l, tuple(v)) in seen:
            continue
        seen.add((i, l, tuple(v)))
        scored = sorted((-dot(v, w), j, m) for j, w, m in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == l][:k]:
            window = [x for x in scored if x[2] != l and -low[0] * s <= -low[1] * x[0] <= -low[1] * s]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(window[:k], 1)]
    return sorted(out)


def _mined(spark, rows, step=10, **more):
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(d, F.col("id") % step == 0, F.col("label"), **more)
    return sorted(map(tuple, got.collect()))


def _rows(n, dim, labels, seed, grain):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(labels, dim))
    x = base[rng.integers(0, labels, n)] * 0.7 + rng.normal(size=(n, dim)) * 0.6 + 0.4
    x = np.round(x * grain) / grain
    return [(i, x[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("grain", "tile_rows", "anchor_rows"), [(1000, 64, 7), (1, 50, 100), (4, 1000, 1000)])
def test_negatives_equal_brute_force(spark, grain, tile_rows, anchor_rows):
    """Fine scores, and coarse ones with many ties at the k-th place, over several tiles of either kind."""
    rows = _rows(300, 6, 4, 3, grain)
    want = _brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and _mined(spark, rows, tile_rows=tile_rows, anchor_rows=anchor_rows) == want


def test_awkward_vectors(spark):
    rng = random.Random(3)
    rows = _rows(80, 4, 3, 5, 2)
    rows += [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf"), 1.0], 0), (204, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]
    rows += [(210, [], 0), (220, [], 1), (230, [2.0], 1), (231, [2.0] * 9, 0)]
    rows += [(240, [1e9, 3.0], 1), (241, [1e9, 2.0], 1), (242, [1e9, 1.0], 0), (243, [-3e30, 1.0], 0), (250, [1e300, 1.0], 2), (251, [1e300], 2), (252, [1e300, 2.0], 0)]
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[10][1], rows[10][2]), (11, rows[11][1], rows[11][2])]
    rng.shuffle(rows)
    assert _mined(spark, rows, tile_rows=40, anchor_rows=6) == _brute(rows, lambda i: i % 10 == 0)


def test_one_label_holds_most_rows_and_all_scores_tie(spark):
    rows = [(i, [1.0, 1.0], 0 if i % 3 else 1) for i in range(3000)]
    got = _mined(spark, rows, step=500, tile_rows=256)
    assert got == _brute(rows, lambda i: i % 500 == 0) and len(got) == 6 * 25


def test_too_few_and_none(spark):
    few = [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1), (3, [0.7], 1), (4, [-1.0], 1)]
    assert _mined(spark, few) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert _mined(spark, [(0, [-1.0], 0), (1, [1.0], 0), (2, [0.5], 1)]) == []
    assert _mined(spark, [(1, [1.0], 0)]) == [] and _mined(spark, few[:1]) == []
    d = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(d, F.col("id") % 10 == 0, F.col("label")).collect() == []


def test_products_of_any_size():
    rng = np.random.default_rng(1)
    for top in (2**7, 2**26, 2**31 - 1):
        a, x = (rng.integers(-top, top, (n, 5)).astype("<i4") for n in (3, 4))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(p) * int(q) for p, q in zip(r, s, strict=True)))) for s in x] for r in a]
        assert negatives.products(a, x, False).tolist() == want

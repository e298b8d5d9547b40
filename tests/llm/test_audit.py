import random
import re
from itertools import permutations

import pytest

from tidemill.llm import audit


def _brute(rows, labels):
    """The contract, row by row."""
    mark = {}
    for i, q, t in labels:
        if i is not None:
            old = mark.get(i, (0, 0))
            mark[i] = (max(old[0], q or 0), max(old[1], t or 0))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        docs.append((source or "", {f for f, bad in fails.items() if bad}, mark.get(i, (0, 0))))
    out = []
    for part in {p for p, _, _ in docs}:
        own = [(f, m) for p, f, m in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        table = []
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                shapley[k] += len(gone)
                failing = [x for x in own if k in x[0]]
                table.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(f == {k} for f, _ in own), sum(m[0] == 1 for _, m in gone), sum(m[1] == 1 for _, m in gone), k])
        out += [(*r[:9], shapley[r[9]]) for r in table]
    return out


def _corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(160):
        text = " ".join(rng.choice(words if i % 3 else words[:20]) for _ in range(rng.choice([10, 49, 50, 90])))
        if i % 4 == 0:
            text = text.upper()
        if i % 5 == 0:
            text += rng.choice(["\u000b#", " $", "\t%", "&", "*", "|x", "\x1c", " ÄÖ"])
        out.append((i, text, rng.choice(["a", "b", "", None])))
    for i in range(160, 260):  # copies in other parts, some rows repeated, some without an id
        j = rng.randrange(40)
        out.append((rng.choice([i, i, j, None]), out[j][1], rng.choice(["a", "b", "c"])))
    out += [(300, None, "n"), (301, "", "n"), (None, None, None), (None, "", None), (302, "x" * 2_000_000, "long"), (303, "ab " * 300_000, "long")]
    rng.shuffle(out)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (None, 1, 1), (9_999, 1, 1)]
    return out, labels


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = _corpus()
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, text string, source string, mask string, n long, cells string").repartition(5)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    return docs, marks, _brute(rows, labels)


def test_audit_equals_brute_force(corpus):
    docs, marks, want = corpus
    got = audit.interactions(audit.cells(docs, marks))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_every_part_has_all_orders(corpus):
    docs, marks, _ = corpus
    got = audit.interactions(audit.cells(docs.where("source = 'long'"), marks.limit(0)))
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0


def test_empty_tables(spark, corpus):
    docs, marks, _ = corpus
    assert audit.interactions(audit.cells(docs.limit(0), marks)).count() == 0


def test_copies_are_counted_before_they_meet(spark):
    """A text that most rows share is a few rows by the time that digests meet."""
    docs = spark.range(0, 20_000, 1, 16).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('the same words again ', 30), CAST(id AS STRING)) AS text", "CAST(id % 2 AS STRING) AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {(r.part, r.mask): r.n for r in audit.cells(docs, labels).collect()}
    assert found[("0", 2)] == 1 and found[("0", 18)] == 3333 and found[("1", 18)] == 3333 and sum(found.values()) == 20_000

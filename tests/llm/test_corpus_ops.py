import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import components, mixing, packing, simjoin, tokens, topk, urlfilter
from tidemill.llm.common import meet, table


def test_shares():
    assert mixing.shares([100, 100], [1, 1], 300, 2) == [150, 150]
    got = mixing.shares([10, 100, 100], [5, 2, 1], 315, 2)
    assert got[0] == 20 and got[1] == 295 * 2 / 3 and sum(got) == pytest.approx(315)
    assert mixing.shares([0, 0], [1, 2], 0, 2) == [0, 0] and mixing.shares([], [], 0, 2) == []


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 12345 + n).tolist()) == list(range(n))


def _plan(sizes, targets, block=32, slots=50, seed=7):
    return mixing.Plan.of(sizes, targets, block, slots, seed, 2)


def test_shards_draw_their_counts():
    plan = _plan([5000, 17, 0, 3000], [9000.0, 30.0, 0.0, 3000.0], 10)
    draws = [plan.drawn(s) for s in range(plan.shards)]
    counts = np.array([np.bincount(src, n, 4) + whole for whole, src, n in draws])
    assert (counts.sum(1)[:-1] == 50).all() and counts.sum() == plan.slots and (counts[:, 2] == 0).all()
    assert np.abs(counts - 50 * plan.share)[:-1].max() < 4 and len({tuple(c) for c in counts.tolist()}) > 1
    many = np.array([np.bincount(*plan.drawn(0)[1:2], plan.drawn(0)[2], 4)])
    assert (many == np.array([np.bincount(*plan.drawn(0)[1:2], plan.drawn(0)[2], 4)])).all()


def _slots(plan):
    """All (shard, source, pass, block) by brute force from the draws."""
    out, used = [], [0] * len(plan.sizes)
    for shard in range(plan.shards):
        whole, src, n = plan.drawn(shard)
        for i, k in enumerate((np.bincount(src, n, len(plan.sizes)).astype(int) + whole).tolist()):
            for j in range(used[i], used[i] + k):
                if j < 2 * plan.blocks[i]:
                    out.append((shard, i, j // plan.blocks[i], int(mixing.permute(np.arange(plan.blocks[i]), int(plan.blocks[i]), plan.seed + i)[j % plan.blocks[i]])))
            used[i] += k
    return sorted(out)


def test_slots_follow_from_the_draws(spark):
    for seed in (7, 8):
        plan = _plan([50_000, 1700, 0, 3000], [40_000.0, 3400.0, 0.0, 1500.0], seed=seed)
        got = mixing.slots(spark, plan).toPandas()
        assert sorted(map(tuple, got[["shard", "src", "pass", "block"]].to_numpy().tolist())) == _slots(plan)
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))


def test_taken_words_by_brute_force(spark, docs):
    """Every slot of every shard, one after another, gives its block; a row is taken as often as blocks with its words are."""
    options = {"block_words": 16, "shard_slots": 64, "seed": 5}
    got = mixing.taken(docs, **options).collect()
    rows = mixing.sized(docs).collect()
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in order]
    targets = mixing.shares(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
    plan = mixing.Plan.of(sizes, targets, 16, 64, 5, 2)
    times = [np.zeros(int(n), np.int64) for n in plan.blocks]
    given = np.zeros(len(sizes), np.int64)
    for shard in range(plan.shards):
        whole, src, n = plan.drawn(shard)
        counts = whole.copy()
        counts[src] += n
        for i in np.flatnonzero(counts):
            _, block = plan.slot_blocks(int(i), given[i] + np.arange(counts[i]))
            np.add.at(times[i], block, 1)
        given += counts
    # Where each row lies in its source's stream is the one thing that is taken over.
    sid = {s: i for i, s in enumerate(order)}
    src = spark.createDataFrame([(r.doc_id, r.h, r["size"], sid[r.source]) for r in rows if r["size"]], "doc_id long, h long, size long, src int")
    want = []
    for r in mixing.placed(src, len(rows)).collect():
        words = sum(int(times[r.src][w // 16]) for w in range(r.start, r.start + r["size"]))
        want.append((r.doc_id, r["size"], words))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r["size"], r.taken) for r in got if r["size"]), key=repr)
    assert all(r.taken == 0 for r in got if not r["size"]) and len(got) == len(rows)


def test_mixing_comes_near_its_targets(spark, docs, sf, no_docs):
    for d in (docs, table(spark, sf, "documents")):
        got = mixing.taken(d, block_words=32).toPandas()
        assert len(got) == d.count() and (got.taken <= 2 * got["size"]).all()
        for _, g in got.groupby("source", dropna=False):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 4 * 32 + 0.02 * g.target.iloc[0] and g["size"].sum() == g.source_size.iloc[0]
        assert got.target.groupby(got.source.fillna("~")).first().sum() == pytest.approx(1.5 * got["size"].sum())
        again = mixing.taken(d.repartition(5), block_words=32).toPandas()
        key = ["doc_id", "size", "taken", "shard"]
        assert sorted(map(str, again[key].to_numpy().tolist())) == sorted(map(str, got[key].to_numpy().tolist()))
    assert mixing.taken(no_docs).count() == 0


def test_seed_and_shards_change_the_mix(spark, sf):
    d = table(spark, sf, "documents")
    first = mixing.taken(d, block_words=32).toPandas().set_index("doc_id").taken
    for options in ({"seed": 5}, {"shard_slots": 64}):
        other = mixing.taken(d, block_words=32, **options).toPandas().set_index("doc_id").taken
        assert (other.sort_index() != first.sort_index()).any()


def test_mixed_texts(docs):
    unique = docs.dropDuplicates(["doc_id", "text"])
    assert unique.where("doc_id IS NULL").count() == 1
    want = {r.doc_id: r.taken for r in mixing.taken(unique).collect()}
    got = defaultdict(list)
    for r in mixing.mixed(unique).collect():
        got[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text) and r.sid == "clash"
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert len(want) > 30 and sum(want.values()) > 0
    for doc, n in want.items():
        assert sum(len(t.split()) for t in got[doc]) == n
        assert all(t in texts[doc] for t in got[doc])


def _check_packing(d, got, window):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    want = Counter()
    for r in d.collect():
        want[r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])] += 1
    have = Counter()
    pieces = defaultdict(list)
    for r in got:
        ids = tuple(np.frombuffer(r.ids, "<u4").tolist())
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, ids))
    for (doc, ids), n in want.items():
        for _ in range(n):
            at = 0
            while at < len(ids):
                p = next(p for p in sorted(pieces[doc]) if p[0] == at and p[2] == len(ids) and p[3] == ids[at : at + p[1]])
                pieces[doc].remove(p)
                at += p[1]
            have[doc, ids] += 1
    assert have == want and not any(pieces.values())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize(("window", "shard", "part"), [(4096, 1_000_000, 8_000_000), (64, 1000, 4000), (64, 200, 500)])
def test_packing_round_trip(docs, window, shard, part):
    _check_packing(docs, packing.pack(docs, window=window, shard_tokens=shard, part_tokens=part).collect(), window)


def test_packing_of_nothing_and_of_empty_texts(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    d = spark.createDataFrame([(i % 7 or None, "") for i in range(100)] + [(1, None)], "doc_id long, text string")
    _check_packing(d, packing.pack(d, window=8, shard_tokens=8, part_tokens=16).collect(), 8)
    with pytest.raises(ValueError, match="16 bits"):
        packing.pack(d, end_id=70_000)


def test_packing_takes_neighbours(spark):
    words = ["cat", "dog", "sun", "car", "red", "one", "two", "man", "sea", "ice"]
    d = spark.createDataFrame([(i, " ".join([words[i % 10]] * 30)) for i in range(40)], "doc_id long, text string")
    for part in (1_000_000, 400):  # one partition, and several with rounds behind them
        got = packing.pack(d, window=62, shard_tokens=130, part_tokens=part).toPandas()
        assert got.length.sum() == 40 * 31
        full = got.groupby("sequence_id").filter(lambda g: g.length.sum() == 62)
        same = full.assign(word=full.doc_id % 10).groupby("sequence_id").word.nunique()
        assert (same == 1).mean() > 0.6


def test_scores_equal_brute_force_bm25(spark, sf):
    d = table(spark, sf, "documents")
    tokens_ = packing.tokenised(d)
    rows = [r for r in tokens_.where("row IS NOT NULL").collect() if r.n % 4096]
    ids = [np.frombuffer(bytes(r.ids), "<u2")[r.n // 4096 * 4096 :] for r in rows]
    every = [np.unique(np.frombuffer(bytes(r.ids), "<u2")) for r in rows]
    df = packing.frequencies(tokens_)
    assert (df == np.bincount(np.concatenate(every), minlength=len(df))).all()
    idf, mean = np.log1p((len(rows) - df + 0.5) / (df + 0.5)), 300.0
    weights = np.zeros((len(ids), len(df)))
    for i, x in enumerate(ids):
        t, c = np.unique(x, return_counts=True)
        weights[i, t] = idf[t] * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
    want = np.array([weights[:, np.unique(x)].sum(1) for x in ids])
    shard = packing.Shard(ids, idf, mean)
    got = np.array([shard.scores(i) for i in range(len(ids))])
    assert got == pytest.approx(want, rel=1e-4, abs=1e-3)
    # The first window holds the first piece and then those of the highest scores that fit.
    full, left = packing.windows([len(x) for x in ids], shard.scores, 4096)
    order = [0, *(p for p in np.argsort(-got[0], kind="stable").tolist() if p)]
    assert [p for p, _, _ in full[0]] == order[: len(full[0])]
    assert sum(n for w in full for _, _, n in w) + sum(n for _, _, n in left) == sum(map(len, ids))


def test_routes_bring_near_copies_together():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 49_000, 300) for _ in range(2000)]
    pieces = []
    for x in base:
        y = x.copy()
        y[rng.integers(0, 300, 8)] = 7
        pieces += [x, y]
    off = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    route = packing.routes(np.concatenate(pieces), off)
    place = np.argsort(np.argsort(route, kind="stable"))
    # Pairs share about 0.9 of their id pairs, so about as many agree in the first min-hash.
    assert (np.abs(place[::2] - place[1::2]) < 20).mean() > 0.85
    assert (packing.routes(np.array([5, 5]), np.array([0, 1, 2]))[:1] == packing.routes(np.array([5]), np.array([0, 1]))).all()


def test_url_filter(spark, sf):
    rules = [*urlfilter.RULES, ("block", "a.org", "/x"), ("allow", "net", "")]
    urls = ["https://Blog.Example.ORG/en/12?x#y", "http://example.org", "http://example.org?q=/es/", "example.org/es/", None, "ftp://q.com/de/1", "http://notexample.org/es/1", "x://a.org/xy://z", "http://y.net", "http://.com/fr/", "http://net/", "://example.org/es/", ""]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host = rest[:end].lower()
            path = rest[end:]
            path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(d, rules).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(d.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(d, [], default="block").collect()} == {"block"}


def test_digests_confirm_strings(tmp_path):
    urlfilter.write_rules([("allow", f"h{i}.org", "/") for i in range(1000)], tmp_path / "r")
    d = urlfilter.Digests(str(tmp_path / "r"))
    keys = np.array([d.keys[5], d.keys[5]])
    name = d.blob[int(d.offsets[5]) : int(d.offsets[6])].tobytes().decode()
    assert d.probe([name, "other string with that key"], keys).tolist() == [1, -1]
    with pytest.raises(ValueError):
        urlfilter.write_rules([("allow", "a", "/"), ("allow", "b", "/")], tmp_path / "q", max_rules=1)


def _topk(rows, k):
    v = {}
    out = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) and np.isfinite(256 * c) for c in x):
            v.setdefault(i, []).append([int(np.floor(256 * c)) for c in x])
    for q in sorted(v):
        if q % 50 == 0:
            for query in {tuple(x) for x in v[q]}:
                best = sorted((-sum(a * b for a, b in zip(x, query, strict=False)), i) for i, xs in v.items() if i != q for x in xs)[:k]
                out += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).round(2 if i % 2 else 6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(350, [0.5, -1.0]), (351, None), (352, []), (353, [1.0, None]), (354, [float("nan")] * 8), (355, [float("inf")] * 8), (356, [1e300] * 8), (357, [1e6, 0.0]), (358, [-1e6] * 8), (359, [1.7e308] * 8), (360, [3e5] * 8), (500, [1e7] * 3), (550, [-1e7, 2e6]), (361, [1e9, 1e-3]), (400, [0.0] * 8), (600, []), (None, [1.0] * 8), (7, rows[7][1]), (450, [30.0, -2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = _topk(rows, 5)
    for block in (16_384, 40):
        got = topk.search(d, F.col("id") % 50 == 0, block_rows=block, sent_bytes=200)
        assert sorted(map(tuple, got.collect())) == want
    alone = spark.createDataFrame([(50, [1.0, 1.0]), (1, [1e6, 0.0]), (2, [1.0, 1.0])], d.schema)
    assert tuple(topk.search(alone, F.col("id") % 50 == 0).first()) == (50, 1, 1, 65_536_000_000)
    clash = d.selectExpr("vec_id", "embedding", "1 AS id", "2 AS v", "3 AS wide", "4 AS score", "5 AS rank")
    assert sorted(map(tuple, topk.search(clash, F.col("id") % 50 == 0).collect())) == want
    few = topk.search(d.where("vec_id IN (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert len(few) == 2
    assert topk.search(d.limit(0), F.col("id") % 50 == 0).count() == 0


def test_filter_takes_clashing_columns_and_long_hosts(spark):
    d = spark.createDataFrame([(1, "http://a.b.example.org/es/x", "x"), (2, "x://" + "a." * 100_000 + "org/q", "y")], "page_id long, url string, host string")
    d = d.selectExpr("*", "1 AS path", "2 AS rule", "3 AS verdict", "4 AS html")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(d, urlfilter.RULES).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("org/", "allow")}
    assert urlfilter.judge(d, []).where("verdict = 'allow' AND rule IS NULL").count() == 2


def test_join_finds_links_of_every_band(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {}
    for r in d.select("doc_id", "text").collect():
        w = (r.text or "").split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    ids, having = sorted(sets), defaultdict(set)
    for i in ids:
        for g in sets[i]:
            having[g].add(i)
    got = {r.doc_id: r.class_id for r in simjoin.classes(d).collect()}
    bands = defaultdict(list)
    for i in ids:
        for j in {j for g in sets[i] for j in having[g] if j > i}:
            both = len(sets[i] & sets[j])
            similarity = both / (len(sets[i]) + len(sets[j]) - both)
            if 0.8 <= similarity < 1:
                bands[min(int(similarity * 20), 19)].append(got[i] == got[j])
    assert sum(map(len, bands.values())) > 10
    assert all(np.mean(found) >= 0.97 for found in bands.values())
    print({b / 20: (len(found), float(np.mean(found))) for b, found in sorted(bands.items())})
    assert simjoin.recall_of(simjoin.runs_for(0.99, 4, 0.8), 4, 0.8) >= 0.99
    assert simjoin.recall_of(6, 4, 0.8, 0.9) > 0.999


def test_large_groups_are_cut_by_shingles(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"e{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, simjoin.classes(d).collect()))
    assert {r[1] for r in want} == {0} and {r[2] for r in want} == {59}
    monkeypatch.setattr(simjoin, "BLOCK_SHINGLES", 3000)
    assert sorted(map(tuple, simjoin.classes(d, bucket=16, block=512).collect())) == want


def test_hot_keys_meet_in_shares(spark):
    left = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = meet(left, right, "k", "n", "id", 5000, most=100)
    assert got.count() == 5000 and got.where("k = 7").agg(F.min("n")).first()[0] == left.where("k = 7").count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want


def _brute_join(rows, similarity=0.8):
    sets = []
    for doc, text in rows:
        w = (text or "").split()
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None))
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= similarity * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(n):
        group[find(i)].append(i)
    out = []
    for g in group.values():
        first = min((sets[i][0] for i in g if sets[i][0] is not None), default=None)
        out += [(sets[i][0], first, links[i]) for i in g]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket": 3, "depth": 2, "block": 4}])
def test_join_equals_brute_force(spark, docs, rows, options):
    got = simjoin.classes(docs, **options).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == _brute_join([(r[0], r[1]) for r in rows])


def test_join_real_documents(spark, sf, no_docs):
    d = table(spark, sf, "documents")
    got = simjoin.classes(d).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == _brute_join([(r.doc_id, r.text) for r in d.collect()])
    assert simjoin.classes(no_docs).count() == 0


def test_survival_gives_recall():
    runs = simjoin.runs_for(0.99, 4, 0.8)
    assert 1 - (1 - simjoin.survival(4, 0.8)) ** runs >= 0.99 > 1 - (1 - simjoin.survival(4, 0.8)) ** (runs - 1)

import hashlib
import re
import sys
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import langid, licenses, pii, quality, tokens
from tidemill.llm.common import table


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def real(spark, sf):
    return table(spark, sf, "documents")


# personal data


def _base_spans(text):
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def _digest(spans):
    return ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in spans[k])


def test_pii_equals_patterns(spark, docs, real):
    for d in (docs, real):
        want = []
        for r in d.select("doc_id", "text").collect():
            s = _base_spans(r.text or "")
            want.append((r.doc_id, *(len(s[k]) for k in pii.BASE), hashlib.sha256(_digest(s).encode()).hexdigest()))
        got = pii.scan(d).drop("spans", "redacted").collect()
        assert _sorted(got) == _sorted(want)


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e x@y z@q.r.", "1.2.3.4.5.6.7.8 1..2.3.4.5 999.1.1.1.2.3.4 01.002.3.0255", "+1+12 34 567 89-", "+1 ) 2345678 +(1)", "4111-1111 1111-1111 1 4 2", "1 2 3 4  5", "@@.@a.b a@.b a@b..c", "+1234567890123456 +1 2", "é@ü.de ßa@b.co", "0000000000001.1.1.1", "1.2.3.4.", "12345678901234567890123"],
)
def test_pii_corner_cases(text):
    found = pii.find(text, pii.anchors())
    want = _base_spans(text)
    assert {k: found[k] for k in pii.BASE} == want


def test_pii_random_strings():
    rng = np.random.default_rng(3)
    automaton = pii.anchors()
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789..@+- ()aZ-%"), rng.integers(0, 40)))
        found = pii.find(text, automaton)
        assert {k: found[k] for k in pii.BASE} == _base_spans(text), text


def test_pii_own_kinds_and_redaction(docs):
    text = "see ftp://joe:secret@host.org, SSN: 123-45-6789 and IBAN DE89370400440532013000, account number 12345678; plain 4 words"
    found = pii.find(text, pii.anchors())
    assert [text[s:e] for k in ("userinfo", "ssn", "iban", "account") for s, e in found[k]] == ["joe:secret", "123-45-6789", "DE89370400440532013000", "12345678"]
    clean = pii.redact(text, found)
    assert "6789" not in clean and "secret" not in clean and "plain 4 words" in clean
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text is None and out[5].text.count("[") == 4 and out[5].n_chars == len(out[5].text) and out[5].sid == "clash"


def test_pii_cues_of_any_case_and_long_userinfo():
    token = "t" * 100
    text = f"İ Social Security Number: 123-45-6789 https://{token}:{token}@host.org"
    found = pii.find(text, pii.anchors())
    assert [text[s:e] for k in ("userinfo", "ssn") for s, e in found[k]] == [f"{token}:{token}", "123-45-6789"]


@pytest.mark.parametrize("run", ["mailto:", "a@", "+1(", "1.", "12 ", "token=", "token ", "://a:", "ssn ", "account ", "a.b@c.", 'api key="a1b2c3d4e5f6g7h8" '])
def test_scan_time_is_linear(run):
    automaton = pii.anchors()
    began = time.time()
    pii.redact(text := (run * 1_000_000)[:1_000_000], pii.find(text, automaton))
    assert time.time() - began < 15


def test_secrets_and_overlapping_addresses():
    automaton = pii.anchors()
    text = 'token = "cf1d64a9a4cd9723e1f4" tokens are fine, password: hunter mailto:mailto:q@r.s API_KEY=abcdEFGH12345678 Social Security number: 123-45-6789'
    found = pii.find(text, automaton)
    cut = {k: [text[s:e] for s, e in v] for k, v in found.items() if v}
    assert cut == {"email": ["q@r.s"], "secret": ["cf1d64a9a4cd9723e1f4", "abcdEFGH12345678"], "mailto": ["mailto:q@r.s"], "ssn": ["123-45-6789"]}


def test_secrets_of_any_length(spark):
    automaton = pii.anchors()
    for n in (16, 512, 513, 1200, 1_000_000):
        key = ("aB3" * n)[:n]
        for text in (f"Bearer {key}", f'x api_key="{key}", rest', f"token: {key}\nmore words"):
            found = pii.find(text, automaton)
            assert [text[a:b] for a, b in found["secret"]] == [key]
            assert key[:16] not in pii.redact(text, found)
    d = spark.createDataFrame([(1, "Bearer " + "aB3" * 400, 1)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redacted(d).collect()] == [(1, "Bearer [SECRET]", 15)]


def test_scan_of_nothing_and_clashing_columns(spark, no_docs, docs):
    assert pii.scan(no_docs).count() == 0 and pii.redacted(no_docs).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("spans"), F.lit(2).alias("n_email"), F.lit(3).alias("redacted"))
    assert _sorted(pii.scan(clash).collect()) == _sorted(pii.scan(docs).collect())


# tokens


def test_token_counts_equal_the_library(docs, real, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for d in (docs, real):
        want = []
        for r in d.select("doc_id", "text").collect():
            n = len(t.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        assert _sorted(tokens.count(d).drop("resynchronised").collect()) == _sorted(want)
        assert _sorted(tokens.count(d, huge=50, chunk=64, overlap=4).drop("resynchronised").collect()) == _sorted(want)
    assert tokens.count(no_docs).count() == 0


def test_encoder_ids_equal_the_library():
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    texts = ["Don't STOP, we'll 've go!! (now)... x's", "ÀÉÎõü ß ñandú ǅ ﬁ e\u0301\u0301 Å", "a\u0301b ab\u0301, c.\u0301 d", "<|startoftext|>x<|endoftext|> y<|endoftext|>", "日本語 テスト。 १२३ x²", "", "  ", "a\x1cb\x85c\u2028d", "Ünïcödé, ÜBER; straße: größe? ×÷", "x" * 300 + ", " + "é" * 100]
    e = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), max_bytes=900)
    got = [x.tolist() for x in e.ids(pa.array(texts))]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_resync_widens_and_joins():
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    encode = tokens.encode_with_offsets(t)
    rng = np.random.default_rng(1)
    for text in ["a" * 3000, "word " * 500, "x" * 500 + " y" * 300 + "z" * 900 + " end of it", "".join(rng.choice(list("ab c'sé.1 "), 4000))]:
        want = t.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((40, 3), (200, 20), (1000, 100)):
            assert [i for run in tokens.resync(text, encode, chunk, overlap) for i in run] == want


def test_word_table_is_bounded_by_bytes():
    rng = np.random.default_rng(2)
    e = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), max_bytes=1 << 20)
    runs = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000))) for _ in range(40)]  # words without blanks
    words = [" ".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(20_000))]
    e.counts(pa.array(runs + words))
    assert all(len(w) <= tokens.LONGEST for w in e.known) and e.bytes <= 1 << 20
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in e.known.items()) <= 1 << 20


def test_long_texts_without_blanks(spark):
    text = "\u4e2d\u6587" * 20_000 + "x" * 100_000
    got = tokens.count(spark.createDataFrame([(1, text), (2, "a" * 1_000_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    assert got[0].n_tokens == len(t.encode(text, add_special_tokens=False).ids) and got[0].resynchronised
    assert got[1].n_bytes == 1_000_000 and got[1].resynchronised and got[1].over_limit


def test_resynchronisation_serves_rows_of_the_corpus(spark):
    d = tokens.count(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert d.where("resynchronised").count() > 0


# quality


def _stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, t in enumerate(tri):
        if tri.count(t) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_statistics(spark, docs, real, no_docs):
    awkward = spark.createDataFrame([(1, "a b c a b c a\na b\na b\n \n \n\na b"), (2, "x # é& ñ\n\n"), (3, None), (3, None)], "doc_id long, text string")
    for d in (awkward, docs.where("doc_id <> 40 OR doc_id IS NULL"), real.where("n_chars < 4000")):
        want = [(r.doc_id, *_stats(r.text)) for r in d.select("doc_id", "text").collect()]
        got = quality.statistics(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert _sorted(got) == _sorted(want)
    assert quality.statistics(no_docs).count() == 0


def test_quality_learns_and_keeps(spark, sf):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = quality.judge(docs, labels)
    got = out.join(labels, "doc_id").toPandas()
    bad, dropped = got.quality == 0, ~got.kept
    assert (dropped & bad).sum() >= 0.85 * bad.sum()
    clean = ~bad & ~got.base_failed
    assert got.kept[clean].mean() > 0.98
    assert ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)).equals(got.base_failed)


def test_quality_thins_by_matched_labels(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    stats = quality.statistics(table(spark, "/root/testdata/sf0.01", "documents")).cache()
    more = spark.range(10**7, 10**7 + 100_000).selectExpr("id AS doc_id", "1 AS quality")
    want = quality.fit(stats, labels, 200)
    assert want and quality.fit(stats, labels.unionByName(more), 200) == want


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, none)
    assert out.count() == docs.count() and out.where("kept = base_failed").count() == 0


def test_doubled_and_null_labels(spark, no_docs):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    more = labels.select("doc_id", F.lit(0).alias("quality"), "toxic").union(spark.createDataFrame([(1, None, 0), (None, 0, 0), (10**9, 0, 1)], labels.schema))
    # Of several labels the largest counts, so a second 0 for each document changes nothing; nor do nulls and unknown ids.
    names = ("doc_id", "base_failed", "kept", "rule")
    assert _sorted(quality.judge(d, labels.union(more)).select(*names).collect()) == _sorted(quality.judge(d, labels).select(*names).collect())
    assert quality.judge(no_docs, labels).count() == 0
    bare = quality.judge(d, labels.limit(0))
    assert bare.where("kept = base_failed").count() == 0 and bare.where("rule > 0").count() == 0


# licenses


def _license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark, docs, real, no_docs):
    more = spark.createDataFrame([(1, "cc by cc by all rights reserved"), (1, "cc by"), (2, "CC-BY the general public license general public license all rights x reserved"), (3, "by cc"), (4, "cc"), (4, None)], "doc_id long, text string")
    for d in (more, docs, real):
        want = [(r.doc_id, *_license(r.text)) for r in d.select("doc_id", "text").collect()]
        got = licenses.scan(d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        assert _sorted(got) == _sorted(want)
    assert licenses.scan(no_docs).count() == 0


def _chain(hits):
    """The longest chain of (place in the text, place in the template), rising in both."""
    best = []
    for p, q in sorted(hits, key=lambda h: (h[1], h[0])):
        best.append((1 + max((n for n, a, b in best if a < p and b < q), default=0), p, q))
    return max((n for n, _, _ in best), default=0)


def _license_labels(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES):
    """(labels, score) by alignment: of all stretches of the text that are near a diagonal the one with the longest chain of equal windows."""
    low = (text or "").translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, score = set(), 0.0
    for t, (words, label) in enumerate((*phrases, *templates)):
        v, places = words.split(), {}
        for q in range(len(v) - 1):
            places.setdefault(tuple(v[q : q + 2]), []).append(q)
        hits = [(p, q) for p in range(len(w) - 1) for q in places.get(tuple(w[p : p + 2]), ())]
        if t < len(phrases):
            share = float(any(w[p : p + len(v)] == v for p in range(len(w))))
        else:
            starts = sorted({p - q for p, q in hits})
            share = max((_chain([(p, q) for p, q in hits if d <= p - q <= d + licenses.SLACK]) for d in starts), default=0) / (len(v) - 1)
            share = share if share >= licenses.MIN_SHARE else 0.0
        if share:
            labels.add(label)
            score = max(score, share)
    return ",".join(sorted(labels)), score


def test_license_windows_out_of_order(spark):
    """A template's windows backward, shuffled, apart or mixed with another's give no label; the template does, with words put in or left out."""
    rng = np.random.default_rng(3)
    plain = [t for t in licenses.TEMPLATES if len(t[0].split()) > 8]
    bad, good = [], []
    for words, label in plain:
        v = words.split()
        windows = [" ".join(v[i : i + 2]) for i in range(len(v) - 1)]
        bad += [" ".join(windows[::-1]), " ".join(f"{x} and" for x in windows)]
        bad += [" ".join(rng.permutation(windows)) for _ in range(5)]
        other = plain[(plain.index((words, label)) + 1) % len(plain)][0].split()
        bad.append(" ".join(x for p in zip(windows, [" ".join(other[i : i + 2]) for i in range(len(other) - 1)]) for x in p))
        for at in (4, 7):
            good += [(label, " ".join(v[:at] + ["really"] + v[at:])), (label, " ".join(v[:at] + v[at + 1 :])), (label, words), (label, " ".join(windows[::-1]) + " so " + words)]
    made = spark.createDataFrame(list(enumerate(bad + [x for _, x in good])), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(made).collect()}
    assert all(got[i].labels == "" and got[i].score == 0 for i in range(len(bad)))
    for i, (label, text) in enumerate(good, len(bad)):
        assert label in got[i].labels.split(",") and got[i].score >= licenses.MIN_SHARE
        size = len(dict((b, a) for a, b in licenses.TEMPLATES)[label].split())
        assert all(x.hi - x.lo <= size + licenses.SLACK for x in got[i].spans if x.label == label)


def test_license_labels_equal_brute_force(spark, docs, real):
    rng = np.random.default_rng(6)
    texts = ["of charge " * 15, "the terms of " * 15, "Permission is hereby granted, free of charge, " * 3, "ÄCC BY all rights reserved", "redistribution and use in source and in binary forms with or without modification are " * 2]
    for words, _ in licenses.TEMPLATES:
        for _ in range(6):
            v = words.split()
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(v)))
                v[at : at + int(rng.integers(0, 2))] = ["and"] * int(rng.integers(0, 3))
            texts.append("x " + " ".join(v) + " y " + " ".join(v[: len(v) // 2]))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for d in (made, docs, real):
        want = [(r.doc_id, *_license_labels(r.text)) for r in d.select("doc_id", "text").collect()]
        assert _sorted(licenses.scan(d).select("doc_id", "labels", "score").collect()) == _sorted(want)
        found += sum(1 for _, labels, _ in want if labels)
    assert found > 30
    got = {r.doc_id: r.labels for r in licenses.scan(made).collect()}
    assert got[0] == got[1] == ""


def test_long_templates_take_several_marks(spark):
    v = [f"w{i}" for i in range(150)]
    d = spark.createDataFrame([(1, " ".join(v)), (2, " ".join(v[:100])), (3, " ".join(v[:120]))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in licenses.scan(d, phrases=(), templates=((" ".join(v), "long"),)).collect()}
    assert got == {1: ("long", 1.0), 2: ("", 0.0), 3: ("long", round(119 / 149, 6))}


def test_license_spans_merge(spark):
    d = spark.createDataFrame([(1, "x licensed under the really apache license version 2 0 y"), (2, "licensed under the sun")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert got[1].labels == "apache-2.0" and 0.7 < got[1].score < 1 and [(x.lo, x.hi) for x in got[1].spans] == [(1, 9)]
    assert got[2].labels == "" and got[2].score == 0.0


# language


def test_language_forward_equals_enumeration():
    pieces = langid.pieces_of(langid.VOCABULARY)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(langid.VOCABULARY))
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    rng = np.random.default_rng(2)
    p = rng.random((pieces.size, 2)) * 0.01

    def brute(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(s) + 1):
            q = p[ids[s[:k]]] if s[:k] in ids else np.full(2, langid.UNKNOWN) if k == 1 else None
            if q is not None:
                total = total + q * brute(s[k:])
        return total

    words = ["the", "straße", "a", "ñandú", "zzqx", "日本"]
    got = langid.Lattice(words, pieces).score(p, len(words))
    for w, g in zip(words, got, strict=True):
        assert np.allclose(g, np.log(brute("▁" + w)))
    # expected counts are the derivative of the log probability
    n = langid.Lattice(["the"], pieces).expected(p[:, 0], np.array([[2.0]]))
    i = ids["▁the"]
    assert np.isclose(n[i, 0], 2 * p[i, 0] / brute("▁the")[0])


def test_long_words_are_summed_over_all_segmentations():
    pieces = langid.pieces_of(langid.VOCABULARY)
    rng = np.random.default_rng(4)
    p = rng.random((pieces.size, 3)) * 0.01
    words = ["".join(rng.choice(list("theandofßñ日x"), n)) for n in (1, 5, 12, 31, 32)]
    weight = rng.integers(0, 3, (len(words), 3)).astype(float)
    short, long = langid.Lattice(words, pieces), langid.LongWords(words, pieces)
    assert np.allclose(short.score(p, 5), long.score(p, 5))
    assert np.allclose(short.expected(p[:, 0], weight), long.expected(p[:, 0], weight))
    # A long run by the plain sum over all pieces at each place, in logarithms.
    run = "".join(rng.choice(list("theandof"), 700))
    ids = [pieces.find(np.array([langid.Pieces.key(np.array([ord(c) for c in x], np.uint64))]))[0] for x in (("▁" + run)[:1],)]
    assert ids[0] >= 0
    text, alpha = "▁" + run, [np.zeros(3)]
    for j in range(1, len(text) + 1):
        terms = []
        for k in range(1, min(j, pieces.longest) + 1):
            i = pieces.find(np.array([langid.Pieces.key(np.array([ord(c) for c in text[j - k : j]], np.uint64))]))[0]
            if i >= 0:
                terms.append(alpha[j - k] + np.log(p[i]))
            elif k == 1:
                terms.append(alpha[j - 1] + np.log(langid.UNKNOWN))
        alpha.append(np.logaddexp.reduce(terms, axis=0))
    assert np.allclose(langid.LongWords([run, "b" * 40], pieces).score(p, 2)[0], alpha[-1])


def _forward(word, p, pieces):
    """log probability of a word in each language, by the plain sum over all pieces at each place, in logarithms."""
    text, alpha = "▁" + word, [np.zeros(p.shape[1])]
    for j in range(1, len(text) + 1):
        terms = []
        for k in range(1, min(j, pieces.longest) + 1):
            i = pieces.find(np.array([langid.Pieces.key(np.array([ord(c) for c in text[j - k : j]], np.uint64))]))[0]
            if i >= 0:
                terms.append(alpha[j - k] + np.log(p[i]))
            elif k == 1:
                terms.append(alpha[j - 1] + np.log(langid.UNKNOWN))
        alpha.append(np.logaddexp.reduce(terms, axis=0))
    return alpha[-1]


def test_long_words_of_several_languages(spark):
    """A text of long words of different languages, each far likelier in its own: every score is a number, and right."""
    docs = langid.fold(table(spark, "/root/testdata/sf0.01", "documents"))
    model = langid.train(docs.where("NOT held_out"))
    pieces = langid.pieces_of(model.vocabulary)
    own = {r.lang: r.t for r in docs.where("n_chars > 500").groupBy("lang").agg(F.array_join(F.collect_list("text"), " ").alias("t")).collect()}
    own = {k: re.sub(r"[^a-zäöüßéèñó]", "", v.lower()) for k, v in own.items()}
    texts, want = [], []
    for n in (300, 800, 4000):
        for langs in (("fr", "de"), ("de", "es", "fr"), ("es", "en")):
            words = [own[x][: n + 37 * i] for i, x in enumerate(langs)]
            texts.append(" ".join(words))
            if n < 4000:
                total = sum(_forward(w, model.p, pieces) for w in words)
                assert np.allclose(sum(langid.LongWords([w], pieces).score(model.p, 1)[0] for w in words), total)
                want.append(model.langs[int(total.argmax())])
            else:
                want.append(None)
    texts += [" ".join(own[x][:10_000] for x in ("fr", "de", "es")), "日" * 3000 + " " + "ж" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    assert all(0 <= r.score <= 1 and r.lang_pred in model.langs for r in got.values())
    assert all(got[i].lang_pred == w for i, w in enumerate(want) if w)
    kept = {r.doc_id for r in langid.identified(d, model).collect()}
    assert kept == {i for i, r in got.items() if r.score >= 0.5} and len(kept) >= len(texts) - 1


def test_texts_without_blanks_have_a_language(spark):
    rng = np.random.default_rng(5)
    letters = {"x": "abcdefgh", "y": "stuvwxyz"}
    rows = [(i, "".join(rng.choice(list(letters["xy"[i % 2]]), 200 + 3000 * (i == 38))), "xy"[i % 2]) for i in range(40)]
    rows.append((40, "ab" * 50_000, "x"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, langid.train(d.where("doc_id < 30"))).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_language_accuracy_and_edges(spark, docs, no_docs):
    d = langid.fold(table(spark, "/root/testdata/sf0.01", "documents"))
    model = langid.train(d.where("NOT held_out"))
    got = langid.predict(d, model).join(d, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 8))
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert {r.doc_id for r in langid.identified(docs, model).collect()}.isdisjoint({1, 2, 3, 8})


def test_many_languages_stay_within_bounds(spark):
    rng = np.random.default_rng(3)
    langs = [f"l{i:03}" for i in range(200)]
    stems = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)] for x in langs}
    rows = [(i, " ".join(rng.choice(stems[langs[i % 200]], 30)), langs[i % 200]) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d.where("doc_id < 800"))
    assert len(model.langs) == 200
    tracemalloc.start()
    labels, _ = langid._judge(pa.array([r[1] for r in rows[800:]] * 20), model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * langid.TABLE_BYTES
    assert np.mean([x == r[2] for x, r in zip(labels, rows[800:], strict=False)]) > 0.9
    with pytest.raises(ValueError, match="more than 100"):
        langid.train(d, max_langs=100)


def test_null_ids_are_held_out(spark):
    d = langid.fold(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert d[0].held_out is True and d[1].held_out is not None

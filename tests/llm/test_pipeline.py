"""The stages of the pipeline against brute force, on the awkward documents and on clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_corpus_ops import _brute_join

pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("h", "id", "key", "whole", "parts", "part", "first", "class_id", "n")


@pytest.fixture(scope="module")
def clashing(docs):
    out = docs
    for c in CLASHES:
        out = out.withColumn(c, docs["label"])
    return out.cache()


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]


def test_language_keeps_rows_as_they_are(spark, clashing):
    got = pipeline.language(spark, clashing, "")
    assert got.schema == clashing.schema
    kept, all_rows = Counter(map(tuple, got.collect())), Counter(map(tuple, clashing.collect()))
    assert kept and kept <= all_rows
    assert not any(r["text"] is None or not re.search(r"[^\W\d_]", r["text"]) for r in got.collect())


def test_near_duplicates_keep_one_of_each_group(spark, clashing, rows):
    got = pipeline.near_duplicates(spark, clashing, "")
    assert got.columns == clashing.columns
    ids = [r["doc_id"] for r in got.collect()]
    numbered = [(r[0], r[1]) for r in rows if r[0] is not None]
    assert sorted(x for x in ids if x is not None) == sorted({k for k, c, _ in _brute_join(numbered) if k == c})
    assert ids.count(None) == 1
    assert all(r[c] == "clash" for r in got.collect() for c in CLASHES)


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    rows = [(1, "first text of one id"), (1, "quite another text of that id"), (1, "first text of one id"), (42, "text of the real document"), (None, None)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(set(rows), key=repr)


def test_mix_cuts_whole_words(spark, clashing):
    texts = {}
    for r in clashing.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = pipeline.mix(spark, clashing, "")
    assert got.columns == clashing.columns
    seen = got.collect()
    assert any(r["doc_id"] is None for r in seen)
    for r in seen:
        assert any(t is not None and r["text"] in t for t in texts[r["doc_id"]])
        assert WORD.search(r["text"]) and r["n_chars"] == len(r["text"]) and r["label"] == r["h"] == "clash"


def test_pack_is_gapless(spark, docs):
    got = pipeline.pack(spark, docs, "").collect()
    by = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and np.frombuffer(r["ids"], "<u4").size == r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_stages_on_no_rows(spark, no_docs):
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, no_docs, "")
        assert got.columns == no_docs.columns and got.count() == 0
    assert pipeline.pack(spark, no_docs, "").count() == 0

import io
import json
import os
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill.sources import archive, readers, result_sink


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The pages of the table as files: some in folders, some in archives, some loose."""
    at = tmp_path_factory.mktemp("pages")
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    for d in ("a", "b/deep"):
        os.makedirs(at / d)
    with zipfile.ZipFile(at / "z.zip", "w") as z, tarfile.open(at / "b" / "t.tar.gz", "w:gz") as t:
        for i, html in pages:
            name = f"page_{i}.pdf"
            if i % 5 == 0:
                (at / "a" / name).write_bytes(html)
            elif i % 5 == 1:
                (at / "b" / "deep" / name).write_bytes(html)
            elif i % 5 == 2:
                z.writestr(f"inner/{name}", html)
            elif i % 5 == 3:
                m = tarfile.TarInfo(name)
                m.size = len(html)
                t.addfile(m, io.BytesIO(html))
            else:
                (at / name).write_bytes(html)
        z.writestr("empty_900.pdf", b"")
    for d in ("a", "."):
        (at / d / f"{d.strip('.')}none_9{len(d)}0.pdf").write_bytes(b"")
    (at / "other.txt").write_text("x")
    return str(at), dict(pages)


def _read(spark, path, **options):
    archive.register(spark)
    reader = spark.read.format("stored_files")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def test_files_equal_the_table(spark, folder):
    path, pages = folder
    got = _read(spark, path)
    assert got.rdd.getNumPartitions() > 8  # two folders, an archive, loose files in splits
    rows = got.collect()
    read = {int(r.name.split("_")[1][:-4]): bytes(r.content) for r in rows if r.name.startswith("page_")}
    assert read == pages and all(r.size == len(r.content) for r in rows)
    assert {r.name: r.archive for r in rows if not r.size} == {"empty_900.pdf": "z.zip", "anone_910.pdf": None, "none_910.pdf": None}
    assert {r.folder for r in rows} == {"", "a", "b", "b/deep", "inner"}
    assert sum(1 for _ in rows) == len(pages) + 4


def test_held_ids_of_names_alone(spark, folder):
    path, pages = folder
    names = _read(spark, path, content="false", splits="3")
    assert names.where("content IS NOT NULL").count() == 0
    got = {r.id for r in readers.held_ids(names).collect()}
    assert got == {str(i) for i in pages} | {"900", "910"}
    assert _read(spark, f"{path}/nowhere").count() == 0


def test_pushed_conditions_read_less(spark, folder):
    path, pages = folder
    for condition, keep in (("name LIKE 'page\\\\_1%'", lambda n, d: n.startswith("page_1")), ("name IN ('page_7.pdf', 'page_8.pdf', 'x')", lambda n, d: n in ("page_7.pdf", "page_8.pdf")), ("folder = 'a' AND name LIKE '%5.pdf' AND size > 0", lambda n, d: d == "a" and n.endswith("5.pdf"))):
        every = _read(spark, path).select("folder", "name", "size").collect()
        got = _read(spark, path).where(condition).select("folder", "name", "size").collect()
        assert sorted(got) == sorted(r for r in every if keep(r.name, r.folder)) and got
    files = archive._Files({"path": path})
    files.filters = [archive.EqualTo(("name",), "page_7.pdf")]
    assert [r[2] for p in files.planned() for r in files.rows(p)] == ["page_7.pdf"]


def test_a_stream_of_files(spark, tmp_path):
    archive.register(spark)
    (tmp_path / "in").mkdir()

    def put(name, age):
        (tmp_path / "in" / name).write_bytes(name.encode())
        os.utime(tmp_path / "in" / name, (time.time() - age,) * 2)

    put("one.html", 100)
    put("two.html", 90)
    stream = spark.readStream.format("stored_files").option("settle", "1").load(str(tmp_path / "in"))

    def run(more):
        for name, age in more:
            put(name, age)
        q = stream.select("name").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([]) == ["one.html", "two.html"]
    assert run([("three.html", 50)]) == ["one.html", "three.html", "two.html"]  # a new run goes on where the last one stopped
    assert run([]) == ["one.html", "three.html", "two.html"]


def test_results_of_a_thousand_keywords(spark, tmp_path):
    hits = spark.range(4000).select(F.format_string("Word %d", F.col("id") % 1000).alias("keyword"), (F.lit(9) - F.expr("id div 1000")).alias("pos"), F.concat(F.lit("https://a/"), "id").alias("url"), F.lit("T é").alias("title"))
    out = tmp_path / "out"
    spark.sparkContext.setJobGroup("results", "")
    result_sink.save_all_results(hits.repartition(6), str(out), "2024-01-01 00:00:00")
    spark.sparkContext.setJobGroup(None, None)
    names = sorted(p.name for p in out.iterdir())
    assert len([n for n in names if n.startswith("search_results_")]) == 1000 and not [n for n in names if n.startswith(".")]
    assert (out / "search_results_word_7.txt").read_text() == "# Keyword: Word 7\n# Saved: 2024-01-01 00:00:00\n# Results: 4\n\n" + "".join(f"https://a/{i}  # T é\n" for i in (3007, 2007, 1007, 7))
    assert [r.url for r in readers.url_list(spark, str(out / "search_results_word_7.txt")).orderBy("line_no").collect()] == [f"https://a/{i}" for i in (3007, 2007, 1007, 7)]
    (manifest,) = [n for n in names if n.startswith("_results-")]
    assert sum(json.loads((out / manifest).read_text()).values()) == 4000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("results")) <= 3
    # A later run replaces its own files and leaves the others; of equal slugs the last keyword stays.
    more = spark.createDataFrame([("word_7", 1, "u", "t"), ("Word 7", 1, "v", "t")], "keyword string, pos long, url string, title string")
    result_sink.save_all_results(more, str(out), "later")
    assert (out / "search_results_word_7.txt").read_text() == "# Keyword: word_7\n# Saved: later\n# Results: 1\n\nu  # t\n"
    assert (out / "search_results_word_8.txt").read_text().count("\n") == 8


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("u"), "id"))
    hits = spark.range(400).select((F.col("id") % 20).cast("string").alias("keyword"), F.col("id").alias("pos"), bad.cast("string").alias("url"), F.lit("t").alias("title"))
    with pytest.raises(Exception, match="broken"):
        result_sink.save_all_results(hits.repartition(4), str(tmp_path), "now")
    assert list(tmp_path.iterdir()) == []
    result_sink.save_all_results(hits.limit(0), str(tmp_path), "now")
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["_results"]

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import hits, outcomes, pages, status
from tidemill.plans import catalogue
from tidemill.sources import readers, sinks
from tidemill.sources.settings import Settings
from tidemill.streaming import events


def _map(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


def test_file_names(spark):
    urls = ["https://h/document/12/My%20Doc", "https://h/document/12", "https://h/document/5/Report-5", "https://h/document/12/a%2Fb%3F/", "https://h/", "https://h/document/7/a;b?c"]
    assert _map(spark, T.safe_filename, urls) == ["My Doc_12.pdf", "12.pdf", "Report-5.pdf", "ab_12.pdf", "document.pdf", "a_7.pdf"]
    assert _map(spark, T.id_from_name, ["x_12.pdf", "12.pdf", "a12.pdf", "x_12.PDF"]) == ["12", "12", None, None]


def test_slugs_and_encoding(spark):
    assert _map(spark, T.slug, ["Café Śr! x-1_", "!!!"]) == ["café_śr__x-1", ""]
    assert _map(spark, T.query_encode, ["a*b~c d"]) == ["a%2Ab~c+d"]
    assert _map(spark, lambda c: T.page_cap(c.cast("int")), ["10", "200", "1000"]) == [10, 10, 30]
    pattern = T.LinkPattern(host="h.org")
    assert _map(spark, lambda c: T.content_url(c, pattern, "c/", ""), ["https://www.h.org/doc/12/T", "http://h.org/book/12"]) == ["c/12", None]


def test_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\n\nhttps://a/x  # t\nfoo\n  https://b/y z\n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "u.txt")).orderBy("line_no").collect()] == ["https://a/x", "foo", "https://b/y"]
    assert _map(spark, readers.keywords, ["a, b\n,c,"]) == [["a", "b", "c"]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x_9.pdf").write_bytes(b"")
    assert [r.id for r in readers.held_ids(readers.held_names(spark, str(tmp_path / "d"))).collect()] == ["9"]
    assert readers.held_names(spark, str(tmp_path / "none")).count() == 0


def _search(spark, limit=10):
    rows = [("k", 1, 0, "a"), ("k", 1, 1, "b"), ("k", 1, 2, "a"), ("k", 2, 0, "x"), ("k", 2, 1, "a"), ("k", 3, 0, "c")]
    found = spark.createDataFrame(rows, "keyword string, page int, pos int, id string")
    held = spark.createDataFrame([("x",)], "id string")
    return [r.id for r in hits.search(found.select("keyword", "page"), found, held, limit, 10).orderBy("n").collect()]


def test_page_stop_and_limit(spark):
    assert _search(spark) == ["a", "b"]
    assert _search(spark, 1) == ["a"] and _search(spark, 0) == []


def test_fold_depends_on_order(spark):
    rows = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1"), ("q", "3")], "keyword string, id string")
    step = lambda k, held: hits.not_held(rows.where(F.col("keyword") == k), held)
    got = outcomes.fold(["p", "q"], spark.createDataFrame([], "id string"), step)
    assert sorted((r.keyword, r.id) for r in got.collect()) == [("p", "1"), ("p", "2"), ("q", "3")]


def test_fold_plans_grow_by_a_constant(spark):
    keywords = [f"k{i}" for i in range(20)]
    rows = spark.createDataFrame([(k, 1, j, str(i + j)) for i, k in enumerate(keywords) for j in range(4)], "keyword string, page int, pos int, id string")
    sizes = []

    def step(k, held):
        mine = rows.where(F.col("keyword") == k)
        got = hits.search(mine.select("keyword", "page"), mine, held, 3, 10)
        sizes.append(got._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return got

    got = [(r.keyword, r.id) for r in outcomes.fold(keywords, spark.createDataFrame([("2",)], "id string"), step).collect()]
    held, want = {"2"}, []
    for i, k in enumerate(keywords):
        new = [str(i + j) for j in range(4) if str(i + j) not in held][:3]
        held |= set(new)
        want += [(k, x) for x in new]
    assert sorted(got) == sorted(want)
    growth = [b - a for a, b in zip(sizes[2:], sizes[3:], strict=False)]
    assert len(set(growth)) == 1 and growth[0] < 20
    with pytest.raises(ValueError, match="no keywords"):
        outcomes.fold([], rows, step)


def test_results_file_reads_back(spark, tmp_path):
    found = spark.createDataFrame([(1, "https://a/1", "T"), (0, "https://a/0", "S")], "pos int, url string, title string")
    path = sinks.save_results(found, "My word", str(tmp_path), "2024-01-01 00:00:00")
    assert path.endswith("search_results_my_word.txt")
    assert [r.url for r in readers.url_list(spark, path).orderBy("line_no").collect()] == ["https://a/0", "https://a/1"]


def test_pages_and_badge(spark):
    p = spark.createDataFrame([(1, None, 2), (2, 0, 10), (3, 10, 10)], "page_num int, width int, height int")
    assert [r.page_num for r in pages.printable(p).collect()] == [3]
    empty = spark.createDataFrame([], "status string")
    assert status.badge(empty).first().badge == "ready"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", 1, "searching"), ("k", 2, "success")], "keyword string, ord int, stage string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("keyword string, ord int, stage string").parquet(str(tmp_path / "in"))
    q = events.latest_status(stream, "keyword", "stage", "ord").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latest").first().stage == "success"


def test_stream_windows_and_routing(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:10", "x"), ("a", "2024-01-01 00:00:50", "y"), ("b", "2024-01-01 00:01:10", "z"), ("c", "2024-01-01 00:01:20", None)]
    schema = "key string, ts timestamp, message string"
    spark.createDataFrame(rows, "key string, ts string, message string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.counted(stream, "key").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start)[14:16], r.key, r.n) for r in spark.table("windows").collect()) == [("00", "a", 2), ("01", "b", 1), ("01", "c", 1)]
    registry = spark.createDataFrame([("a", "one"), ("b", "two")], "key string, sink string")
    q = events.drain(stream, registry, "key", "rest", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    sinks.save_routed(status.routed(spark.read.parquet(str(tmp_path / "in")), registry, "key", "rest"), str(tmp_path / "batch"))
    for out in ("out", "batch"):
        got = {(p.parent.name, json.loads(x)["key"]) for p in (tmp_path / out).glob("sink=*/*.json") for x in p.read_text().splitlines()}
        assert got == {("sink=one", "a"), ("sink=two", "b"), ("sink=rest", "c")}


def test_settings():
    assert Settings.of({}) == Settings()
    got = Settings.of({"T_PAGE_TIMEOUT": "3", "T_PAGE_CONCURRENCY": "0", "T_SCROLL_DELAY": "0.5", "T_HEADLESS": " No ", "T_COMMAND_TIMEOUT": "7"}, "T_")
    assert (got.page_timeout, got.page_concurrency, got.scroll_delay, got.headless, got.command_timeout) == (10, 1, 0.5, False, 7)
    with pytest.raises(ValueError, match="invalid literal"):
        Settings.of({"EXPORT_BATCH": "x"})


def test_anchors(spark):
    html = """<p><a  class="x" href='/1?a&amp;b' title="T&quot;t">one <b>t</b>wo</a><abbr href="/no">x</abbr><A HREF = "/2">a<a data-href="/3">b</a><a
href="/4"> &lt;</a><a title="1 > 0" href="/5">five</a><a href="/6">open"""
    d = spark.createDataFrame([(1, html), (2, None), (3, "")], "k int, html string")
    got = [tuple(r) for r in readers.anchors(d, "html", "k").orderBy("pos").collect()]
    assert got == [(1, 0, "/1?a&b", "one two", 'T"t'), (1, 1, "/2", "a", None), (1, 3, "/4", "<", None), (1, 4, "/5", "five", "1 > 0"), (1, 5, "/6", "open", None)]


def test_anchors_as_a_browser_reads_them(spark):
    cases = [
        ('<a href="/x">Link</A> tail <b>more</b>', [("/x", "Link", None)]),
        ('<A HREF=/x>Link</a > tail', [("/x", "Link", None)]),
        ("""<a title="use href='/bad' here" href="/good">t</a>""", [("/good", "t", "use href='/bad' here")]),
        ("<a title=x' href=/q?a=b&amp;c >t</a\n>z", [("/q?a=b&c", "t", "x'")]),
        ('<a href = "/1" href="/2">t</a>', [("/1", "t", None)]),
        ('<a\nhref="/1"title="T">t</a>', [("/1", "t", "T")]),
        ("<a/href='/1'/>t</a>", [("/1", "t", None)]),
        ("<a href>t</a><a href=>u</a>", [("", "t", None), ("", "u", None)]),
        ('<!-- <a href="/c">c</a> --><a href="/1">t<!-- > --></a>', [("/1", "t", None)]),
        ("""<script>x = '<a href="/s">'</script ><STYLE><a href="/s"></style><a href="/1">t</a><!-- <a href="/n">""", [("/1", "t", None)]),
        ('<a href="/never><b>t</b>', []),
        ("<a href='&#x2F;&#49;&eacute;&nosuch;&amp;#39;&#38;lt;&#0;&#xD800;&#x1F600;'>&lt;&#x27;&gt; &</a>", [("/1é&nosuch;&#39;&lt;\ufffd\ufffd\U0001f600", "<'> &", None)]),
        ("<abbr href=/no>x</abbr><area href=/no>", []),
    ]
    d = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(cases)], "k int, html string")
    got = [[] for _ in cases]
    for r in readers.anchors(d, "html", "k").orderBy("k", "pos").collect():
        got[r.k].append((r.href, r.text, r.title))
    assert got == [want for _, want in cases]


def test_a_tag_of_a_million_attributes(spark):
    began = time.time()
    many = {1: "x='1' " * 1_000_000, 2: 'y="2"' * 1_000_000, 3: "z " * 1_000_000, 4: "=" * 1_000_000, 5: "a=b" * 1_000_000, 6: "'" * 1_000_001, 7: "<!--" * 300_000, 8: "&#" * 500_000}
    d = spark.createDataFrame([(k, f"<a {v} href='/end'>t</a>") for k, v in many.items()], "k int, html string")
    got = {r.k: r.href for r in readers.anchors(d, "html", "k").collect()}
    assert {k: got.get(k) for k in (1, 2, 3)} == {1: "/end", 2: "/end", 3: "/end"}
    assert time.time() - began < 60


def test_links_with_and_without_slug(spark):
    pattern = T.LinkPattern(host="h\\.org")
    hrefs = ["https://www.h.org/document/12/My-Doc?x", "https://www.h.org/doc/12", "http://www.h.org/doc/12", "https://h.org/doc/1", "https://www.h.org/book/1", "", None]
    links = spark.createDataFrame(list(enumerate(hrefs)), "i int, href string")
    got = [(r.i, r.id, r.slug, r.url) for r in hits.extracted(links, pattern.link, "https://www.h.org/document").orderBy("i").collect()]
    assert got == [(0, "12", "My-Doc", "https://www.h.org/document/12/My-Doc"), (1, "12", "", "https://www.h.org/document/12")]


def test_more_text_rules(spark):
    assert _map(spark, T.percent_decode, ["a%zz%20b+c", "%C3%A9%", "100%"]) == ["a%zz b+c", "é%", "100%"]
    assert _map(spark, T.limit_menu, [" 7 ", "0", "-1", "x", "", "٣"]) == [7, 5, 5, 5, 5, 5]
    assert _map(spark, T.strip, ["\u2003\x1c a b\u00a0\n", "", None]) == ["a b", "", None]
    assert _map(spark, lambda c: T.expand_home(c, "/home/me"), ["~", "~/a", "~b", "/~/c"]) == ["/home/me", "/home/me/a", "~b", "/~/c"]
    assert _map(spark, lambda c: T.join_path(F.lit("/d"), c), ["a", "/a"]) == ["/d/a", "/a"]
    assert _map(spark, lambda c: T.slug(c, fallback="unduhan"), ["!!!", "A b"]) == ["unduhan", "a_b"]
    assert _map(spark, lambda c: T.document_timeout(c.cast("int")), ["0", "8", "9"]) == [120, 120, 240]


def test_text_rules_are_linear(spark):
    began = time.time()
    for blank in (" ", "_", "/", ";", "%", "<a "):
        d = spark.createDataFrame([(1, blank * 300_000 + "x" + blank * 300_000)], "k int, v string")
        d.select(F.length(T.strip(F.col("v"))), F.length(T.slug(F.col("v"))), F.length(T.safe_filename(F.col("v")))).collect()
        readers.anchors(d, "v", "k").collect()
    assert time.time() - began < 30


def test_every_query_has_sql(spark, sf):
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert catalogue.QUERIES["page_stop_limit"](spark, sf).count() >= 0

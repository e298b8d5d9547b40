"""Queries of the link catalogue on the driver's tables, each with the same query in SQL.

The tables have no search pages or outcomes of their own; each query binds the operator to a similar column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.cluster import shared_dir
from tidemill.functions import text as T
from tidemill.operators import asof as A
from tidemill.operators import hits as H
from tidemill.operators import machine as M
from tidemill.operators import outcomes as O
from tidemill.operators import pages as P
from tidemill.operators import status as S
from tidemill.operators import summaries as Z
from tidemill.operators import turns as U
from tidemill.sources import readers as R
from tidemill.sources.sinks import result_lines
from tidemill.streaming import events as E
from tidemill.streaming import tasks as K

PATTERN = r"^https?://[^/?#]+/(en|fr|de|es)/(\d+)"
PREFIX = "https://www.example.org/document"
LIMIT, CAP = 5, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINKS = rf"""links AS (SELECT page_id, regexp_extract(url, '{PATTERN}', 1) AS keyword, regexp_extract(url, '{PATTERN}', 2) AS id FROM pages WHERE regexp_matches(url, '{PATTERN}'))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, keyword, id) of matching page urls."""
    pages = table(spark, d, "pages").select("page_id", "url", F.col("url").alias("href"))
    got = H.extracted(pages, PATTERN, PREFIX, id_group=2, slug_group=None)
    return got.select("page_id", F.regexp_extract("href", PATTERN, 1).alias("keyword"), "id", "url")


def _paged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(keyword, g, page) and the hits as (keyword, page, pos, id): two stored pages make one page of a search."""
    got = _hits(spark, d).withColumn("g", F.expr("page_id div 2"))
    pages = got.select("keyword", "g").distinct().withColumn("page", F.row_number().over(Window.partitionBy("keyword").orderBy("g")))
    return pages, got.join(pages, ["keyword", "g"]).select("keyword", "page", F.col("page_id").alias("pos"), "id")


def _held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"))


@query(f"WITH {_LINKS} SELECT page_id, keyword, id, '{PREFIX}/' || id AS url FROM links")
def link_extract(spark, d):
    return _hits(spark, d)


# Pages of the table with their anchors written in other ways, by page_id modulo 8; 0 and those without a shape stay.
_PLAIN = r'<a href="(/[^"]*)">([^<]*)</a>'
_SHAPES = {
    1: r"""<a class='x' title="About \1" HREF='\1'> </a>""",
    2: r"""<a data-href="/zz" href="\1"><b></b></a><a name="q">no link</a>""",
    3: r"""<a href="\1">\2</A> tail <b>x</b>""",
    4: r"""<a title="use href='/bad' here" href="\1">\2</a >""",
    5: r"""<A id=q HREF = \1 >\2</a""" + "\n>",
    6: r"""<!-- <a href="/hidden">h</a> --><a href='\1'>&#x27;\2&#39;&eacute;&amp;lt;</a>""",
    7: r"""<script>s = '<a href="/js">x</a>'</script><a href>e</a><a href="/never>\2</a>""",
}
_HTML = "CASE page_id % 8 {} ELSE html END".format(" ".join(f"WHEN {k} THEN regexp_replace(html, '{_PLAIN}', '{v.replace(chr(39), chr(39) * 2)}', 'g')" for k, v in _SHAPES.items()))


def _unescaped(sql: str) -> str:
    names = {"lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "amp": "&", "eacute": "é", "copy": "©", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—"}
    cases = [f"WHEN starts_with(x, '{k};') THEN '{v}' || substr(x, {len(k) + 2})" for k, v in names.items()]
    cases.append(r"WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]{1,6};') THEN chr(CAST('0x' || regexp_extract(x, '^#[xX]([^;]*);', 1) AS INTEGER)) || regexp_replace(x, '^[^;]*;', '')")
    cases.append(r"WHEN regexp_matches(x, '^#[0-9]{1,7};') THEN chr(CAST(regexp_extract(x, '^#([^;]*);', 1) AS INTEGER)) || regexp_replace(x, '^[^;]*;', '')")
    return f"array_to_string(list_transform(string_split({sql}, '&'), lambda x, i: CASE WHEN i = 1 THEN x {' '.join(cases)} ELSE '&' || x END), '')"


def _attribute(name: str) -> str:
    own = f"list_filter(attributes, lambda a: lower(trim(string_split(a, '=')[1], blank)) = '{name}')[1]"
    raw = f"trim(substr({own}, len(string_split({own}, '=')[1]) + 2), blank)"
    bare = f"CASE WHEN left({raw}, 1) IN (chr(39), chr(34)) THEN substr({raw}, 2, len({raw}) - 2) ELSE {raw} END"
    return f"CASE WHEN {own} IS NOT NULL THEN {_unescaped(bare)} END"


_WS = r"\t\n\f\r "
_ONE = rf"""[^{_WS}/>=]+(?:[{_WS}]*=[{_WS}]*(?:"[^"]*"|''[^'']*''|[^{_WS}>"''][^{_WS}>]*))?"""
_SHOWN = rf"regexp_replace({_HTML}, '(?is)<!--.*?(?:-->|\z)|<script[{_WS}/>].*?(?:</script[{_WS}/>]|\z)|<style[{_WS}/>].*?(?:</style[{_WS}/>]|\z)', '', 'g')"
_INNER = rf"string_split_regex(substr(part, len(tag) + 1), '</[aA](?:[{_WS}/][^>]*)?>')[1]"
_TEXT = _unescaped(f"regexp_replace({_INNER}, '<[^>]*>', '', 'g')")
_ANCHORS = rf"""pieces AS (SELECT page_id, url AS page_url, string_split_regex({_SHOWN}, '<[aA][{_WS}/]')[2:] AS h FROM pages),
parts AS (SELECT page_id, page_url, CAST(unnest(range(0, len(h))) AS INTEGER) AS pos, unnest(h) AS part FROM pieces),
tags AS (SELECT *, regexp_extract(part, '^(?:[{_WS}/]*{_ONE})*[{_WS}/]*(?:[^{_WS}/>=]+[{_WS}]*=[{_WS}]*)?>', 0) AS tag FROM parts),
lists AS (SELECT *, regexp_extract_all(tag, '{_ONE}') AS attributes, ' ' || chr(9) || chr(10) || chr(12) || chr(13) AS blank FROM tags),
anchors AS (SELECT page_id, page_url, pos, {_attribute("href")} AS href, trim({_TEXT}, blank) AS text, {_attribute("title")} AS title FROM lists),
found AS (SELECT * FROM anchors WHERE href IS NOT NULL)"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    html, i = F.col("html"), F.col("page_id")
    for k, shape in _SHAPES.items():
        html = F.when(i % 8 == k, F.regexp_replace("html", _PLAIN, shape.replace(r"\1", "$1").replace(r"\2", "$2"))).otherwise(html)
    return R.anchors(table(spark, d, "pages").select("page_id", F.col("url").alias("page_url"), html.alias("html")), "html", "page_id", "page_url")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, href, text, title FROM found")
def anchor_scan(spark, d):
    return _anchors(spark, d).drop("page_url")


# Links of the pages' anchors: two characters stand for the id, the rest for the slug.
SHORT = r"^/([^/?#]{2})([^/?#]+)?"
_SHORT = f"""short AS (SELECT page_id, pos, regexp_extract(page_url, '{PATTERN}', 1) AS keyword, page_id AS page, regexp_extract(href, '{SHORT}', 1) AS id, regexp_extract(href, '{SHORT}', 2) AS slug, text, title
FROM found WHERE regexp_matches(href, '{SHORT}') AND regexp_matches(page_url, '{PATTERN}'))"""


def _short(spark: SparkSession, d: str) -> DataFrame:
    links = H.extracted(_anchors(spark, d).where(F.col("page_url").rlike(PATTERN)), SHORT, PREFIX)
    return links.select("page_id", "pos", F.regexp_extract("page_url", PATTERN, 1).alias("keyword"), F.col("page_id").alias("page"), "id", "slug", "url", T.title(F.col("text"), F.col("title"), F.col("slug"), F.col("id")).alias("title"))


_TITLE = "coalesce(nullif(text, ''), nullif(title, ''), nullif(replace(slug, '-', ' '), ''), 'Document ' || id)"


@query(f"WITH {_ANCHORS}, {_SHORT} SELECT page_id, pos, keyword, id, '{PREFIX}/' || id || CASE WHEN slug = '' THEN '' ELSE '/' || slug END AS url, {_TITLE} AS title FROM short")
def page_hits(spark, d):
    return _short(spark, d).select("page_id", "pos", "keyword", "id", "url", "title")


@query(f"""WITH {_ANCHORS}, {_SHORT}, fresh AS (SELECT * FROM short WHERE id NOT IN (SELECT lower(substr(n_name, 1, 2)) FROM nation) QUALIFY row_number() OVER (PARTITION BY keyword, id ORDER BY page, pos) = 1),
ranked AS (SELECT keyword, page, pos, id, {_TITLE} AS title, CAST(row_number() OVER (PARTITION BY keyword ORDER BY page, pos) AS INTEGER) AS n FROM fresh)
SELECT lim, keyword, page, pos, id, title, n FROM ranked JOIN (VALUES (-1), (0), (3), (20)) v(lim) ON n <= lim""")
def limits(spark, d):
    short, held = _short(spark, d), table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("id"))
    # Without a page cap or page stop only the limit ends the search; it is ranked once for all limits.
    fresh = H.first_wins(H.not_held(short, held), ["keyword", "id"], ["page", "pos"])
    n = H.ranked(fresh, "keyword", "page", ["pos"]).withColumn("lim", F.explode(F.array(*map(F.lit, (-1, 0, 3, 20)))))
    return n.where(F.col("n") <= F.col("lim")).select("lim", "keyword", "page", "pos", "id", "title", "n")


@query(f"WITH {_LINKS} SELECT keyword, id, min(page_id) AS page_id FROM links GROUP BY ALL")
def first_wins(spark, d):
    return H.first_wins(_hits(spark, d), ["keyword", "id"], ["page_id"]).select("keyword", "id", "page_id")


@query(f"WITH {_LINKS} SELECT page_id, keyword, id FROM links WHERE id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)")
def anti_held(spark, d):
    return H.not_held(_hits(spark, d), _held(spark, d)).select("page_id", "keyword", "id")


@query(f"WITH {_LINKS} SELECT keyword, count(*) AS n_links, CAST(count(*) FILTER (id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark)) AS BIGINT) AS skipped_existing FROM links GROUP BY 1")
def held_counts(spark, d):
    return H.held_count(_hits(spark, d), _held(spark, d), "keyword")


@query(rf"""WITH {_LINKS},
pl AS (SELECT DISTINCT keyword, page_id // 2 AS g FROM links),
pn AS (SELECT keyword, g, CAST(row_number() OVER (PARTITION BY keyword ORDER BY g) AS INTEGER) AS page FROM pl),
h AS (SELECT l.keyword, page, page_id AS pos, id FROM links l JOIN pn ON l.keyword = pn.keyword AND l.page_id // 2 = pn.g WHERE page <= {CAP}),
f AS (SELECT * FROM h WHERE id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) QUALIFY row_number() OVER (PARTITION BY keyword, id ORDER BY page, pos) = 1),
s AS (SELECT keyword, min(CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.keyword = pn.keyword AND f.page = pn.page) THEN page END) AS stop FROM pn WHERE page <= {CAP} GROUP BY 1),
k AS (SELECT f.keyword, page, pos, id, CAST(row_number() OVER (PARTITION BY f.keyword ORDER BY page, pos) AS INTEGER) AS n FROM f JOIN s ON f.keyword = s.keyword WHERE stop IS NULL OR page < stop)
SELECT keyword, page, pos, id, n FROM k WHERE n <= {LIMIT}""")
def page_stop_limit(spark, d):
    pages, links = _paged(spark, d)
    return H.search(pages.select("keyword", "page"), links, _held(spark, d), LIMIT, CAP)


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS p FROM pages),
s AS (SELECT page_id, url, coalesce(nullif(trim(regexp_replace(url_decode(coalesce(nullif(p[len(p) - strpos(reverse(p), '/') + 2:], ''), 'document')), '[\\/*?:"<>|]', '', 'g')), ''), 'document') AS n,
             regexp_extract(url, '/(?:en|fr|de|es)/(\d+)', 1) AS i FROM p)
SELECT page_id, CASE WHEN i <> '' AND NOT ends_with(n, i) THEN n || '_' || i ELSE n END || '.pdf' AS filename FROM s""")
def url_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url"), r"/(?:en|fr|de|es)/(\d+)").alias("filename"))


@query(r"""WITH s AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, trim(regexp_replace(lower(t), '[^\p{L}\p{N}_\-]', '_', 'g'), '_') AS slug, trim(regexp_replace(t, '[^\p{L}\p{N}_\-]', '_', 'g'), '_') AS gui_slug FROM s""")
def slug(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.slug(t).alias("slug"), T.slug(t, lower=False).alias("gui_slug"))


@query("""SELECT doc_id, replace(url_encode(text), '%20', '+') AS encoded,
'https://example.org/search?query=' || replace(url_encode(text), '%20', '+') || '&page=' || CAST(doc_id % 7 + 1 AS VARCHAR) AS url FROM documents""")
def query_encode(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.query_encode(t).alias("encoded"), T.search_url(t, F.col("doc_id") % 7 + 1, "https://example.org/search").alias("url"))


@query(rf"""SELECT page_id, coalesce(nullif(trim(CASE page_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' text ' END), ''), CASE WHEN page_id % 5 = 0 THEN 'attribute' END,
nullif(replace(CASE WHEN page_id % 7 < 4 THEN 'a-b-' || CAST(page_id AS VARCHAR) ELSE '' END, '-', ' '), ''), 'Document ' || CAST(page_id AS VARCHAR)) AS title FROM pages""")
def title_fallback(spark, d):
    i = F.col("page_id")
    words = F.when(i % 3 == 0, "  ").when(i % 3 == 2, " text ")
    s = F.when(i % 7 < 4, F.concat(F.lit("a-b-"), i.cast("string"))).otherwise("")
    return table(spark, d, "pages").select("page_id", T.title(words, F.when(i % 5 == 0, "attribute"), s, i.cast("string")).alias("title"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '/(?:en|fr)/(\d+)', 1), '') AS id,
CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN regexp_extract(url, '/(?:en|fr)/(\d+)', 1) = '' THEN 'no document id' END AS reason FROM pages""")
def valid_reject(spark, d):
    return H.rejects(table(spark, d, "pages").select("page_id", "url"), r"/(?:en|fr)/(\d+)").select("page_id", "id", "reason")


@query("SELECT page_id, 'https://x/content/' || nullif(regexp_extract(url, 'https?://(?:www\\.)?[^/?#]+/(?:en|de)/(\\d+)', 1), '') || '/view' AS content, CASE WHEN starts_with(url, 'https://') THEN '~' || substr(url, 9) ELSE url END AS shown FROM pages".replace("\\\\", "\\"))
def content_link(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.content_url(u, T.LinkPattern(kinds="en|de"), "https://x/content/", "/view").alias("content"), T.mask_home(u, "https://").alias("shown"))


def _outcomes(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.when(kind.isin("purchase", "signup"), "success").when(kind.isin("view", "click"), "skipped").otherwise("failed").alias("status"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("reason"))


_COUNTS = """c AS (SELECT user_id, count(*) AS total, CAST(count(*) FILTER (event_type IN ('purchase', 'signup')) AS BIGINT) AS success, CAST(count(*) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS skipped,
CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, coalesce(string_agg('u' || event_id || ':' || event_type, ',' ORDER BY event_id) FILTER (event_type = 'error'), '') AS failed_urls
FROM events GROUP BY 1)"""


@query(f"WITH {_COUNTS} SELECT * FROM c")
def outcomes(spark, d):
    c = O.counters(_outcomes(spark, d), "user_id")
    return c.withColumn("failed_urls", F.array_join(F.transform("failed_urls", lambda f: F.concat(f["url"], F.lit(":"), f["reason"])), ","))


@query(f"""WITH {_COUNTS}, k AS (SELECT *, coalesce(user_id <= (SELECT min(user_id) FROM c WHERE failed > success + 4), true) AS done FROM c)
SELECT count(*) AS total_keywords, CAST(count(*) FILTER (done) AS BIGINT) AS processed_keywords, CAST(coalesce(sum(success) FILTER (done), 0) AS BIGINT) AS total_downloaded, CAST(coalesce(sum(skipped) FILTER (done), 0) AS BIGINT) AS total_skipped,
CAST(coalesce(sum(failed) FILTER (done), 0) AS BIGINT) AS total_failed, EXISTS (SELECT 1 FROM c WHERE failed > success + 4) AS stopped FROM k""")
def overall(spark, d):
    stats = O.counters(_outcomes(spark, d), "user_id").withColumn("stopped", F.col("failed") > F.col("success") + 4)
    return O.overall(stats, "user_id")


@query(f"""WITH {_LINKS}, i AS (SELECT page_id, id, page_id % 2 = 0 AS ok FROM links)
SELECT page_id, id, CASE WHEN max(CAST(ok AS INTEGER)) OVER (PARTITION BY id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'skipped' WHEN ok THEN 'success' ELSE 'failed' END AS status FROM i""")
def dup_skip(spark, d):
    return O.repeats(_hits(spark, d).withColumn("ok", F.col("page_id") % 2 == 0), "id", "ok", "page_id").select("page_id", "id", "status")


@query("SELECT p_partkey, 'f' || CAST(p_partkey % 50 AS VARCHAR) || '.pdf' AS filename, p_partkey % 50 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS held FROM part")
def skip_by_file(spark, d):
    name = lambda c: F.concat(F.lit("f"), c.cast("string"), F.lit(".pdf"))
    files = table(spark, d, "supplier").select(name(F.col("s_suppkey")).alias("name"), F.col("s_acctbal").alias("size"))
    return O.skip_held(table(spark, d, "part").select("p_partkey", name(F.col("p_partkey") % 50).alias("filename")), files)


@query("SELECT DISTINCT CAST(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id // 2 END AS VARCHAR) AS id FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 4")
def held_from_names(spark, d):
    n, stem = F.col("doc_id"), F.expr("cast(doc_id div 2 as string)")
    name = F.concat(F.when(n % 4 == 0, stem).when(n % 4 == 3, F.concat(F.lit("a"), stem)).otherwise(F.concat(F.lit("Some title_"), stem)), F.when(n % 5 == 4, ".PDF").otherwise(".pdf"))
    return R.held_ids(table(spark, d, "documents").select(name.alias("name")))


@query("""SELECT doc_id, page_num, (page_num - 1) // 8 AS batch, page_num % 8 = 0 OR page_num = n_chars % 21 + 1 AS ends_batch, format('page-{:08d}.pdf', page_num) AS file
FROM (SELECT doc_id, n_chars, unnest(range(1, n_chars % 21 + 2)) AS page_num FROM documents)""")
def page_batches(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_chars") % 21 + 1)).alias("page_num"))
    return P.batched(pages).select("doc_id", "page_num", "batch", "ends_batch", "file")


@query("SELECT p_partkey, ceil(p_size - 10) / 96.0::DOUBLE AS w_in, ceil(p_retailprice) / 96.0::DOUBLE AS h_in FROM part WHERE p_size - 10 > 0 AND p_retailprice > 0")
def geometry(spark, d):
    return P.printable(table(spark, d, "part").select("p_partkey", (F.col("p_size") - 10).alias("width"), F.col("p_retailprice").alias("height"))).select("p_partkey", "w_in", "h_in")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'page object missing' ELSE CASE WHEN toxic = 1 THEN 'broken' ELSE 'page or image load timed out' END END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR toxic = 1 OR quality = 0""".replace("SELECT doc_id", "SELECT d.doc_id"))
def missing_pages(spark, d):
    pages = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("loaded"), F.lit(0).alias("pending_images"), F.when(F.col("toxic") == 1, "broken").alias("error"))
    return P.load_failures(table(spark, d, "documents").select("doc_id"), pages, ["doc_id"]).select("doc_id", "reason")


@query("SELECT lang, CAST(count(*) FILTER (coalesce(quality, 0) = 1) AS BIGINT) AS n_loaded, count(*) AS n_pages, bool_and(coalesce(quality, 0) = 1) AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def pages_ready(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return P.loaded(j.withColumn("loaded", F.col("quality") == 1), "lang")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def task_latest(spark, d):
    return S.latest(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


_STATE = "CASE event_type WHEN 'click' THEN 'searching' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'stopped' ELSE 'ready' END"


@query(f"""WITH t AS (SELECT user_id, {_STATE.replace('event_type', "arg_max(event_type, (ts, event_id))")} AS s FROM events GROUP BY 1),
c AS (SELECT CAST(count(*) FILTER (s IN ('searching', 'downloading')) AS BIGINT) AS n_running, count(*) AS n, coalesce(bool_or(s = 'stopped'), false) AS any_stopped, coalesce(bool_and(s = 'success'), false) AS all_done FROM t)
SELECT n_running, n - n_running AS n_idle, any_stopped, all_done, CASE WHEN n_running > 0 THEN 'running' WHEN any_stopped THEN 'stopped' WHEN all_done THEN 'done' ELSE 'ready' END AS badge FROM c""")
def task_badge(spark, d):
    return S.badge(task_latest(spark, d).select(F.expr(_STATE).alias("status")))


@query(f"""SELECT event_id, {_STATE} AS status, CASE {_STATE} WHEN 'searching' THEN 'blue' WHEN 'error' THEN 'red' WHEN 'success' THEN 'green' WHEN 'stopped' THEN 'orange' ELSE 'gray' END AS colour,
CASE WHEN user_id % 10 = 3 THEN 'fallback' ELSE 'sink' || CAST(user_id % 10 AS VARCHAR) END AS sink FROM events""")
def routed_messages(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_STATE).alias("status"), (F.col("user_id") % 10).alias("thread"))
    registry = spark.range(10).where("id <> 3").select(F.col("id").alias("thread"), F.concat(F.lit("sink"), F.col("id").cast("string")).alias("sink"))
    return S.routed(e, registry, "thread", "fallback").select("event_id", "status", S.colour(F.col("status")).alias("colour"), "sink")


@query("""SELECT user_id, event_id, stage, CAST(row_number() OVER (PARTITION BY user_id, stage ORDER BY event_id) AS INTEGER) AS current, count(*) OVER (PARTITION BY user_id, stage) AS total,
CAST(row_number() OVER (PARTITION BY user_id, stage ORDER BY event_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id, stage) AS fraction FROM events, (VALUES ('before'), ('after')) v(stage)""")
def progress_events(spark, d):
    return S.progress_events(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""SELECT user_id, event_id, event_type, CASE WHEN max(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id) = 1 THEN 'stopped' ELSE 'success' END AS final FROM events
QUALIFY max(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 0""")
def stop_cut(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "signup").alias("stop"))
    e = e.withColumn("final", S.final_status(F.max("stop").over(Window.partitionBy("user_id"))))
    return O.before_stop(e, "user_id", "event_id", "stop").drop("stop")


@query("""WITH a AS (SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER w, false) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS k FROM b)
SELECT user_id, min(CASE WHEN k = 2 THEN event_id END) AS settled_at FROM c GROUP BY 1""")
def settled(spark, d):
    return P.settled(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id, coalesce(value > 50, false) AS timed_out FROM events")
def timeouts(spark, d):
    return P.within(table(spark, d, "events").select("event_id", "value"), "value", 50.0).select("event_id", "timed_out")


@query("SELECT user_id, event_type, count(*) AS n_sheets FROM events GROUP BY ALL HAVING count(*) <> 1")
def sheet_check(spark, d):
    return P.sheet_violations(table(spark, d, "events"), ["user_id", "event_type"])


@query(r"""WITH l AS (SELECT page_id AS line_no, CASE page_id % 4 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || url || '  # title' WHEN 2 THEN '   ' ELSE 'plain ' || CAST(page_id AS VARCHAR) END AS line FROM pages)
SELECT line_no, coalesce(nullif(regexp_extract(line, 'https?://\S+', 0), ''), trim(line)) AS url FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""")
def url_list(spark, d):
    i = F.col("page_id")
    line = F.when(i % 4 == 0, F.concat(F.lit("# "), F.col("url"))).when(i % 4 == 1, F.concat(F.lit("  "), F.col("url"), F.lit("  # title"))).when(i % 4 == 2, "   ").otherwise(F.concat(F.lit("plain "), i.cast("string")))
    return R.urls_from_lines(table(spark, d, "pages").select(i.alias("line_no"), line.alias("line")))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, k AS keyword FROM
(SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, trim(s[i], ' \t\n') AS k, s FROM (SELECT doc_id, string_split(replace(text, ',', chr(10)), chr(10)) AS s FROM documents)) WHERE k <> ''""".replace("s[i]", "unnest(s)").replace(", s FROM (SELECT", " FROM (SELECT"))
def keyword_list(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(R.keywords(F.col("text"))).alias("pos", "keyword"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' u' || CAST(doc_id AS VARCHAR) ELSE 'v' || CAST(doc_id AS VARCHAR) END AS url FROM documents WHERE doc_id % 3 <> 2")
def item_list(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(i % 3 == 1, F.concat(F.lit(" v"), i.cast("string"), F.lit(" "))).when(i % 3 == 2, "  ").alias("raw"), F.when(i % 3 == 0, F.concat(F.lit(" u"), i.cast("string"))).alias("doc_url"))
    return R.items(rows, ordinal="doc_id")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content FROM (SELECT DISTINCT conv_id, turn, text FROM conversations) GROUP BY 1")
def chunk_join(spark, d):
    return R.joined_chunks(table(spark, d, "conversations").select("conv_id", "turn", "text").distinct(), "conv_id", "turn", "text")


@query("""SELECT p_partkey, least(p_size, 25) AS low, greatest(p_size, 25) AS high,
CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE ELSE greatest(0.5, p_size / 20.0::DOUBLE) END AS typed_low, CASE WHEN p_partkey % 3 = 0 THEN 5.0::DOUBLE ELSE greatest(greatest(0.5, p_size / 20.0::DOUBLE), 1.0) END AS typed_high,
CASE WHEN p_partkey % 2 = 0 THEN greatest(1, p_size - 20) ELSE 10 END AS lim, greatest(10, (p_size * 30 + 39) // 40 + 5) AS cap, greatest(1.0, round(p_retailprice / 96.0::DOUBLE, 3)) AS paper,
CAST(ceil(p_size / 8.0::DOUBLE) AS BIGINT) AS batches, CAST(trunc(p_retailprice * 1000) AS BIGINT) AS ms, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) / (p_size % 5) END AS fraction,
p_partkey % 4 <> 1 AS flag, CASE WHEN p_partkey % 3 = 0 OR p_size <= 20 THEN 5 ELSE p_size - 20 END AS menu, CAST(greatest(1, ceil((p_size - 10) / 8.0::DOUBLE)) * 120 AS BIGINT) AS patience FROM part""")
def scalar_rules(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size")
    low, high = T.delay_range(n, F.lit(25))
    t_low, t_high = T.delay_range_typed(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise((n / 20).cast("string")), F.lit("1.0"))
    typed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), (n - 20).cast("string"))).otherwise("many")
    return p.select("p_partkey", low.alias("low"), high.alias("high"), t_low.alias("typed_low"), t_high.alias("typed_high"), T.limit_typed(typed).alias("lim"), T.page_cap(n * 30).alias("cap"), T.paper_inches(F.col("p_retailprice"), 7.25).alias("paper"), T.batches(n, 8).alias("batches"), T.milliseconds(F.col("p_retailprice")).alias("ms"), T.progress(n, n % 5).alias("fraction"), T.truthy(F.when(F.col("p_partkey") % 4 == 1, " No ").otherwise("yes")).alias("flag"), T.limit_menu(F.when(F.col("p_partkey") % 3 == 0, F.concat(n.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), (n - 20).cast("string")))).alias("menu"), T.document_timeout(n - 10).alias("patience"))


@query("""WITH k AS (SELECT p_partkey, trim(substr(trim(p_name), 1, 24)) AS s FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY p_partkey) > 1 THEN s || ' (task_' || CAST(p_partkey AS VARCHAR) || ')' ELSE s END AS tab FROM k""")
def tab_names(spark, d):
    p = table(spark, d, "part").withColumn("s", T.strip(F.substring(T.strip(F.col("p_name")), 1, 24)))
    clash = F.row_number().over(Window.partitionBy("s").orderBy("p_partkey")) > 1
    return p.withColumn("clash", clash).select("p_partkey", T.tab_name(F.col("p_name"), F.concat(F.lit("task_"), F.col("p_partkey").cast("string")), F.col("clash")).alias("tab"))


@query(f"WITH {_LINKS} SELECT page_id, '{PREFIX}/' || id || '  # Document ' || id AS line FROM links")
def result_file_lines(spark, d):
    return _hits(spark, d).select("page_id", result_lines(F.col("url"), F.concat(F.lit("Document "), F.col("id"))).alias("line"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, decode(from_base64(to_base64(encode(o_orderpriority)))) AS decoded FROM orders")
def stamps(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.stamp(F.col("o_orderdate")).alias("stamp"), F.unbase64(F.base64(F.col("o_orderpriority").cast("binary"))).cast("string").alias("decoded"))


@query(f"""WITH {_LINKS}, r AS (SELECT keyword, page_id // 2 AS page, row_number() OVER (PARTITION BY keyword, id ORDER BY page_id) = 1 AS f, id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) AS h FROM links),
p AS (SELECT keyword, page, count(*) AS n_links, CAST(count(*) FILTER (h) AS BIGINT) AS n_held, CAST(count(*) FILTER (f AND NOT h) AS BIGINT) AS n_new FROM r GROUP BY ALL)
SELECT *, CAST(sum(n_new) OVER (PARTITION BY keyword ORDER BY page) AS BIGINT) AS total FROM p""")
def page_progress(spark, d):
    return H.page_progress(_hits(spark, d).select("keyword", "id", F.expr("page_id div 2").alias("page"), F.col("page_id").alias("pos")), _held(spark, d))


@query("""SELECT user_id, format('Mengunduh {}/{} (Sukses: {})', s + f, s + f + k, s) AS line, format('UNDUH ({}/{})', s + f, s + f + k) AS badge, CASE WHEN f > s THEN 'Dihentikan oleh pengguna.' ELSE format('Selesai! {} PDF tersimpan', s) END AS closing
FROM (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS s, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type IN ('view', 'click')) AS k FROM events GROUP BY 1)""")
def status_lines(spark, d):
    c = O.counters(_outcomes(spark, d), "user_id")
    done = F.col("success") + F.col("failed")
    return c.select("user_id", T.progress_line(done, F.col("total"), F.col("success")).alias("line"), T.progress_badge(done, F.col("total")).alias("badge"), T.closing_line(F.col("failed") > F.col("success"), F.col("success")).alias("closing"))


@query("SELECT n_nationkey, coalesce(f, 'base') AS folder FROM nation LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS f FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey")
def active_folder(spark, d):
    tasks = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.col("s_name").alias("folder"))
    return S.first_of_name(table(spark, d, "nation").select("n_nationkey"), tasks, "n_nationkey", "s_suppkey", "folder", "base")


@query("SELECT doc_id, 'no pages' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without_pages(spark, d):
    return P.without_pages(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, list_contains(string_split(text, chr(10)), '') AS pending FROM documents")
def pending_images(spark, d):
    return table(spark, d, "documents").select("doc_id", P.pending(F.transform(F.split("text", "\n"), lambda x: x != "")).alias("pending"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, k AS keyword, 10 AS lim FROM
(SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, trim(unnest(s), ' \t\n') AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE k <> ''""")
def pasted_keywords(spark, d):
    return R.pasted(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY l_linenumber) AS failed FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def failed_pages_text(spark, d):
    failed = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("f"))
    return failed.select("l_orderkey", T.joined(F.col("f")).alias("failed"))


@query(f"WITH {_ANCHORS} SELECT page_id, array_to_string(list_slice(list(href ORDER BY pos), 1, 3), ' ') AS links FROM found GROUP BY 1")
def head_links(spark, d):
    hrefs = _anchors(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("h"))
    return hrefs.select("page_id", F.array_join(T.head(F.col("h.href"), 3), " ").alias("links"))


_TURNS = ("en", "de", "fr", "es")


def _turns(turns: tuple[str, ...], head: list[str], held: str, limit: int) -> str:
    """Keywords in turn, from ``pn`` (keyword, page) and ``h`` (keyword, page, pos, id): what one takes is held for all after it."""
    out = list(head)
    for i, k in enumerate(turns):
        out.append(f"f{i} AS (SELECT * FROM h WHERE keyword = '{k}' AND id NOT IN ({held}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, pos) = 1)")
        out.append(f"s{i} AS (SELECT min(page) AS stop FROM pn WHERE keyword = '{k}' AND page NOT IN (SELECT page FROM f{i}))")
        out.append(f"t{i} AS MATERIALIZED (SELECT * FROM (SELECT f.*, CAST(row_number() OVER (ORDER BY page, pos) AS INTEGER) AS n FROM f{i} f, s{i} WHERE stop IS NULL OR page < stop) WHERE n <= {limit})")
        held += f" UNION ALL SELECT id FROM t{i}"
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT keyword, page, pos, id, n FROM t{i}" for i in range(len(turns)))


_PAGED = [
    _LINKS,
    "pl AS (SELECT DISTINCT keyword, page_id // 2 AS g FROM links)",
    "pa AS (SELECT keyword, g, CAST(row_number() OVER (PARTITION BY keyword ORDER BY g) AS INTEGER) AS page FROM pl)",
    f"pn AS (SELECT keyword, page FROM pa WHERE page <= {CAP})",
    f"h AS (SELECT l.keyword, page, page_id AS pos, id FROM links l JOIN pa ON l.keyword = pa.keyword AND l.page_id // 2 = pa.g WHERE page <= {CAP})",
]


@query(_turns(_TURNS, _PAGED, "SELECT CAST(item_id AS VARCHAR) FROM benchmark", LIMIT))
def keyword_turns(spark, d):
    pages, links = _paged(spark, d)
    turns = spark.createDataFrame(list(enumerate(_TURNS)), "turn long, keyword string")
    return U.in_turn(pages.select("keyword", "page"), links, _held(spark, d), turns, LIMIT, CAP).select("keyword", F.col("page").cast("int").alias("page"), "pos", "id", "n")


@query("SELECT doc_id, 'no valid document pages' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def without_exports(spark, d):
    pages = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("exported"))
    return P.without_exports(table(spark, d, "documents").select("doc_id"), pages, ["doc_id"])


@query(r"""SELECT page_id, CASE WHEN starts_with(f, '~/') THEN '/home/me' || substr(f, 2) ELSE f END || '/' || url AS path, CASE WHEN page_id % 2 = 0 THEN '/' || url ELSE '/tmp/' || url END AS absolute
FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS url, CASE page_id % 2 WHEN 0 THEN '~/' || regexp_extract(url, '//([^/]*)', 1) ELSE '/d~x' END AS f FROM pages)""")
def page_paths(spark, d):
    name, i = F.regexp_replace("url", "^https?://", ""), F.col("page_id")
    folder = F.when(i % 2 == 0, F.concat(F.lit("~/"), F.regexp_extract("url", "//([^/]*)", 1))).otherwise("/d~x")
    absolute = F.when(i % 2 == 0, F.concat(F.lit("/"), name)).otherwise(name)
    return table(spark, d, "pages").select("page_id", T.join_path(T.expand_home(folder, "/home/me"), name).alias("path"), T.join_path(F.lit("/tmp/"), absolute).alias("absolute"))


@query("SELECT user_id, event_id, coalesce(event_type = lag(event_type) OVER w AND value = lag(value) OVER w, false) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def state_changes(spark, d):
    now, w = F.struct("event_type", "value"), Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("now", now)
    return e.withColumn("before", F.lag("now").over(w)).select("user_id", "event_id", T.same_state(F.col("now"), F.col("before")).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 'a' WHEN p_size > 10 THEN 'b' WHEN p_retailprice > 1200 THEN 'c' END AS selector FROM part")
def usable_selector(spark, d):
    n, price = F.col("p_size"), F.col("p_retailprice")
    size = lambda name, w, h: F.struct(F.lit(name).alias("name"), w.cast("double").alias("width"), h.cast("double").alias("height"))
    elements = F.array(size("a", n - 25, price - 1000), size("b", n - 10, F.lit(1)), size("c", F.lit(1), price - 1200))
    return table(spark, d, "part").select("p_partkey", T.first_usable(elements, "name").alias("selector"))


def _tasks(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(_ASKED).alias("status"))


_ASKED = "CASE event_type WHEN 'view' THEN 'searching' WHEN 'click' THEN 'downloading' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'stopped' ELSE event_type END"
_MAY = " OR ".join(f"(s = '{a}' AND t IN ({', '.join(map(repr, to))}))" for a, to in M.LEGAL.items())


def _machine(task: str, order: str, status: str, source: str) -> str:
    """Events one after another: each task's state goes from row to row."""
    may = _MAY.replace("s =", "w.after =").replace("t IN", "e.status IN")
    return f"""RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {task} ORDER BY {order}, status) AS i FROM (SELECT *, {status} AS status FROM {source})),
w AS (SELECT e.*, '' AS before, 'ready' AS after, false AS rejected, 0 AS k FROM e WHERE i = 1
UNION ALL SELECT e.*, w.after, CASE WHEN {may} THEN e.status ELSE w.after END, NOT coalesce({may}, false), w.k + 1 FROM w JOIN e ON e.{task} = w.{task} AND e.i = w.k + 1)"""


@query(f"WITH {_machine('user_id', 'ts, event_id', _ASKED, 'events')} SELECT user_id, arg_max(after, k) AS state, CAST(count(*) FILTER (rejected) AS BIGINT) AS n_rejected FROM w GROUP BY 1")
def task_machine(spark, d):
    return M.final_states(_tasks(spark, d), "user_id", ["ts", "event_id"], "status")


@query(f"WITH {_machine('user_id', 'ts, event_id', _ASKED, 'events')} SELECT user_id, event_id, before, after, rejected FROM w WHERE k > 0")
def task_transitions(spark, d):
    return M.transitions(_tasks(spark, d), "user_id", ["ts", "event_id"], "status").select("user_id", "event_id", "before", "after", "rejected")


# Conversations as tasks: what a turn asks for follows from who speaks and how long, so that most steps are legal and some are not.
_SPOKEN = "CASE WHEN role = 'user' THEN 'searching' WHEN length(text) % 7 = 0 THEN 'success' WHEN length(text) % 11 = 0 THEN 'error' ELSE 'downloading' END"


@query(f"WITH {_machine('conv_id', 'turn', _SPOKEN, 'conversations')} SELECT conv_id, turn, before, after, rejected FROM w WHERE k > 0")
def conversation_states(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_SPOKEN).alias("status"))
    return M.transitions(rows, "conv_id", ["turn"], "status").select("conv_id", "turn", "before", "after", "rejected")


# Messages of tasks: conversations have no times, so that of a message is a second of January 2024 by its numbers.
_SECOND = "(conv_id * 7919 + turn * 61) % 2592000"
_MESSAGES = f"m AS (SELECT DISTINCT conv_id, turn, conv_id % 150 AS user_id, make_timestamp(2024, 1, 1, 0, 0, 0) + INTERVAL 1 SECOND * CAST({_SECOND} AS INTEGER) AS ts FROM conversations)"


def _messages(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    return m.withColumn("user_id", F.col("conv_id") % 150).withColumn("ts", F.timestamp_seconds(F.expr(f"unix_timestamp(timestamp '2024-01-01 00:00:00') + {_SECOND}")).cast("timestamp_ntz"))


@query(f"""WITH {_MESSAGES}, e AS (SELECT user_id, ts, max({_ASKED}) AS status FROM events GROUP BY ALL)
SELECT m.conv_id, m.turn, m.user_id, e.status FROM m ASOF LEFT JOIN e ON m.user_id = e.user_id AND m.ts >= e.ts""")
def state_at_message(spark, d):
    states = _tasks(spark, d).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "status")
    return A.as_of(_messages(spark, d), states, "user_id", "ts", "status").select("conv_id", "turn", "user_id", "status")


@query(f"""WITH {_MESSAGES}, r AS (SELECT event_id, user_id % 100 AS team, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events WHERE event_type = 'purchase')
SELECT m.conv_id, m.turn, r.event_id FROM m JOIN r ON m.user_id % 100 = r.team AND r.s <= epoch_us(m.ts) AND epoch_us(m.ts) < r.e""")
def messages_in_runs(spark, d):
    """A run lasts as many minutes from its event as the event's value says; messages meet the runs of their team."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    points = _messages(spark, d).select("conv_id", "turn", (F.col("user_id") % 100).alias("team"), micros("ts").alias("at"))
    runs = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 100).alias("team"), micros("ts").alias("s"), (micros("ts") + F.floor(F.col("value") * 60) * 1_000_000).alias("e"))
    return A.inside_intervals(points, runs, "team", "at", "s", "e").select("conv_id", "turn", "event_id")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts FROM events WHERE event_type = 'click')
SELECT event_id, b.ts AS loaded_at, b.ts IS NULL AS timed_out FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def page_loads(spark, d):
    e = table(spark, d, "events")
    asked = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("asked_at"), "event_id")
    loaded = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("loaded_at"))
    return K.page_loads(asked, loaded, ["user_id"], "6 hours").select("event_id", "loaded_at", "timed_out")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, k""")
def task_sessions(spark, d):
    return K.sessions(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", gap="12 hours")


@query(f"""WITH {_LINKS}, h AS (SELECT CAST(item_id AS VARCHAR) AS id FROM benchmark)
SELECT keyword, count(DISTINCT id) AS n_seen, count(DISTINCT id) FILTER (id IN (SELECT id FROM h)) AS n_held, count(DISTINCT id) FILTER (id NOT IN (SELECT id FROM h)) AS n_new FROM links GROUP BY 1""")
def seen_summaries(spark, d):
    """Lists of seven days put together; as in SQL, nothing is known to be new beside a held id that is null."""
    days = Z.listed(_hits(spark, d).withColumn("day", F.col("page_id") % 7), ["keyword", "day"])
    held = _held(spark, d)
    unknown = held.agg(F.coalesce(F.bool_or(F.col("id").isNull()), F.lit(False))).scalar()
    counts = Z.compared(Z.listed(days, ["keyword"]), held, ["keyword"])
    return counts.select("keyword", "n_seen", "n_held", F.when(unknown, 0).otherwise(F.col("n_new")).alias("n_new"))


@query("SELECT conv_id, turn, role, text, CASE WHEN turn % 5 = 3 THEN 'fallback' ELSE 'sink' || CAST(turn % 5 AS VARCHAR) END AS sink FROM conversations")
def drained(spark, d):
    """The table as a stream of messages, drained into a folder for each sink, and what lies there then."""
    rows = table(spark, d, "conversations")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/conversations.parquet*").withColumn("thread", F.col("turn") % 5)
    registry = spark.range(5).where("id <> 3").select(F.col("id").alias("thread"), F.concat(F.lit("sink"), F.col("id").cast("string")).alias("sink"))
    at = f"{shared_dir(spark)}/tidemill/drained-{uuid.uuid4().hex}"
    E.drain(stream, registry, "thread", "fallback", f"{at}/out", f"{at}/checkpoint", every=None).awaitTermination()
    return spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, thread long, sink string").json(f"{at}/out").select("conv_id", "turn", "role", "text", "sink")


# Sources in turn: each takes the texts that no earlier one has, page by page, up to the first page without a new one.
_SOURCES = tuple(f"src{i}" for i in range(20))
_MOST, _ALL = 10_000_000, 1 << 30
_TEXTS = ["h AS MATERIALIZED (SELECT source AS keyword, CAST(doc_id // 500 AS INTEGER) AS page, doc_id AS pos, md5(text) AS id FROM documents WHERE text IS NOT NULL)", "pn AS MATERIALIZED (SELECT DISTINCT keyword, page FROM h)"]


@query(_turns(_SOURCES, _TEXTS, "SELECT md5(text) FROM benchmark WHERE text IS NOT NULL", _MOST))
def source_turns(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    hits = docs.select(F.col("source").alias("keyword"), F.expr("cast(doc_id div 500 as int)").alias("page"), F.col("doc_id").alias("pos"), F.md5(F.col("text").cast("binary")).alias("id"))
    held = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("id"))
    turns = spark.createDataFrame(list(enumerate(_SOURCES)), "turn long, keyword string")
    return U.in_turn(hits.select("keyword", "page"), hits, held, turns, _MOST, _ALL).select("keyword", F.col("page").cast("int").alias("page"), "pos", "id", "n")

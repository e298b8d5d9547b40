"""Sources: URL lists, keyword lists, item lists, held names, stored pages and ordered chunks."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import id_from_name, none_if_empty, strip
from tidemill.sources import archive

# White space in markup, and what holds no anchors although it may look so.
BLANK = r"\t\n\f\r "
HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<script[{BLANK}/>].*?(?:</script[{BLANK}/>]|\z)|<style[{BLANK}/>].*?(?:</style[{BLANK}/>]|\z)"
#: Where an anchor begins; its attributes and its text, up to the next anchor's beginning, come behind it.
ANCHOR = rf"<[aA][{BLANK}/]"
ANCHOR_END = rf"</[aA](?:[{BLANK}/][^>]*+)?+>"
#: One attribute with its value, quoted or not. Possessive throughout: what has been read is not read again, however long the tag.
ATTRIBUTE = rf"""[^{BLANK}/>=]++(?:[{BLANK}]*+=[{BLANK}]*+(?:"[^"]*+"|'[^']*+'|[^{BLANK}>"'][^{BLANK}>]*+|(?=>)))?+"""
TAG_END = rf"^(?:[{BLANK}/]*+{ATTRIBUTE})*+[{BLANK}/]*+>"


def urls_from_lines(lines: DataFrame, line: str = "line", ordinal: str = "line_no") -> DataFrame:
    """(line_no, url): blank lines and comments dropped, the first URL of a line, else the whole line."""
    v = strip(F.col(line))
    return lines.select(ordinal, v.alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#")).select(ordinal, F.coalesce(none_if_empty(F.regexp_extract("v", r"https?://\S+", 0)), F.col("v")).alias("url"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """A URL list file, in its order within each file. A missing file is an error."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    return urls_from_lines(lines, "value")


def keywords(text: Column, commas: bool = True) -> Column:
    """Non-blank keywords of a text, parted by newlines and (on request) commas, in order, repeats kept."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit(","), F.lit("\n")) if commas else text, "\n"), strip), lambda k: k != "")


def pasted(rows: DataFrame, text: str = "text", ordinal: str = "ord", limit: int = 10) -> DataFrame:
    """(ordinal, pos, keyword, lim): one keyword a line, each with the default limit."""
    return rows.select(ordinal, F.posexplode(keywords(F.col(text), commas=False)).alias("pos", "keyword")).withColumn("lim", F.lit(limit))


def items(rows: DataFrame, raw: str = "raw", url: str = "doc_url", ordinal: str = "ord") -> DataFrame:
    """Items that are a mapping with a URL (as it is) or a non-blank text (stripped)."""
    return rows.select(ordinal, F.coalesce(none_if_empty(F.col(url)), none_if_empty(strip(F.col(raw)))).alias("url")).where("url IS NOT NULL")


def held_ids(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ids that file names carry."""
    return names.where(F.col(name).endswith(".pdf")).select(id_from_name(F.col(name)).alias("id")).where("id IS NOT NULL").distinct()


def held_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size) of the files of a folder, empty files too; no rows where it is missing. Tasks list it, see ``archive``."""
    archive.register(spark)
    return spark.read.format("stored_files").option("content", "false").load(folder).where("folder = '' AND archive IS NULL").select("name", "size")


def attribute(tag: Column, name: str) -> Column:
    """The value of a start tag's first attribute of that name, in any case; empty where it has none, null without the attribute.

    Attributes are read in turn, so what stands in the value of another one is not seen.
    """
    return value_of(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), name)


def value_of(attributes: Column, name: str) -> Column:
    """The value of the first of some attributes (as they stand in a tag) that has the name."""
    blank = F.lit("\t\n\f\r ")
    own = F.try_element_at(F.filter(attributes, lambda a: F.lower(F.btrim(F.substring_index(a, "=", 1), blank)) == name), F.lit(1))
    raw = F.btrim(F.substring(own, F.length(F.substring_index(own, "=", 1)) + 2, 1 << 30), blank)
    quoted = raw.startswith('"') | raw.startswith("'")
    return unescaped(F.when(quoted, F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw))


def _named() -> Column:
    """The named characters of the standard library's table, as one literal map."""
    return F.create_map(*(F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))))


def unescaped(c: Column) -> Column:
    """Named and numeric character references decoded once, from left to right; others stay as they are.

    A reference ends in a semicolon. Numbers that are no character become the replacement character.
    """

    def piece(x: Column, i: Column) -> Column:
        number = F.regexp_extract(x, "^#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", 0)
        digits = F.substring(number, 2, F.length(number) - 2)
        point = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("long")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        character = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")
        name = F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]{1,7});", 1)
        named = F.when(name != "", F.try_element_at(_named(), name))
        decoded = F.when(number != "", F.concat(character, F.substring(x, F.length(number) + 1, 1 << 30))).when(named.isNotNull(), F.concat(named, F.substring(x, F.length(name) + 2, 1 << 30))).otherwise(F.concat(F.lit("&"), x))
        return F.when(i == 0, x).otherwise(decoded)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), piece), "")).otherwise(c)


def anchors(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """(keys, pos, href, text, title) of every anchor with a link, in document order; pos counts all anchors.

    Text is that of the anchor without tags, up to its end (in any case) or the next anchor. Comments, scripts and styles hold no
    anchors. A tag that does not end, or has an equals sign without a name, has no attributes. Each part of a page is read
    once, without recursion, so time is linear in the page and the stack stays flat however its tags are broken.
    """
    shown = F.regexp_replace(html, HIDDEN, "")
    parts = pages.select(*keys, F.posexplode(F.slice(F.split(shown, ANCHOR), 2, 1 << 30)).alias("pos", "part_"))
    tags = parts.withColumn("tag_", F.regexp_extract("part_", TAG_END, 0))
    tags = tags.withColumn("attributes_", F.regexp_extract_all("tag_", F.lit(ATTRIBUTE), F.lit(0)))
    inner = F.split(F.substring("part_", F.length("tag_") + 1, 1 << 30), ANCHOR_END, 2)[0]
    text = unescaped(F.regexp_replace(inner, "<[^>]*>", ""))
    return tags.select(*keys, "pos", value_of(F.col("attributes_"), "href").alias("href"), strip(text).alias("text"), value_of(F.col("attributes_"), "title").alias("title")).where("href IS NOT NULL")


def joined_chunks(chunks: DataFrame, key: str, seq: str = "seq", data: str = "data") -> DataFrame:
    """The texts of ordered chunks put together."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, data))), lambda c: c[data]), "").alias("content"))

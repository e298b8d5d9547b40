"""Scalar text rules of the link catalogue as Spark expressions: names, slugs, URLs and numbers. No Python functions run on rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names may not hold, and the parts of a document link.
ILLEGAL = r'[\\/*?:"<>|]'
DOCUMENT_ID = r"/(?:document|doc)/(\d+)"
# White space in Unicode, and the four separators that also count.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The lines and the badge that tell of a task.
PROGRESS_LINE, PROGRESS_BADGE = "Mengunduh %d/%d (Sukses: %d)", "UNDUH (%d/%d)"
DONE_LINE, STOPPED_LINE = "Selesai! %d PDF tersimpan", "Dihentikan oleh pengguna."


@dataclass(frozen=True)
class LinkPattern:
    """Where ids and slugs stand in a link, and how canonical links are built. ``host`` is a regular expression."""

    host: str = r"[^/?#]+"
    kinds: str = "document|doc"
    prefix: str = "https://www.example.org/document"

    @property
    def any_scheme(self) -> str:
        return rf"https?://(?:www\.)?{self.host}/(?:{self.kinds})/(\d+)"

    @property
    def link(self) -> str:
        return rf"https://www\.{self.host}/(?:{self.kinds})/(\d+)(?:/([^/?#]+))?"


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end, in time linear in the text."""
    return F.btrim(c, F.lit(WHITE))


def content_url(url: Column, pattern: LinkPattern, prefix: str, suffix: str) -> Column:
    """The content link for a document link, else null."""
    found = F.regexp_extract(url, pattern.any_scheme, 1)
    return F.when(found != "", F.concat(F.lit(prefix), found, F.lit(suffix)))


def url_path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.substring_index(path, "/", -1)
    return F.concat(F.left(path, F.length(path) - F.length(last)), F.substring_index(last, ";", 1))


def percent_decode(c: Column) -> Column:
    """Valid escapes decoded, malformed ones and plus signs kept; bytes that are no UTF-8 become the replacement character."""
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(whole)


def safe_filename(url: Column, id_pattern: str = DOCUMENT_ID, fallback: str = "document", extension: str = ".pdf") -> Column:
    """Last path segment, decoded and cleaned, with ``_id`` unless it ends in the id already."""
    segment = F.substring_index(F.rtrim(url_path(url), F.lit("/")), "/", -1)
    name = strip(F.regexp_replace(percent_decode(F.coalesce(none_if_empty(segment), F.lit(fallback))), ILLEGAL, ""))
    name = F.coalesce(none_if_empty(name), F.lit(fallback))
    found = F.regexp_extract(url, id_pattern, 1)
    return F.concat(F.when((found != "") & ~name.endswith(found), F.concat_ws("_", name, found)).otherwise(name), F.lit(extension))


def id_from_name(name: Column) -> Column:
    """Digits behind the last underscore, or the whole stem, of a ``.pdf`` name; else null."""
    return F.coalesce(none_if_empty(F.regexp_extract(name, r"_(\d+)\.pdf$", 1)), none_if_empty(F.regexp_extract(name, r"^(\d+)\.pdf$", 1)))


def slug(c: Column, lower: bool = True, fallback: str | Column | None = None) -> Column:
    """Letters, digits, ``_`` and ``-`` kept, all else ``_``, none at the ends."""
    out = F.btrim(F.regexp_replace(F.lower(c) if lower else c, r"[^\p{L}\p{N}_\-]", "_"), F.lit("_"))
    return out if fallback is None else F.coalesce(none_if_empty(out), F.lit(fallback) if isinstance(fallback, str) else fallback)


def query_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(keyword: Column, page: Column, base: str) -> Column:
    return F.concat(F.lit(f"{base}?query="), query_encode(keyword), F.lit("&page="), page.cast("string"))


def canonical_url(prefix: str, doc: Column, slug_: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), doc, none_if_empty(slug_))


def title(text: Column, attribute: Column, slug_: Column, doc: Column) -> Column:
    """Link text, else title attribute, else slug with spaces, else a name from the id."""
    return F.coalesce(none_if_empty(strip(text)), none_if_empty(attribute), none_if_empty(F.replace(slug_, F.lit("-"), F.lit(" "))), F.concat(F.lit("Document "), doc))


def mask_home(path: Column, home: str) -> Column:
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def expand_home(path: Column, home: str) -> Column:
    """With the home folder in place of a leading ``~``."""
    return F.when((path == "~") | path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)


def join_path(folder: Column, name: Column) -> Column:
    """A name within a folder; an absolute name stands for itself, an empty folder adds nothing."""
    inside = F.when((folder == "") | folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))
    return F.when(name.startswith("/"), name).otherwise(inside)


def same_state(one: Column, other: Column) -> Column:
    """Whether two structs are the same as JSON text; null counts as a state."""
    return F.to_json(one).eqNullSafe(F.to_json(other))


def first_usable(elements: Column, value: str) -> Column:
    """``value`` of the first element (a struct with width and height) with both sides positive, else null."""
    return F.try_element_at(F.filter(elements, lambda e: (e["width"] > 0) & (e["height"] > 0)), F.lit(1)).getField(value)


def delay_range(low: Column, high: Column) -> tuple[Column, Column]:
    """Swapped where they are the wrong way round."""
    return F.least(low, high), F.greatest(low, high)


def delay_range_typed(low: Column, high: Column, defaults: tuple[float, float] = (1.0, 5.0)) -> tuple[Column, Column]:
    """From typed text: at least 0.5, the upper no less than the lower; one bad value resets both."""
    a, b = low.try_cast("double"), high.try_cast("double")
    bad = a.isNull() | b.isNull()
    first = F.greatest(F.lit(0.5), a)
    return F.when(bad, defaults[0]).otherwise(first), F.when(bad, defaults[1]).otherwise(F.greatest(first, b))


def limit_typed(c: Column, default: int = 10) -> Column:
    return F.greatest(F.lit(1), F.coalesce(strip(c).try_cast("int"), F.lit(default)))


def limit_menu(c: Column, default: int = 5) -> Column:
    """Digits above 0, else the default."""
    v = strip(c)
    n = v.try_cast("int")
    return F.when(v.rlike(r"^[0-9]+$") & (n > 0), n).otherwise(F.lit(default))


def page_cap(limit: Column) -> Column:
    return F.greatest(F.lit(10), F.floor((limit + 39) / 40).cast("int") + 5)


def inches(pixels: Column) -> Column:
    return F.ceil(pixels) / F.lit(96.0)


def paper_inches(pixels: Column, default: float) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), F.round(pixels / 96.0, 3)), F.lit(default))


def batches(n: Column, size: int) -> Column:
    return F.ceil(n / size)


def document_timeout(n: Column, size: int = 8, page_timeout: int = 120) -> Column:
    """Seconds for a whole document: a page's time for each batch, for one batch at least."""
    return F.greatest(F.lit(1).cast("long"), batches(n, size)) * page_timeout


def milliseconds(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")


def progress(done: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(done, total), F.lit(0.0))


def page_name(n: Column) -> Column:
    return F.format_string("page-%08d.pdf", n)


def tab_name(keyword: Column, task: Column, clash: Column) -> Column:
    short = strip(F.substring(strip(keyword), 1, 24))
    return F.when(clash, F.concat(short, F.lit(" ("), task, F.lit(")"))).otherwise(short)


def truthy(c: Column) -> Column:
    """Configuration text as boolean."""
    return ~F.lower(strip(c)).isin("0", "false", "no")


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def progress_line(done: Column, total: Column, success: Column) -> Column:
    return F.format_string(PROGRESS_LINE, done, total, success)


def progress_badge(done: Column, total: Column) -> Column:
    return F.format_string(PROGRESS_BADGE, done, total)


def closing_line(stopped: Column, success: Column) -> Column:
    return F.when(stopped, STOPPED_LINE).otherwise(F.format_string(DONE_LINE, success))


def head(values: Column, n: int = 12) -> Column:
    return F.slice(values, 1, n)

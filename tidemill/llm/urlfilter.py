"""URL filter by a sorted digest array.

Rules (host, path prefix) are kept as a file: their 64-bit xxhash keys in order, then offsets, verdicts and the full rule
strings. Executors memory-map the file, probe it by vectorised binary search with every host suffix joined to every
path prefix whose length some rule has, and compare the stored string of a hit, so that a collision cannot decide.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule string wins, of equally
long ones that with the longer host. Without a rule the verdict is ``default``. A null url, or one without ``://``, has
empty host and path. Every row gives one row, an empty table none; other columns may have any names. The rule list is bounded by ``max_rules``, as each executor holds a copy.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ship, table

MAX_RULES = 50_000_000
_sent: set[str] = set()
# The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def write_rules(rules: Iterable[tuple[str, str, str]], path: Path, max_rules: int = MAX_RULES) -> tuple[list[int], int]:
    """Write the digest file; returns the path lengths that occur and the most labels of a host. Of rules with one string
    the last counts."""
    by = {host.lower() + prefix: (verdict == "allow", host.count(".") + 1, len(prefix)) for verdict, host, prefix in rules}
    if len(by) > max_rules:
        raise ValueError(f"{len(by)} rules; at most {max_rules} fit an executor")
    keys = np.fromiter((xxhash.xxh64_intdigest(s) for s in by), np.uint64, len(by))
    order = np.argsort(keys, kind="stable")
    names = list(by)
    raw = [names[i].encode() for i in order]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.uint64))).astype(np.uint64)
    with path.open("wb") as f:
        f.write(np.array([len(by)], np.uint64).tobytes() + keys[order].tobytes() + offsets.tobytes())
        f.write(bytes(by[names[i]][0] for i in order) + b"".join(raw))
    return sorted({v[2] for v in by.values()}), max((v[1] for v in by.values()), default=0)


class Digests:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.uint64)[0])
        self.keys = raw[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.allow = raw[16 + 16 * n : 16 + 17 * n]
        self.blob = raw[16 + 17 * n :]

    def probe(self, strings: list[str], keys: np.ndarray) -> np.ndarray:
        """1 allow, 0 block, -1 absent, for each string."""
        out = np.full(len(strings), -1, np.int8)
        if not len(self.keys) or not len(keys):
            return out
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j, want = int(at[i]), strings[i].encode()
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.blob[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == want:
                    out[i] = self.allow[j]
                    break
                j += 1
        return out


_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of each row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    folder = Path(tempfile.mkdtemp(prefix="tidemill-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    lengths, labels = write_rules(rules, folder / "rules", max_rules)
    with (folder / "rules").open("rb") as f:
        name = f"rules-{hashlib.file_digest(f, 'sha256').hexdigest()[:24]}-{spark.sparkContext.applicationId}.bin"
    if name not in _sent:
        spark.sparkContext.addFile(str((folder / "rules").rename(folder / name)))
        _sent.add(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for b in batches:
            parts = [(h.translate(_ASCII_LOWER), p) for h, p in map(split, b.column(1).to_pylist())]
            strings, owner = [], []
            for i, (host, path) in enumerate(parts):
                # Suffixes from the shortest on, none with more labels than a rule's host has.
                at, suffixes = len(host) if host else -1, []
                while at >= 0 and len(suffixes) < labels:
                    at = host.rfind(".", 0, at)
                    suffixes.append(host[at + 1 :])
                # Longest string first, then longest host; so the first hit decides.
                own = sorted(((len(s) + n, len(s), s + path[:n]) for s in suffixes for n in lengths if n <= len(path)), reverse=True)
                strings += [x[2] for x in own]
                owner += [i] * len(own)
            hit = digests.probe(strings, np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings)))
            rule, verdict = [None] * len(parts), [default] * len(parts)
            for j in np.flatnonzero(hit >= 0):
                if rule[owner[j]] is None:
                    rule[owner[j]], verdict[owner[j]] = strings[j], "allow" if hit[j] else "block"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key), F.col(url).cast("string")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


# The same rules in SQL, the longest first.
OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
  WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

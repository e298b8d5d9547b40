"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over each whole text: at-signs, plus signs, digits, schemes and
identifier cues. A deterministic parser for each kind expands an anchor to its boundaries and validates it.

Base kinds are leftmost and do not overlap within a kind: ``email``, ``ip``, ``card`` (16 to 19 digits passing Luhn)
and ``phone`` (8 to 15 digits). A run of characters that fails validation is used up and not tried again. The method
adds ``userinfo`` (name and password in a URL), ``mailto``, ``ssn``, ``iban`` and ``account`` (an identifier behind a cue),
and ``secret`` (a key or token of 16 characters or more, letters and digits mixed, behind a cue). Each parser reads a bounded stretch, or
none that an earlier anchor of its kind has read (no cue for a secret stands within a secret), so time is linear in the text.

Nulls and empty texts give no spans. Every input row gives one row, repeated rows too. Columns besides ``doc_id`` and
``text`` are not read, whatever their names. An empty table gives no rows. Memory is bounded by one Arrow batch and the spans of one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import release, ship, spread, texts

# Kinds in the order of the digest, patterns and cue words.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "mailto", "ssn", "iban", "account", "secret")
SECRETS = ("api key", "api_key", "api-key", "apikey", "token", "secret", "password", "bearer", "access key", "access_key")
CUES = ("ssn", "social security", "iban", "account", "acct", "passport", "routing", "a/c")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:]++:[^\s/@]++@(?=[A-Za-z0-9])")
_MAILTO = re.compile(r"[^\s@?<>\"']++")
_SSN = re.compile(r"[\s:#]{0,12}(?:number|no\.?)?[\s:#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
_IBAN = re.compile(r"[\s:#]{0,12}(?:number|no\.?)?[\s:#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\s:#]{0,4}(?:number|no\.?|num|id)?[\s:#=]{1,4}([A-Z]{0,2}[0-9][0-9-]{5,18}[0-9])(?![0-9A-Za-z-])", re.I)
_SECRET = re.compile(r"[\"']?(?:\s{0,4}[:=]\s{0,4}|\s{1,4})[\"']?([A-Za-z0-9_./+-]{16,}+)")

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word("mailto:", ("mailto", len("mailto:")))
    for w in CUES:
        a.add_word(w, ("cue", len(w)))
    for w in SECRETS:
        a.add_word(w, ("secret", len(w)))
    a.make_automaton()
    return a


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """Around an at-sign; ``free`` is where the last email ended."""
    s = at
    while s > free and text[s - 1] in _LOCAL:
        s -= 1
    m = _DOMAIN.match(text, at + 1) if s < at else None
    return (s, m.end()) if m else None


def _ips(text: str, s: int) -> tuple[list[tuple[int, int]], int]:
    """Of the dotted chain of digit runs that begins at ``s``: groups of four from the left; where the chain ends."""
    out, runs, p = [], [], s
    while m := _DIGITS.match(text, p):
        runs.append((p, m.end()))
        p = m.end()
        if len(runs) == 4:
            if all(len(v := text[b:e].lstrip("0")) <= 3 and int(v or 0) <= 255 for b, e in runs):
                out.append((runs[0][0], p))
            runs = []
        if text[p : p + 1] != ".":
            break
        p += 1
    return out, p


def _mailto(text: str, s: int) -> tuple[tuple[int, int] | None, int]:
    """The address that begins at ``s``, if any, and how far the text has been read: no later anchor before that counts."""
    if not (name := _MAILTO.match(text, s)):
        return None, s
    at = name.end()
    host = _MAILTO.match(text, at + 1) if text[at : at + 1] == "@" else None
    return ((s, host.end()), host.end()) if host else (None, at)


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in code points, end exclusive. Anchors are found in any ASCII case."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = ip_end = card_end = phone_end = mailto_end = 0
    for last, (kind, n) in automaton.iter(low):
        at, after = last - n + 1, last + 1
        if kind == "digit":
            if at >= ip_end:
                found, ip_end = _ips(text, at)
                out["ip"] += found
            if at >= card_end:
                card_end = _CHAIN.match(text, at).end()
                digits = re.sub("[ -]", "", text[at:card_end]) if card_end - at >= 16 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, card_end))
        elif kind == "at":
            if span := _email(text, at, mail_end):
                out["email"].append(span)
                mail_end = span[1]
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, after)):
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append((at, phone_end))
        elif kind == "scheme":
            if m := _USERINFO.match(text, after):
                out["userinfo"].append((after, m.end() - 1))
        elif kind == "mailto":
            if after >= mailto_end:
                span, mailto_end = _mailto(text, after)
                if span:
                    out["mailto"].append(span)
        elif kind == "secret":
            if not text[at - 1 : at].isalnum() and (m := _SECRET.match(text, after)) and any(map(str.isdigit, m[1])) and any(map(str.isalpha, m[1])):
                out["secret"].append(m.span(1))
        elif not text[at - 1 : at].isalnum():
            for name, pattern, ok in (("ssn", _SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9"), ("iban", _IBAN, _iban_ok), ("account", _ACCOUNT, lambda s: sum(c.isdigit() for c in s) >= 6)):
                if (m := pattern.match(text, after)) and ok(m[1]):
                    if not out[name] or m.start(1) >= out[name][-1][1]:
                        out[name].append(m.span(1))
                    break
    return out


def digest(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in sorted(found[k]))


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """Replace spans by their kind in brackets; of overlapping spans the union takes the first one's kind."""
    out, done = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in found[k]):
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def scan(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans and (on request) the redacted text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        automaton = anchors()
        for b in batches:
            rows = {n.split()[0]: [] for n in SCHEMA.split(", ")}
            for text in b.column(1).to_pylist():
                found = find(text, automaton)
                for k in BASE:
                    rows[f"n_{k}"].append(len(found[k]))
                rows["base_sha256"].append(hashlib.sha256(digest(found, BASE).encode()).hexdigest())
                rows["spans"].append(digest(found, KINDS))
                rows["redacted"].append(redact(text, found) if with_text else None)
            rows["doc_id"] = b.column(0)
            types = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([rows[n.split()[0]] if n.startswith("doc_id") else pa.array(rows[n.split()[0]], types[n.split()[1]]) for n in SCHEMA.split(", ")], [n.split()[0] for n in SCHEMA.split(", ")])

    return spread(texts(docs)).mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The same columns with every span in ``text`` replaced; ``n_chars``, where there is one, follows. Null texts stay null."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        automaton = anchors()
        for b in batches:
            i = names.index("text")
            new = [t if t is None else redact(t, find(t, automaton)) for t in b.column(i).to_pylist()]
            cols = list(b.columns)
            cols[i] = pa.array(new, b.schema.field(i).type)
            if "n_chars" in names:
                j = names.index("n_chars")
                cols[j] = pa.array([old if t is None else len(t) for t, old in zip(new, b.column(j).to_pylist(), strict=True)], b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return spread(docs).mapInArrow(run, docs.schema)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    from tidemill.llm.common import table

    return scan(table(spark, sf_dir, "documents"), with_text=False).drop("redacted")

"""Token ids and counts of whole texts, exactly as the tokenizer library gives them.

``Encoder`` parts texts where the tokenizer always parts them: at ASCII white space, which it drops, and between ASCII
letters or digits and punctuation (behind an apostrophe it may not part, so there nothing is parted). ASCII is
lower-cased, as the tokenizer does. Texts with ``<|`` may hold special strings and are only parted at white space. Every
distinct word is encoded once with the library, and the ids of a text are put together from its words'. The word table is
emptied when it holds some ``MAX_BYTES``; words of over ``LONGEST`` characters, as in texts without blanks, are encoded
each time and never kept.

Texts of over ``HUGE`` characters take *overlap resynchronisation* (``resync``): overlapping chunks are encoded with
offsets and spliced at a common boundary that is proven stable: both encodings have a token boundary there, it stands
behind white space, and they agree on the tokens around it, in id and place. Where no such boundary exists in an overlap,
the overlap is widened, in the end to all that is not yet spliced (a text without white space is so encoded whole).

Nulls count as empty texts (0 tokens). Every row gives one row. Columns besides doc_id and text are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import words as W
from tidemill.llm.common import kept, ship, spread, table, texts

TOKENIZER = "word_bpe_49k.json"
#: Bytes of the word table, by estimate, and characters of the longest word in it.
MAX_BYTES, LONGEST = 128 << 20, 64
#: Bytes of text whose words are looked up at once.
STEP = 8 << 20
#: Characters: texts above HUGE take overlap resynchronisation with these chunks and first overlaps.
HUGE, CHUNK, OVERLAP = 16_384, 8_192, 256
#: Tokens that must agree on each side of a splice.
AGREE = 4

#: Letters that Unicode normalisation and lower-casing leave alone or treat one by one: ASCII and Latin-1.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: White space that the tokenizer drops and that always parts pre-tokens.
BLANK = " \t\n\r\x0b\x0c"
# Kinds of bytes: letters and digits, apostrophe, other punctuation, and all else.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[ord("'")] = 2
_KIND[np.array([c for c in range(128) if chr(c).isalnum()])] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def parted(text: pa.Array) -> pa.Array:
    """Texts with ASCII in lower case and blanks where letters or digits meet punctuation; null and texts with ``<|`` as they are."""
    text = text.cast(pa.large_string()).fill_null("")
    special = pc.match_substring(text, "<|")
    _, off, data = text.buffers()
    if not len(text) or data is None:
        return text
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = _LOWER[np.frombuffer(data, np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    kind = _KIND[buf]
    left, right = kind[:-1], kind[1:]
    at = np.flatnonzero(((left == 1) & (right > 1)) | ((left == 3) & (right == 1))) + 1
    buf = np.insert(buf, at, 0x20)
    made = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(off + np.searchsorted(at, off, "left")), pa.py_buffer(buf))
    return pc.if_else(special, text, made) if pc.any(special).as_py() else made


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 characters for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + more)
            more += 1
    return out


class Encoder:
    def __init__(self, path: str, max_bytes: int = MAX_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.max_bytes, self.bytes = max_bytes, 0
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers. Plain lower-case letters are one pre-token for the model."""
        if len(word) <= LONGEST and _PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            self.bytes += 220 + 4 * len(word) + len(out)
            if self.bytes > self.max_bytes:
                self.known.clear()
                self.bytes = 0
            self.known[word] = out
        return out

    def split(self, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """For some rows at a time: number of words in each row, entry of each word, ids of each entry."""
        for lo, hi, _, _ in W.steps(text, STEP):
            part = pc.ascii_split_whitespace(parted(text.slice(lo, hi - lo)))
            sizes = pc.list_value_length(part).to_numpy(zero_copy_only=False)
            flat = part.flatten()
            empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
            if empty.any():
                row = np.repeat(np.arange(len(sizes)), sizes)
                sizes = np.bincount(row[~empty], minlength=len(sizes))
                flat = flat.filter(pa.array(~empty))
            coded = flat.dictionary_encode()
            known, word = self.known.get, self.word
            yield sizes, coded.indices.to_numpy(), [known(w) or word(w) for w in coded.dictionary.to_pylist()]

    def counts(self, text: pa.Array) -> np.ndarray:
        out = []
        for sizes, index, ids in self.split(text):
            n = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
            total = np.concatenate(([0], np.cumsum(n[index])))
            end = np.cumsum(sizes)
            out.append(total[end] - total[end - sizes])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def ids(self, text: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row."""
        for sizes, index, ids in self.split(text):
            end = np.cumsum(sizes)
            for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True):
                yield np.frombuffer(b"".join([ids[i] for i in index[a:b].tolist()]), "<u4")


def encoder_of(tokenizer: str) -> Encoder:
    """One encoder for each Python worker, so that its word table serves all tasks of the worker."""
    return kept(f"encoder {tokenizer}", lambda: Encoder(public_tokenizers.path(tokenizer)))


def stable(text: str, base: int, left, first: int, begin: int, right, end: int, agree: int = AGREE) -> tuple[int, int, int] | None:
    """The last place in text[begin:end] at which two encodings may be spliced: (position, token of left, token of right).

    ``left`` and ``right`` are the library's encodings of the text from ``base`` and from ``begin`` on; tokens of ``left``
    before ``first`` are spliced away already. The position is the start of a token in both, white space stands before it,
    and ``agree`` tokens on either side are equal in id and place.
    """
    a, b = left.ids, right.ids
    for p in range(end - 1, begin, -1):
        if text[p - 1] not in BLANK or text[p] in BLANK:
            continue
        i, j = left.char_to_token(p - base), right.char_to_token(p - begin)
        if i is None or j is None or i - agree < first or j < agree or i + agree > len(a) or j + agree > len(b):
            continue
        if left.token_to_chars(i)[0] + base != p or right.token_to_chars(j)[0] + begin != p or a[i - agree : i + agree] != b[j - agree : j + agree]:
            continue
        places = ((left.token_to_chars(i + d), right.token_to_chars(j + d)) for d in range(-agree, agree))
        if all(x[0] + base == y[0] + begin and x[1] + base == y[1] + begin for x, y in places):
            return p, i, j
    return None


def resync(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> Iterator[list[int]]:
    """Ids of ``text`` in runs, from chunks that overlap. ``encode`` gives the library's encoding, with offsets, of a string.

    A chunk begins and ends anywhere; each begins ``overlap`` before the end of the last one. Only tokens between two
    splices are given out, and one chunk is held at a time.
    """
    n, done, end = len(text), 0, min(len(text), chunk)
    base, held, first = 0, encode(text[:end]), 0  # the tokens of text[done:end] are those of ``held`` from ``first`` on
    while end < n:
        # Where no splice was found the next chunk is as long as all that is held, so that the work stays in proportion.
        stop, wide = min(n, end + max(chunk, end - done - chunk)), overlap
        while True:
            begin = max(done, end - wide)
            right = encode(text[begin:stop])
            splice = stable(text, base, held, first, begin, right, end, agree)
            if splice is not None or begin == done:
                break
            wide *= 4
        if splice is None:  # ``right`` begins at the last splice: it replaces what was held
            base, held, first, end = begin, right, 0, stop
        else:
            done, i, j = splice
            yield held.ids[first:i]
            base, held, first, end = begin, right, j, stop
    yield held.ids[first:]


def encode_with_offsets(tokenizer) -> Callable:
    return lambda text: tokenizer.encode(text, add_special_tokens=False)


def count(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, resynchronised) of each row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        encode = encode_with_offsets(encoder.tokenizer)
        for b in batches:
            text = b.column(1)
            long = pc.greater(pc.utf8_length(text), huge)
            n = encoder.counts(pc.if_else(long, "", text))
            for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                n[i] = sum(map(len, resync(text[int(i)].as_py(), encode, chunk, overlap)))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit), long], ["doc_id", "n_bytes", "n_tokens", "over_limit", "resynchronised"])

    return spread(texts(docs)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, resynchronised boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))

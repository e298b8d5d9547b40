"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. For each language every piece has a probability; the probability of a
word is the sum over all its segmentations into pieces of the product of their probabilities, computed by a forward
algorithm over all languages and all distinct words at once; that of a text is the product over its words.

Training is one step of expectation maximisation over all given rows: expected piece counts over all segmentations (forward
and backward) under the vocabulary's own ranks, added up per language and smoothed. Only text and lang are used.

Words are the runs between ASCII white space without ASCII digits and punctuation at their ends, in lower case; words
without a letter do not count, and words of over ``PART`` characters are segmented in parts of that length, so whole
texts of any length count. A text that is null or has no letter is ``und`` with score 0. Ties go to the language first
in code point order. Rows with null lang or text do not train; without any training row every text is ``und``. Every row
gives one row. Languages are collected to the driver (at most ``MAX_LANGS``), with the vocabulary's size for each. Tables
that have a column for each language are cut by bytes, so that more languages make them shorter and not larger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import words as W
from tidemill.llm.common import kept, release, ship, spread, table, texts

VOCABULARY = "piece_bpe_32k.model"
PART, LONG, MAX_LANGS, UND = 32, 4096, 300, "und"
#: Weight of the vocabulary's own ranks in a language's probabilities, and the probability of a character without a piece.
SMOOTHING, UNKNOWN = 0.05, 1e-9
#: Distinct words that are counted before they go through lattices, words of one lattice, and words whose scores are kept;
#: fewer where a table of them with a column for each language would have more bytes than TABLE_BYTES.
FLUSH, LATTICE, KNOWN, TABLE_BYTES = 200_000, 25_000, 400_000, 32 << 20
#: Bytes of text whose words are made distinct at once.
STEP = 8 << 20
_STRIP = np.array([c < 128 and not chr(c).isalpha() and chr(c).isprintable() and c != 0x20 for c in range(256)])
_K = np.uint64(0x9E3779B97F4A7C15)
_MARK = ord("▁")  # begins a word in the vocabulary


def fitting(most: int, cells: int) -> int:
    """Words of a table with so many 64-bit cells for each, at most ``most``."""
    return max(1, min(most, TABLE_BYTES // (8 * max(1, cells))))


class Pieces:
    """The vocabulary as a hash table over code points."""

    def __init__(self, name: str = VOCABULARY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = sp.get_piece_size()
        ids = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        self.longest = min(max(map(len, pieces)), PART + 1)
        keys = np.array([self.key(np.array([ord(c) for c in p], np.uint64)) for p in pieces], np.uint64)
        bits = max(4, int(4 * len(ids)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        for k, i in zip(keys.tolist(), ids, strict=True):
            j = k >> int(self.shift)
            while self.values[j] >= 0:
                j = (j + 1) % len(self.slots)
            self.slots[j], self.values[j] = k, i
        full = np.concatenate((self.values >= 0, self.values >= 0))
        runs = np.flatnonzero(~full)
        self.probes = int(np.diff(runs).max()) if len(runs) > 1 else len(self.slots)
        rank = np.full(self.size, np.inf)
        rank[ids] = np.arange(len(ids))
        prior = 1.0 / (100.0 + rank)
        self.prior = prior / prior.sum()

    @staticmethod
    def key(points: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in points:
            h = h * _K + c + np.uint64(1)
        return W.mix(h)[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            value = self.values[at]
            hit = (self.slots[at] == keys) & (value >= 0)
            out[left[hit]] = value[hit]
            go = ~hit & (value >= 0)
            if not go.any():
                break
            left, keys, at = left[go], keys[go], (at[go] + 1) % len(self.slots)
        return out


_pieces: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    if name not in _pieces:
        _pieces[name] = Pieces(name)
    return _pieces[name]


class Lattice:
    """All pieces at all places of some words of up to PART characters."""

    def __init__(self, words: list[str], pieces: Pieces):
        # Longest first, so that the words still running at a place are a prefix.
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        self.owner = np.argsort(-self.length, kind="stable")
        self.length = self.length[self.owner]
        text = "".join("▁" + words[i] for i in self.owner.tolist())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1].astype(np.int64)
        room = np.repeat(self.start + self.length, self.length) - np.arange(len(points))
        #: found[k - 1][p]: the piece of k characters at p.
        self.found = []
        h = np.zeros(len(points), np.uint64)
        for k in range(1, pieces.longest + 1):
            ok = np.flatnonzero(room >= k)
            if not len(ok):
                break
            h[ok] = h[ok] * _K + points[ok + k - 1] + np.uint64(1)
            ids = np.full(len(points), -1, np.int32)
            ids[ok] = pieces.find(W.mix(h[ok]))
            self.found.append(ids)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[place, part, language]; ``p`` is (pieces, languages)."""
        n = int(self.length[0]) if len(self.length) else 0
        alpha = np.zeros((n + 1, len(self.length), p.shape[1]))
        alpha[0] = 1.0
        for j in range(1, n + 1):
            live = int(np.searchsorted(-self.length, -j, "right"))
            a = alpha[j]
            for k in range(1, min(j, len(self.found)) + 1):
                at = self.found[k - 1][self.start[:live] + j - k]
                hit = np.flatnonzero(at >= 0)
                a[hit] += alpha[j - k][hit] * p[at[hit]]
                if k == 1:
                    miss = np.flatnonzero(at < 0)
                    a[miss] += alpha[j - 1][miss] * UNKNOWN
        return alpha

    def score(self, p: np.ndarray, n_words: int) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.zeros((n_words, p.shape[1]))
        if len(self.length):
            alpha = self.forward(p)
            np.add.at(out, self.owner, np.log(alpha[self.length, np.arange(len(self.length))]))
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts (pieces, languages) under probabilities ``p`` (pieces) of words that occur ``weight`` (words, languages) times."""
        out = np.zeros((len(p), weight.shape[1]))
        if not len(self.length):
            return out
        alpha = self.forward(p[:, None])[:, :, 0]
        n = int(self.length[0])
        beta = np.zeros_like(alpha)
        beta[self.length, np.arange(len(self.length))] = 1.0
        total = alpha[self.length, np.arange(len(self.length))]
        w = weight[self.owner]
        for j in range(n, 0, -1):
            live = int(np.searchsorted(-self.length, -j, "right"))
            for k in range(1, min(j, len(self.found)) + 1):
                at = self.found[k - 1][self.start[:live] + j - k]
                hit = np.flatnonzero(at >= 0)
                q = p[at[hit]] * beta[j][hit]
                beta[j - k][hit] += q
                g = alpha[j - k][hit] * q / total[hit]
                if w.shape[1] <= 16:
                    for c in range(w.shape[1]):
                        out[:, c] += np.bincount(at[hit], g * w[hit, c], len(p))
                else:  # few of many languages have a word
                    r, c = np.nonzero(w[hit])
                    np.add.at(out, (at[hit][r], c), g[r] * w[hit[r], c])
                if k == 1:
                    miss = np.flatnonzero(at < 0)
                    beta[j - 1][miss] += UNKNOWN * beta[j][miss]
        return out


class LongWords:
    """The pieces that end at each place of some long words, found place by place. Parts run side by side, longest first."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.pieces = pieces
        marked = ["▁" + w for w in words]
        parts = [w[i : i + LONG] for w in marked for i in range(0, len(w), LONG)]
        owner = np.repeat(np.arange(len(words)), [-(-len(w) // LONG) for w in marked])
        order = np.argsort([-len(p) for p in parts], kind="stable")
        self.owner, self.length = owner[order], np.array([len(parts[i]) for i in order], np.int64)
        self.points = np.frombuffer("".join(parts[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1].astype(np.int64)

    def places(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place j, parts still running, pieces ending at j): row s % longest of the pieces has the one that begins at s, -1 for none."""
        longest = self.pieces.longest
        h = np.zeros((longest, len(self.length)), np.uint64)
        for j in range(1, int(self.length[0]) + 1):
            live = int(np.searchsorted(-self.length, -j, "right"))
            h[(j - 1) % longest] = 0
            h[:, :live] = h[:, :live] * _K + self.points[self.start[:live] + j - 1] + np.uint64(1)
            found = self.pieces.find(W.mix(h[:, :live].ravel())).reshape(longest, live)
            if j < longest:
                found[j:] = -1
            yield j, live, found

    def score(self, p: np.ndarray, n_words: int) -> np.ndarray:
        """log probability of each word in each language."""
        longest, k = self.pieces.longest, p.shape[1]
        alpha, shift = np.zeros((longest, len(self.length), k)), np.zeros((len(self.length), k))
        alpha[0], ends = 1.0, np.zeros((len(self.length), k))
        for j, live, found in self.places():
            new = np.zeros((live, k))
            row, part = np.nonzero(found >= 0)
            np.add.at(new, part, alpha[row, part] * p[found[row, part]])
            alone = np.flatnonzero(found[(j - 1) % longest] < 0)
            new[alone] += alpha[(j - 1) % longest, alone] * UNKNOWN
            alpha[j % longest, :live] = new
            done = slice(int(np.searchsorted(-self.length, -j, "left")), live)
            ends[done] = np.log(new[done]) + shift[done]
            if j % 8 == 0:  # long products leave the range of doubles, of each language at its own pace
                top = alpha[:, :live].max(0)
                alpha[:, :live] /= top
                shift[:live] += np.log(top)
        out = np.zeros((n_words, k))
        np.add.at(out, self.owner, ends)
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts (pieces, languages) as :meth:`Lattice.expected` gives them, in logarithms."""
        longest, n, parts = self.pieces.longest, int(self.length[0]), len(self.length)
        with np.errstate(divide="ignore"):
            logp = np.log(np.concatenate((p, [0.0])))  # -1 finds the last: no piece
        alpha, beta = np.full((n + 1, parts), -np.inf), np.full((n + longest + 1, parts), -np.inf)
        alpha[0] = 0.0
        ids = np.full((n + 1, longest, parts), -1, np.int32)  # of the piece of k characters that begins at s: [s, k - 1]
        alone = np.zeros((n + 1, parts), bool)
        for j, live, found in self.places():
            s = np.arange(max(0, j - longest), j)
            step = logp[found[s % longest]]
            ids[s, j - s - 1, :live] = found[s % longest]
            alone[j - 1, :live] = found[(j - 1) % longest] < 0
            step[-1, alone[j - 1, :live]] = np.log(UNKNOWN)
            alpha[j, :live] = np.logaddexp.reduce(alpha[s, :live] + step, axis=0)
        beta[self.length, np.arange(parts)] = 0.0
        total, out = alpha[self.length, np.arange(parts)], np.zeros((len(p), weight.shape[1]))
        w = weight[self.owner]
        for s in range(n - 1, -1, -1):
            step = logp[ids[s]] + beta[s + 1 : s + 1 + longest]
            whole = np.where(alone[s], np.log(UNKNOWN) + beta[s + 1], -np.inf)
            own = np.logaddexp(np.logaddexp.reduce(step, axis=0), whole)
            running = self.length > s
            beta[s, running] = own[running]
            k, part = np.nonzero((ids[s] >= 0) & np.isfinite(step))
            g = np.exp(alpha[s, part] + step[k, part] - total[part])
            r, c = np.nonzero(w[part])
            np.add.at(out, (ids[s, k[r], part[r]], c), g[r] * w[part[r], c])
        return out


def _batches(words: list[str], cells: int) -> Iterator[tuple[type, list[int]]]:
    """Numbers of words to go through one lattice together, with its class; ``cells`` are the 64-bit cells of a character's place."""
    short = [i for i, w in enumerate(words) if len(w) <= PART]
    most = fitting(LATTICE, cells * (PART + 2))
    for i in range(0, len(short), most):
        yield Lattice, short[i : i + most]
    held, parts = [], 0
    for i, w in enumerate(words):
        if len(w) > PART:
            more = -(-(len(w) + 1) // LONG)
            if held and parts + more > max(1, TABLE_BYTES // (8 * LONG * 17)):  # ids of ``expected``, 32 bits for each length of a piece
                yield LongWords, held
                held, parts = [], 0
            held.append(i)
            parts += more
    if held:
        yield LongWords, held


def distinct(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """For some rows at a time: first row, row after the last, row and number of each counted word, the distinct words."""
    for lo, hi, _, _ in W.steps(text, STEP):
        low = pc.utf8_lower(text.slice(lo, hi - lo).cast(pa.large_string()).fill_null(""))
        part = pc.ascii_split_whitespace(_bare(low))
        row = np.repeat(np.arange(hi - lo), pc.list_value_length(part).to_numpy(zero_copy_only=False))
        coded = part.flatten().dictionary_encode()
        letters = pc.utf8_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~letters)  # parted words, digits inside, and the empty word
        letters[other] = pc.match_substring_regex(coded.dictionary.take(pa.array(other)), r"\p{L}").to_numpy(zero_copy_only=False)
        to = np.where(letters, np.cumsum(letters) - 1, -1)
        index = to[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        keep = index >= 0
        yield lo, hi, row[keep], index[keep], coded.dictionary.filter(pa.array(letters)).to_pylist()


def _bare(text: pa.Array) -> pa.Array:
    """Texts with blanks in place of ASCII digits and punctuation at the ends of words."""
    _, off, data = text.buffers()
    if not len(text) or data is None:
        return text
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]].copy()
    off = off - off[0]
    _, start, end = W.spans(buf, off, _STRIP)
    if not len(start):
        return text
    edge = np.zeros(len(buf) + 1, bool)  # in front of these bytes a row begins or ends
    edge[off] = True
    blank = W.SPACE[buf]
    drop = edge[start] | edge[end] | blank[np.maximum(start, 1) - 1] | blank[np.minimum(end, len(buf) - 1)]
    start, size = start[drop], (end - start)[drop]
    buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = 0x20
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(off), pa.py_buffer(buf))


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # (pieces, languages)
    vocabulary: str
    name: str


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """log probability of each word in each language, for at most as many words as are kept over the tasks of a worker."""
    k = len(model.langs)
    most = fitting(KNOWN, k)
    number, table_ = kept(f"scores {model.name}", lambda: ({}, np.zeros((most, k))))
    if len(number) + len(words) > most:
        number.clear()
    at = list(map(number.get, words))
    new = [w for w, i in zip(words, at, strict=True) if i is None]
    for kind, some in _batches(new, k):
        part = [new[i] for i in some]
        table_[len(number) : len(number) + len(part)] = kind(part, pieces_of(model.vocabulary)).score(model.p, len(part))
        for w in part:
            number[w] = len(number)
    return table_[[number[w] if i is None else i for w, i in zip(words, at, strict=True)] if new else at]


def _tally(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below n, sorted, and their numbers."""
    if n * 8 > TABLE_BYTES:
        return np.unique(values, return_counts=True)
    times = np.bincount(values, minlength=n)
    some = np.flatnonzero(times)
    return some, times[some]


def train(docs: DataFrame, vocabulary: str = VOCABULARY, max_langs: int = MAX_LANGS) -> Model:
    """A model from all rows of ``docs`` with text and lang."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs = sorted(r[0] for r in docs.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pieces, k = pieces_of(vocabulary), len(langs)
        total = np.zeros((pieces.size, k))
        number: dict[str, int] = {}
        most = fitting(FLUSH, k)
        weight = np.zeros((most, k))

        def flush() -> None:
            todo = list(number)
            for kind, at in _batches(todo, max(1, k // PART)):
                total[:] += kind([todo[i] for i in at], pieces).expected(pieces.prior, weight[at])
            number.clear()
            weight[:] = 0

        for b in batches:
            lang = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, hi, row, index, words in distinct(b.column(0)):
                pair, times = _tally(index * k + lang[lo:hi][row], len(words) * k)
                for i in range(0, len(words), most):
                    part = words[i : i + most]
                    if len(number) + len(part) > most:
                        flush()
                    at = np.array([number.setdefault(w, len(number)) for w in part], np.int64)
                    here = slice(*np.searchsorted(pair, [i * k, (i + most) * k]))
                    weight[at[pair[here] // k - i], pair[here] % k] += times[here]
        flush()
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    pieces = pieces_of(vocabulary)
    n = np.zeros((pieces.size, len(langs)))
    if langs:
        got = spread(docs).mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary for each language
        n[got["piece"], got["lang"]] = got["n"]
    n = np.round(n, 3)  # the order of summing must not matter
    p = (n / np.maximum(n.sum(0), 1e-9)) * (1 - SMOOTHING) + SMOOTHING * pieces.prior[:, None]
    return Model(langs, p, vocabulary, uuid.uuid4().hex)


def _judge(text: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    labels, scores = [], []
    for lo, hi, row, index, words in distinct(text):
        n, k = hi - lo, len(model.langs)
        total, step = np.zeros((n, k)), fitting(KNOWN, k)
        for i in range(0, len(words), step):
            here = slice(None) if len(words) <= step else (index >= i) & (index < i + step)
            own, at, per = row[here], index[here] - i, word_scores(words[i : i + step], model)
            for c in range(k):
                total[:, c] += np.bincount(own, per[at, c], n)
        some = np.bincount(row, minlength=n) > 0
        if not k:
            labels += [UND] * n
            scores.append(np.zeros(n))
            continue
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        labels += [model.langs[b] if s else UND for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        scores.append(np.where(some, score, 0.0))
    return labels, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the text's probability) of each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = _judge(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return spread(texts(docs)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und`` and with a score of ``least`` or more."""
    spark = docs.sparkSession
    ship(spark)
    shared, names = spark.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = _judge(b.column(names.index("text")), shared.value)
            yield b.filter(pa.array([x != UND and s >= least for x, s in zip(labels, scores.tolist(), strict=True)], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)


def fold(docs: DataFrame) -> DataFrame:
    """With ``held_out``: crc32 of doc_id as text leaves no remainder by 5. A null doc_id counts as the empty text, whose
    crc32 is 0: it is held out and does not train."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fold(table(spark, sf_dir, "documents"))
    model = train(docs.where(~F.col("held_out")))
    return fold(predict(docs, model))

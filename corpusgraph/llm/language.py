"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; the probability of a word
is the sum over all its segmentations into pieces, by the forward algorithm. Words are runs of letters
and marks (Unicode classes L and M) of the lower-cased text, with a blank before.
Training: expectation-maximisation by forward and backward sums over the words of at most SAMPLE_DOCS
labelled documents of each language (those with the smallest hash of id and text; a documented bound).
Words are counted by Spark first, so one language's training holds its distinct words only; words of over
LONG bytes are learnt from in parts, cut between characters.
Scoring: every whole text; each distinct word of a block of texts is scored once for all languages at
once, over all its segmentations at any length. Only the piece table is sent to tasks: its size is the
fixed vocabulary times the languages.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the
alphabetically first language; with no labelled row every text is `und`; repeated rows and null ids
are scored like others, and rows that repeat id and text count once in training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import RANKS
from .common import Spans, read, slices, span_hashes, text_bytes

SAMPLE_DOCS = 400
LONG, ROUNDS, SMOOTHING = 128, 4, 0.05
BLOCK_BYTES, LATTICE = 8 << 20, 1 << 20
#: Forward sums are kept times GROWTH for each byte, so that they stay near one.
GROWTH = 12.0
#: The pipeline rejects a document if its best language has a smaller share than this.
LEAST_SCORE = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    import regex

    points = np.setdiff1d(np.arange(0x110000, dtype=np.uint32), np.arange(0xD800, 0xE000, dtype=np.uint32))
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"[\p{L}\p{M}]", points.tobytes().decode("utf-32-le"))]] = True
    return out


class Pieces:
    """The vocabulary as an open-addressed table from span hash to piece number."""

    BITS = 19

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        fit = lambda p: len(p) == 1 or all(c == 32 and not i or _LETTER[c] for i, c in enumerate(p))
        self.pieces = sorted({p for p in ranks if fit(p)} | {bytes([c]) for c in range(256)})
        self.sizes = np.array([len(p) for p in self.pieces])
        self.lengths = np.unique(self.sizes).tolist()
        ends = np.cumsum(self.sizes)
        self.hashes = span_hashes(np.frombuffer(b"".join(self.pieces), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        for i, h in enumerate(self.hashes.tolist()):
            s = h >> (64 - self.BITS)
            while self.slots[s] >= 0:
                s = (s + 1) & ((1 << self.BITS) - 1)
            self.slots[s] = i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            got = self.slots[slot[open_]]
            open_, got = open_[got >= 0], got[got >= 0]
            hit = self.hashes[got] == hashes[open_]
            out[open_[hit]] = got[hit]
            open_ = open_[~hit]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
        return out


_cache: dict[str | None, Pieces] = {}


def _pieces(path: str | None) -> Pieces:
    if path not in _cache:
        _cache[path] = Pieces(path)
    return _cache[path]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, row of each word); a byte before each start can serve as its blank."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "").cast(pa.string())))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = np.repeat(_letters()[points], 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = letter & edge[:-1]
    start[1:] |= letter[1:] & ~letter[:-1]
    end = letter & edge[1:]
    end[:-1] |= letter[:-1] & ~letter[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _cut(word: bytes) -> Iterator[bytes]:
    """Parts of at most LONG bytes, cut between characters."""
    at = 0
    while at < len(word):
        to = min(len(word), at + LONG)
        while to < len(word) and word[to] & 0xC0 == 0x80:
            to -= 1
        yield word[at:to]
        at = to


class Lattice:
    """All piece spans of a set of distinct words, ready for forward and backward sums."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.order = np.array(order, np.int64)
        words = [b" " + words[i] for i in order]
        self.size = np.array([len(w) for w in words])
        ends = np.cumsum(self.size)
        begins = ends - self.size
        data = np.frombuffer(b"".join(words), np.uint8)
        self.longest = int(self.size[0]) if words else 0
        self.active = [int(np.count_nonzero(self.size >= j)) for j in range(self.longest + 1)]
        self.spans: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
        hashed = Spans(data)
        for j in range(1, self.longest + 1):  # spans that end at j
            at, n = [], self.active[j]
            for length in pieces.lengths:
                if length > j:
                    break
                s = begins[:n] + j - length
                found = pieces.find(hashed.of(s, s + length))
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    at.append((length, hit, found[hit]))
            self.spans.append(at)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[j, word, language]; the sums over segmentations of the first j bytes if p are probabilities."""
        alpha = np.zeros((self.longest + 1, len(self.size), p.shape[1]))
        alpha[0] = 1
        for j in range(1, self.longest + 1):
            for length, hit, piece in self.spans[j]:
                alpha[j, hit] += alpha[j - length, hit] * p[piece]
        return alpha

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """log P(word) for each word in the caller's order and each language; p as of grown()."""
        alpha = self.forward(p)
        out = np.empty((len(self.size), p.shape[1]))
        out[self.order] = np.log(np.maximum(alpha[self.size, np.arange(len(self.size))], 1e-300)) - self.size[:, None] * np.log(GROWTH)
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of words with these weights (in the caller's order); p as of grown(), with one column."""
        alpha = self.forward(p)[:, :, 0]
        q = p[:, 0]
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(len(self.size))] = 1
        counts = np.zeros(len(q))
        total = np.maximum(alpha[self.size, np.arange(len(self.size))], 1e-300)
        share = weight[self.order] / total
        for j in range(self.longest, 0, -1):
            for length, hit, piece in self.spans[j]:
                b = beta[j, hit] * q[piece]
                beta[j - length, hit] += b
                np.add.at(counts, piece, alpha[j - length, hit] * b * share[hit])
        return counts


def grown(pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Probabilities times GROWTH for each byte of their pieces: every segmentation of a word grows by the same factor."""
    return p * GROWTH ** pieces.sizes[:, None]


def _long_log_total(pieces: Pieces, word: bytes, p: np.ndarray) -> list[float]:
    """log P(word) in each language for one word of any length; p as of grown(), sums are brought back to one as they go."""
    data = np.frombuffer(b" " + word, np.uint8)
    hashed, n = Spans(data), len(data)
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for length in pieces.lengths:
        if length <= n:
            at = np.arange(n - length + 1)
            found = pieces.find(hashed.of(at, at + length))
            for s in np.flatnonzero(found >= 0).tolist():
                ends[s + length].append((length, int(found[s])))
    langs, longest = range(p.shape[1]), pieces.lengths[-1]
    rows = p.tolist()
    out = []
    for k in langs:
        window, scale = [1.0], 0.0
        for j in range(1, n + 1):
            window.append(sum(window[-length] * rows[piece][k] for length, piece in ends[j]))
            if len(window) > 2 * longest:
                del window[: len(window) - longest]
                top = max(window)
                scale += float(np.log(top))
                window = [x / top for x in window]
        out.append(float(np.log(max(window[-1], 1e-300))) + scale - n * float(np.log(GROWTH)))
    return out


def log_totals(pieces: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """log P(word) for each word and language."""
    out, q = np.zeros((len(words), p.shape[1])), grown(pieces, p)
    by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(by_size) and len(words[by_size[at]]) <= LONG:
        to = at + 1
        while to < len(by_size) and len(words[by_size[to]]) <= LONG and (to + 1 - at) * (len(words[by_size[to]]) + 2) <= LATTICE:
            to += 1
        own = by_size[at:to]
        out[own] = Lattice(pieces, [words[i] for i in own]).log_totals(q)
        at = to
    for i in by_size[at:]:
        out[i] = _long_log_total(pieces, words[i], q)
    return out


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's rows."""
    count: dict[tuple[str, bytes], int] = {}
    for part in slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        data, starts, ends, rows = _words(part.column("text"))
        raw = data.tobytes()
        for a, b, row in zip(starts.tolist(), ends.tolist(), rows.tolist()):
            for word in (raw[a:b],) if b - a <= LONG else _cut(raw[a:b]):
                count[langs[row], word] = count.get((langs[row], word), 0) + 1
    if count:
        langs, words = zip(*count)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(count.values(), pa.int64())], ["lang", "word", "n"])


def _train(path: str | None):
    def run(counted: pd.DataFrame) -> pd.DataFrame:
        pieces = _pieces(path)
        counted = counted.sort_values("word")
        words, weight = [bytes(w) for w in counted["word"]], counted["n"].to_numpy(float)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lattices = []
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * (len(words[order[to]]) + 2) <= 4 * LATTICE:
                to += 1
            lattices.append((Lattice(pieces, [words[i] for i in order[at:to]]), weight[order[at:to]]))
            at = to
        p = np.full((len(pieces.pieces), 1), 1 / len(pieces.pieces))
        for _ in range(ROUNDS):
            q = grown(pieces, p)
            c = sum(lattice.expected(q, w) for lattice, w in lattices) + SMOOTHING
            p = (c / c.sum())[:, None]
        return pd.DataFrame({"lang": counted["lang"].iloc[:1], "p": [p[:, 0].tolist()]})

    return run


def _sample(labelled: DataFrame) -> DataFrame:
    """lang and text of the SAMPLE_DOCS rows of each language with the smallest hashes."""
    labelled = labelled.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return labelled.select("lang", "text").limit(0)
    # twice the wanted share of all hashes first, so that what is ranked is small
    cut = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min((1 << 64) - 1, 2 * SAMPLE_DOCS * (1 << 64) // r["count"]) - (1 << 63))])
    few = labelled.filter(F.col("h") <= cut[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.filter(f"n <= {SAMPLE_DOCS}").select("lang", "text")


def train(labelled: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece in each) from rows with doc_id, text and a non-null lang."""
    counted = _sample(labelled).mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.groupBy("lang").applyInPandas(_train(path), "lang string, p array<double>").collect()
    if not found:
        return [], np.zeros((0, 0))
    found = sorted((r.lang, r.p) for r in found)
    return [x for x, _ in found], np.array([p for _, p in found]).T.copy()


def _predict(langs: list[str], table: np.ndarray, path: str | None, texts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Languages and scores of a block of texts."""
    known: dict[int, int] = {}
    words: list[bytes] = []
    plans = []
    for part in texts:
        data, starts, ends, rows = _words(part.column("text"))
        hashes, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        number = np.empty(len(hashes), np.int64)
        for k, (h, i) in enumerate(zip(hashes.tolist(), index.tolist())):
            n = known.get(h)
            if n is None:
                n = known[h] = len(words)
                words.append(raw[starts[i] : ends[i]])
            number[k] = n
        plans.append((part, rows, number[inverse]))
    logs = log_totals(_pieces(path), words, table) if langs and words else np.zeros((len(words), max(1, len(langs))))
    for part, rows, number in plans:
        total = np.zeros((part.num_rows, logs.shape[1]))
        for k in range(logs.shape[1]):
            total[:, k] = np.bincount(rows, weights=logs[number, k], minlength=part.num_rows)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.bincount(rows, minlength=part.num_rows) > 0
        names, score = [], np.where(some, share, 0.0)
        for i, text in enumerate(part.column("text")):
            if not langs or not some[i] or not any(c.isalpha() for c in text.as_py()):
                names.append("und")
                score[i] = 0.0
            else:
                names.append(langs[best[i]])
        yield part, names, score


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for part in slices(batches, "text"):
        held.append(part)
        size += part.nbytes
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for part, names, score in _predict(*shared.value, path, block):
                yield pa.record_batch([part.column("doc_id"), pa.array(names), pa.array(score)], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """The rows of docs that have a language with a share of LEAST_SCORE or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for part, names, score in _predict(*shared.value, path, block):
                yield part.filter(pa.array([n != "und" and s >= LEAST_SCORE for n, s in zip(names, score)]))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "text", "lang")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(training_rows(docs)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

"""N-gram scoring with an Elias-Fano trie of words and their successors.

Training counts every text of the training fold; counting is a plain grouped sum after each block of
texts has summed its own. The trie has compact levels, each a set of files that tasks build in parallel
from sorted ranges of keys and that scoring tasks memory-map from the shared folder:
* words: the sorted 64-bit word hashes as an Elias-Fano sequence, with exact counts;
* contexts: the words that have successors, with quantised back-off weights;
* successors: for each context a range given by monotone pointers. Within a range the successor numbers
  increase; adding the last value of the range before makes the whole level one monotone sequence. A
  successor is sought relative to its context: value(pointer - 1) + number + 1.
The query keeps every counted pair. `pair_least` leaves out pairs seen less often than that; at 2 only pairs of words
seen twice are needed. Levels above the words get the counts of their words from the words' files, without a join.
Probabilities are interpolated absolute discounting over smoothed single-word probabilities,
    p(w | c) = (n(c, w) - DISCOUNT) / n(c) + backoff(c) * p(w),
stored as logarithms quantised to 16 bits between a file's extremes.

Level files are split by key ranges of about RANGE rows, so none is whole in one task or in the driver;
the driver holds one small row for each file. A frequent context may span several files. A task asks its
block's distinct keys in sorted order, file by file, and keeps MAPPED files of a level mapped at most;
of a shared folder that isn't mounted it holds KEPT files in memory.

Defined cases: null and empty texts are one end token; rows with a null id are scored but not trained
on; an empty training fold gives every token the same probability; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, materialize, read, shared_dir, slices
from .elias_fano import EliasFano, load, mounted, save

END = np.uint64(0x7E0D5C1B3A29F84D)
ALPHA = 0.1  # fixed by the contract
DISCOUNT, PAIR_LEAST = 0.75, 2
RANGE = 1_000_000
BLOCK_BYTES = 12 << 20
LEVELS = 65535
#: Files of a level that a task keeps mapped, or in memory where they can't be; word numbers take 32 bits of a pair's key.
MAPPED, KEPT, MOST_WORDS = 24, 6, 1 << 31


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, first token of each row and the end): the words of a text, then one end."""
    words, first = hashed_words(part.column("text"))
    n = len(first) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = first[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = words, END
    return out, np.concatenate([[0], ends + 1])


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True)


def _count(keys_of):
    """Sums of keys for each block of texts; signed because Spark's integers are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, size = keys_of(), [], 0
        for part in slices(batches, "text"):
            held.append(find(part))
            size += part.nbytes
            if size >= BLOCK_BYTES:
                k, n = _summed(held)
                yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])
                held, size = [], 0
        if held:
            k, n = _summed(held)
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    """Order-preserving between unsigned hashes and Spark's signed longs."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lowest, highest = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (highest - lowest) / LEVELS or 1.0
    return np.round((x - lowest) / step).astype(np.uint16), np.array([lowest, step])


def _columns(batches: Iterable[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for c in names]


def _files(sorted_rows: DataFrame, build, columns: list[str]) -> list[tuple[str, int, int]]:
    """(path, first key, rows) of the file that each task builds from its range of rows, in order of keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _columns(batches, columns)
        if len(own[0]):
            yield pa.record_batch([pa.array([build(*own)]), pa.array([int(own[0][0])]), pa.array([len(own[0])])], ["path", "first", "n"])

    found = sorted_rows.mapInArrow(run, "path string, first long, n long").collect()
    return sorted(((r.path, r["first"], r.n) for r in found), key=lambda r: r[1])


class Level:
    """Files of one level; a key belongs to the last file whose first key is not above it."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files
        self.first = np.array([f for _, f, _ in files], np.int64)
        self.base = np.concatenate([[0], np.cumsum([n for *_, n in files])]).astype(np.int64)
        self.loaded: dict[int, object] = {}

    def __getstate__(self):
        return self.__dict__ | {"loaded": {}}

    def by_file(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.files):
            at = np.searchsorted(self.first, keys, "right") - 1
            for f in np.unique(at[at >= 0]):
                yield int(f), np.flatnonzero(at == f)

    def arrays(self, f: int, make):
        found = self.loaded.pop(f, None) or make(load(self.files[f][0]))
        self.loaded[f] = found  # the last used is the last
        if len(self.loaded) > (MAPPED if mounted(self.files[f][0]) else KEPT):
            self.loaded.pop(next(iter(self.loaded)))
        return found


class Words(Level):
    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word; -1 and 0 if unknown."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for f, at in self.by_file(_signed(hashes)):
            index, counts = self.arrays(f, lambda a: (EliasFano.of(a, "hash"), a["count"]))
            k = index.find(hashes[at])
            hit = k >= 0
            number[at[hit]] = k[hit] + self.base[f]
            count[at[hit]] = counts[k[hit]]
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by number."""
        out, at = np.zeros(len(numbers), np.int64), np.searchsorted(self.base, numbers, "right") - 1
        for f in np.unique(at):
            here = np.flatnonzero(at == f)
            out[here] = self.arrays(int(f), lambda a: (EliasFano.of(a, "hash"), a["count"]))[1][numbers[here] - self.base[f]]
        return out


class Contexts(Level):
    def find(self, numbers: np.ndarray) -> np.ndarray:
        """log10 of each context's back-off weight; 0 for words without successors."""
        out = np.zeros(len(numbers))
        for f, at in self.by_file(numbers):
            index, code, scale = self.arrays(f, lambda a: (EliasFano.of(a, "number"), a["code"], a["scale"]))
            k = index.find(numbers[at].astype(np.uint64))
            hit = k >= 0
            out[at[hit]] = scale[0] + scale[1] * code[k[hit]]
        return out


class Successors(Level):
    def find(self, contexts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """log10 p(number | context) ; NaN where the pair is not in the trie."""
        out = np.full(len(contexts), np.nan)
        for f, at in self.by_file((contexts << 32) | numbers):
            first, pointer, value, code, scale = self.arrays(f, lambda a: (int(a["first"][0]), EliasFano.of(a, "pointer"), EliasFano.of(a, "value"), a["code"], a["scale"]))
            row = contexts[at] - first
            inside = (row >= 0) & (row < pointer.n - 1)
            at, row = at[inside], row[inside]
            start, end = pointer.access(row).astype(np.int64), pointer.access(row + 1).astype(np.int64)
            some = end > start
            at, start, end = at[some], start[some], end[some]
            before = np.where(start > 0, value.access(np.maximum(start - 1, 0)), np.uint64(0))
            k = value.find(before + numbers[at].astype(np.uint64) + np.uint64(1))
            hit = (k >= start) & (k < end)
            out[at[hit]] = scale[0] + scale[1] * code[k[hit]]
        return out


class Trie:
    def __init__(self, words: Words, contexts: Contexts, successors: Successors, total: int):
        self.words, self.contexts, self.successors, self.total = words, contexts, successors, total
        self.distinct = int(words.base[-1])

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))


def _save_words(folder: str):
    return lambda k, n: save(folder, EliasFano.build(_unsigned(k)).arrays("hash") | {"count": n})


def _save_contexts(folder: str):
    def build(number: np.ndarray, weight: np.ndarray) -> str:
        code, scale = _quantised(np.log10(weight))
        return save(folder, EliasFano.build(number).arrays("number") | {"code": code, "scale": scale})

    return build


def _save_successors(folder: str, words, contexts, total: int):
    """words, contexts: broadcast levels."""

    def build(k: np.ndarray, n: np.ndarray) -> str:
        context, number = k >> 32, k & 0xFFFFFFFF
        first = int(context[0])
        last = np.flatnonzero(np.append(context[1:] != context[:-1], True))
        rank = np.cumsum(np.concatenate([[0], (context[1:] != context[:-1]).astype(np.int64)]))
        own = context[last]
        trie = Trie(words.value, contexts.value, Successors([]), total)
        seen, back = trie.words.counts(own)[rank], trie.contexts.find(own)[rank]
        logs = np.log10((n - DISCOUNT) / seen + 10 ** (back + trie.base_log(trie.words.counts(number))))
        sizes = np.bincount(context - first)
        pointer = np.concatenate([[0], np.cumsum(sizes)])
        gained = np.concatenate([[0], np.cumsum(number[last] + 1)])
        value = gained[rank] + number + 1
        code, scale = _quantised(logs)
        return save(folder, {"first": np.array([first]), "code": code, "scale": scale} | EliasFano.build(pointer).arrays("pointer") | EliasFano.build(value).arrays("value"))

    return build


def _ranges(rows: DataFrame, key: str) -> DataFrame:
    n = max(1, rows.count() // RANGE)
    return rows.repartitionByRange(n, key).sortWithinPartitions(key)


def train(docs: DataFrame, pair_least: int = PAIR_LEAST) -> Trie:
    """The trie of these texts, with the pairs seen `pair_least` times or more."""
    spark = docs.sparkSession
    context = spark.sparkContext
    folder = f"{shared_dir(spark).rstrip('/')}/trie"
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def word_keys():
        return lambda part: _signed(_tokens(part)[0]).view(np.uint64)

    counted = materialize(texts.mapInArrow(_count(word_keys), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "words")
    words = Words(_files(_ranges(counted, "k"), _save_words(folder), ["k", "n"]))
    if words.base[-1] >= MOST_WORDS:
        raise ValueError(f"{words.base[-1]} distinct words; their numbers have 31 bits")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shared = context.broadcast(words)

    def pair_keys():
        known = shared.value

        def find(part: pa.RecordBatch) -> np.ndarray:
            hashes, first = _tokens(part)
            unique, inverse = np.unique(hashes, return_inverse=True)
            number, count = known.find(unique)
            number[count < pair_least] = -1
            number = number[inverse]
            pair = (number[:-1] << 32) | number[1:]
            fine = (number[:-1] >= 0) & (number[1:] >= 0)
            fine[first[1:-1] - 1] = False  # no pair across texts
            return pair[fine].view(np.uint64)

        return find

    pairs = texts.mapInArrow(_count(pair_keys), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.filter(F.col("n") >= pair_least) if pair_least > 1 else pairs, "pairs")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").to_numpy()
            yield pa.record_batch([batch.column("c"), pa.array(1 - batch.column("mass").to_numpy() / shared.value.counts(c))], ["c", "weight"])

    mass = pairs.groupBy(F.shiftright("k", 32).alias("c")).agg(F.sum(F.col("n") - DISCOUNT).alias("mass"))
    weights = materialize(mass.mapInArrow(weigh, "c long, weight double"), "weights")
    contexts = Contexts(_files(_ranges(weights, "c"), _save_contexts(folder), ["c", "weight"]))
    successors = Successors(_files(_ranges(pairs, "k"), _save_successors(folder, shared, context.broadcast(contexts), int(total)), ["k", "n"]))
    return Trie(words, contexts, successors, int(total))


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for part in slices(batches, "text"):
            hashes, first = _tokens(part)
            unique, inverse = np.unique(hashes, return_inverse=True)
            number, count = t.words.find(unique)
            base = t.base_log(count)
            rows = np.repeat(np.arange(part.num_rows), np.diff(first))
            ids = number[inverse]
            before = np.full(len(ids), -1, np.int64)
            before[1:] = ids[:-1]
            before[first[:-1]] = -1
            own = base[inverse]
            paired = np.flatnonzero((before >= 0) & (ids >= 0))
            keys, where = np.unique((before[paired] << 32) | ids[paired], return_inverse=True)
            logs = t.successors.find(keys >> 32, keys & 0xFFFFFFFF)[where]
            backoff = t.contexts.find(number)  # by distinct word; unknown words have none
            back = np.zeros(len(ids))
            back[1:] = backoff[inverse[:-1]]
            back[first[:-1]] = 0
            value = own + back
            hit = ~np.isnan(logs)
            value[paired[hit]] = logs[hit]
            total = lambda x: np.bincount(rows, weights=x, minlength=part.num_rows)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(first)), pa.array(np.bincount(rows[count[inverse] > 0], minlength=part.num_rows)), pa.array(total(own)), pa.array(total(value))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    trie = train(docs.filter(remainder != 0), 1)
    found = score(docs, trie)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")

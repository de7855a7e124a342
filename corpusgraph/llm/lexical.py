r"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents of a slice are sorted by the number of their entries and cut into blocks of similar ones, so that one width
suits a block. A document's entries are (term, level) for every level up to the term's count; levels are 1, 2, 3, 4, then
steps of a quarter, so a signature bounds how often a term occurs, too. An entry sets HASHES of the block's bits, BITS for each
entry. Bits are kept by slices: for each bit a bitmap over the block's documents. An index row is one block
with its ids, lengths, slices, texts and the number of its documents that hold each term; queries read the columns they need.

Search. The bitmaps of an entry's bits, ANDed, hold all documents that have the entry and a few more. Each term of an item adds its
weight times the most that its levels allow in a document of that length; the sums are upper bounds of the scores.
A task keeps the best TOP exact scores of each item so far; a document whose bound is below the last of them is out for certain, all
others are scored exactly from their texts, in the same task. So nothing is joined or shuffled but each task's best.

Items are a stated query set: their terms go to the tasks in blocks of ITEMS items or TERMS terms (or one item), a pass over the index for
each block. Document counts of terms are summed over the whole index first. Terms are named by 64-bit hashes.

Defined cases: null and empty texts have no terms and are never found; rows with a null id are searched and come last among equals;
rows that repeat are documents, and items, of their own; items without terms find nothing; very long texts are one
row of a block; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_bounds, hashed_words, longs, materialize, mix, read, slices

TOP = 10
BITS, HASHES = 16, 7
#: Documents of a block, and how many times as many entries as the smallest its largest may have (groups of 8 share bytes anyway).
ROWS, ALIKE = 512, 1.5
ITEMS, TERMS = 256, 1 << 14
#: Values of a matrix of terms by documents, and of bits that are unpacked, at a time.
CELLS, UNPACKED = 1 << 21, 1 << 24

#: Bytes outside of terms: ASCII but for digits and letters.
BREAKS = np.ones(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    BREAKS[_a : _b + 1] = False


def _levels() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] + max(1, out[-1] // 4))
    return np.array(out, np.int64)


LEVELS = _levels()
#: The largest count that a number of levels allows.
_MOST = np.concatenate([[0], LEVELS[1:] - 1])

_INDEX = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int64()), ("slices", pa.binary()), ("terms", pa.binary()), ("holds", pa.binary()), ("texts", pa.list_(pa.string()))])
INDEX = "block long, ids array<long>, lengths array<long>, width long, slices binary, terms binary, holds binary, texts array<string>"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, sorted, and the number of terms of each row."""
    hashes, first = hashed_words(texts, BREAKS)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows))), n


def _bits(terms: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The HASHES bits of entries, one column for each."""
    x = mix(terms + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(width)).astype(np.int64)


def _blocks(entries: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by falling number of entries, in blocks."""
    order = np.argsort(-entries, kind="stable")
    at = 0
    while at < len(order):
        to = at + 8
        while to < min(len(order), at + ROWS) and entries[order[to]] * ALIKE >= entries[order[at]]:
            to += 8
        yield order[at:to]
        at = min(to, len(order))


def _slices_of(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int, width: int) -> bytes:
    """The block's bitmaps; rows number its documents."""
    levels = np.searchsorted(LEVELS, counts, side="right")
    which = np.repeat(np.arange(len(rows)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    row_bits = -(-n // 8) * 8
    flat = np.sort((_bits(terms[which], level, width) * row_bits + rows[which][:, None]).ravel())
    out = []
    step = max(1, UNPACKED // row_bits)
    for a in range(0, width, step):
        some = np.zeros(min(step, width - a) * row_bits, bool)
        lo, hi = np.searchsorted(flat, [a * row_bits, a * row_bits + len(some)])
        some[flat[lo:hi] - a * row_bits] = True
        out.append(np.packbits(some).tobytes())
    return b"".join(out)


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for part in slices(batches, "text"):
        rows, terms, counts, n = term_counts(part.column("text"))
        entries = np.bincount(rows, np.searchsorted(LEVELS, counts, side="right"), minlength=len(n)).astype(np.int64)
        starts = np.searchsorted(rows, np.arange(len(n) + 1))
        for own in _blocks(entries):
            own = own[n[own] > 0]
            if not len(own):
                continue
            at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in own])
            mine = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
            width = int(max(64, BITS * entries[own].max()))
            held, holds = np.unique(terms[at], return_counts=True)
            pick = pa.array(own)
            texts = part.column("text").take(pick)
            row = [block, part.column("doc_id").take(pick).to_pylist(), n[own], width, _slices_of(mine, terms[at], counts[at], len(own), width), held.tobytes(), holds.astype(np.int64).tobytes(), texts.to_pylist()]
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _INDEX)], schema=_INDEX)
            block += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text) as a table in the shared folder, to be searched any number of times."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(own.mapInArrow(_indexed, INDEX), "signatures")


# --- items --------------------------------------------------------------------------------------------


class Items:
    """A block of items: distinct terms, weights, and the (item, term, count) of all items by item."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]]):
        every = np.concatenate([t for t, _ in items])
        self.n = len(items)
        self.terms, self.term = np.unique(every, return_inverse=True)
        self.count = np.concatenate([c for _, c in items]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t, _ in items])])
        self.weights = np.zeros(len(self.terms), np.int64)

    def sums(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(items, documents): sums of count * values; values has a row for each of `terms` (their numbers), others are zero."""
        place = np.full(len(self.terms), -1)
        place[terms] = np.arange(len(terms))
        use = np.flatnonzero(place[self.term] >= 0)
        out = np.zeros((self.n, values.shape[1]), np.int64)
        item = np.searchsorted(self.first, use, side="right") - 1
        step = max(1, CELLS // max(1, values.shape[1]))
        for a in range(0, len(use), step):
            some = use[a : a + step]
            bounds = group_bounds(item[a : a + step])
            out[item[a : a + step][bounds[:-1]]] += np.add.reduceat(values[place[self.term[some]]] * self.count[some][:, None], bounds[:-1], axis=0)
        return out


def saturated(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a score that grows with a term's count, in millionths."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _bounds(items: Items, width: int, bitmaps: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(items, documents): upper bounds of scores from the bitmaps of a few documents."""
    some, at, level = np.arange(len(items.terms)), None, 0
    has = None
    while len(some):
        bits = _bits(items.terms[some], level, width)
        found = bitmaps[bits[:, 0]]
        for k in range(1, HASHES):
            found &= bitmaps[bits[:, k]]
        if has is None:
            any_ = found.any(axis=1)
            kept, at = some[any_], np.arange(int(any_.sum()))
            some, last = kept, found[any_]
            has = np.unpackbits(last, axis=1)[:, : len(m)]
        else:
            last &= found
            any_ = last.any(axis=1)
            some, at, last = some[any_], at[any_], last[any_]
            has[at] += np.unpackbits(last, axis=1)[:, : len(m)]
        level += 1
    if has is None or not len(has):
        return np.zeros((items.n, len(m)), np.int64)
    allowed = saturated(_MOST[: int(has.max()) + 1, None], m)  # by number of levels and document
    return items.sums(kept, allowed[has, np.arange(len(m))] * items.weights[kept][:, None])


def _exact(items: Items, texts: pa.Array, m: np.ndarray) -> np.ndarray:
    """(items, documents): scores of texts."""
    rows, terms, counts, _ = term_counts(texts)
    place = np.minimum(np.searchsorted(items.terms, terms), len(items.terms) - 1)
    hit = items.terms[place] == terms
    rows, place, counts = rows[hit], place[hit], counts[hit].astype(np.int64)
    there, at = np.unique(place, return_inverse=True)
    values = np.zeros((len(there), len(m)), np.int64)
    values[at, rows] = items.weights[place] * saturated(counts, m[rows])
    return items.sums(there, values)


def _searched(items: Items, total: int, words: int, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(items.n, np.int64)  # the score to reach
        best = [(np.zeros(0, np.int64),) * 3 for _ in range(items.n)]  # scores, whether the id is null, ids
        step = max(8, CELLS // max(1, len(items.terms)) // 8 * 8)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = batch.column("ids")[i].values, batch.column("texts")[i].values
                n = batch.column("lengths")[i].values.to_numpy(zero_copy_only=False)
                m, width = 25 + (75 * n * total) // words, batch.column("width")[i].as_py()
                bitmaps = np.frombuffer(batch.column("slices")[i].as_buffer(), np.uint8).reshape(width, -1)
                null, number = ids.is_null().to_numpy(zero_copy_only=False), longs(ids)
                for a in range(0, len(n), step):
                    to = min(a + step, len(n))
                    may = _bounds(items, width, bitmaps[:, a // 8 : -(-to // 8)], m[a:to]) >= least[:, None]
                    rows = np.flatnonzero(may.any(axis=0))
                    if not len(rows):
                        continue
                    scores = _exact(items, texts.take(pa.array(a + rows)), m[a + rows])
                    good = (scores >= least[:, None]) & may[:, rows]
                    for item in np.flatnonzero(good.any(axis=1)):
                        own = np.flatnonzero(good[item])
                        all_ = [np.concatenate(x) for x in zip(best[item], (scores[item, own], null[a + rows[own]].astype(np.int64), number[a + rows[own]]))]
                        order = np.lexsort((all_[2], all_[1], -all_[0]))[:top]
                        best[item] = tuple(x[order] for x in all_)
                        if len(order) == top:
                            least[item] = best[item][0][-1]
        each = [len(b[0]) for b in best]
        scores, null, ids = (np.concatenate([b[k] for b in best]) for k in range(3))
        yield pa.record_batch([pa.array(np.repeat(np.arange(items.n), each), pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _held(terms: np.ndarray):
    """Numbers of documents that hold each of the terms, summed over a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, holds in zip(batch.column("terms"), batch.column("holds")):
                own, holds = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(holds.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, holds[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    return run


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        rows, terms, counts, n = term_counts(part.column("text"))
        starts = np.searchsorted(rows, np.arange(len(n) + 1))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())  # noqa: E731, B023
        yield pa.record_batch([part.column("item_id"), cut(terms), cut(counts.astype(np.int64))], ["item_id", "terms", "counts"])


def _item_blocks(items: DataFrame, most: int, most_terms: int) -> Iterator[tuple[list, Items]]:
    """Items with terms, in blocks; the driver holds one block (and a partition of the items' terms) at a time."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids, held, size = [], [], 0
    for r in own.mapInArrow(_item_terms, "item_id long, terms binary, counts binary").toLocalIterator():
        terms, counts = np.frombuffer(bytes(r.terms), np.uint64), np.frombuffer(bytes(r.counts), np.int64)
        if not len(terms):
            continue
        if held and (len(held) >= most or size + len(terms) > most_terms):
            yield ids, Items(held)
            ids, held, size = [], [], 0
        ids.append(r.item_id)
        held.append((terms, counts))
        size += len(terms)
    if held:
        yield ids, Items(held)


def search(index: DataFrame, items: DataFrame, top: int = TOP, weigh: Callable[[int, np.ndarray], np.ndarray] | None = None, most: int = ITEMS, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` best documents of an index; weigh gives terms' weights from N and df."""
    spark = index.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    total, words = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), operator.add))).first()
    found = []
    for ids, own in _item_blocks(items, most, most_terms) if total else ():
        df = np.zeros(len(own.terms), np.int64)
        for r in index.select("terms", "holds").mapInArrow(_held(own.terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block at most
            df[r.term] = r.df
        own.weights = (weigh or weights)(total, df)
        best = index.select("ids", "lengths", "width", "slices", "texts").mapInArrow(_searched(own, total, words, top), "item long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        best = best.withColumn("rank", rank).filter(F.col("rank") <= top).join(names, "item").select("item_id", "rank", "doc_id", "score")
        found.append(materialize(best, "found", few_files=True))
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def weights(total: int, df: np.ndarray) -> np.ndarray:
    """The contract's weights."""
    return np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
sizes AS (SELECT count(*) AS total, sum(len(terms))::BIGINT AS words FROM docs WHERE len(terms) > 0),
counts AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(terms) AS t FROM docs) GROUP BY d, t),
weights AS (SELECT t, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), sizes),
asked AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(terms) AS t FROM items) GROUP BY i, t),
scores AS (
  SELECT a.i, c.d, sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * len(k.terms) * z.total) // z.words))))::BIGINT AS score
  FROM asked a JOIN weights w ON a.t = w.t JOIN counts c ON c.t = a.t JOIN docs k ON k.d = c.d, sizes z GROUP BY a.i, c.d),
ranked AS (SELECT s.i, k.doc_id, score, row_number() OVER (PARTITION BY s.i ORDER BY score DESC, k.doc_id NULLS LAST) AS rank
  FROM scores s JOIN docs k ON k.d = s.d WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10
"""

"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

MinHash of a whole document can't find a short item in a long text: the similarity is their ratio of
sizes. So both sides are partitioned by size. Items fall into classes of (2**(c-1), 2**c] shingles, and
for each class that occurs, documents are cut into windows of 2 * 2**c shingle positions that overlap
by half, which bounds the size ratio by 4 at any length of text. An item of containment 0.75 in a
window then has similarity of at least 0.75 / (1 + 4 - 0.75) = 0.17 for the smallest items of a class,
and SAMPLES MinHash values used as bands of one row miss it with probability 0.83**64 < 0.00001.
Minima of windows come from minima of blocks, those of a class from those of the class below it.
Each candidate (document, item) is verified by exact containment of the item's 5-word shingles in the
document's whole set: 100 * shared >= 75 * the item's count.

Tasks that read the benchmark sketch its items and write them to the shared folder as files of about
INDEX_BYTES; the driver holds their paths only. A task that reads documents cuts each slice of them into
shingles once and seeks it in one file after the other, so documents are read once and a task holds
LOADED files at most, however large the benchmark is.

Defined cases: null and empty texts hold nothing, and items without words are held by nothing; items
or documents of fewer than five words have one shingle, the whole sequence; repeated rows and null ids
are searched like others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, distinct_by_row, hashed_words, longs, mix, read, shared_dir, shingles, slices
from .elias_fano import load, save

WORDS, PERCENT, SAMPLES = 5, 75, 64
INDEX_BYTES, LOADED = 32 << 20, 2

_MULTIPLIERS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


class Index:
    """Shingle sets of some items by size class, and their MinHash values."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.no_id, self.hashes, self.bounds = (arrays[k] for k in ("ids", "no_id", "hashes", "bounds"))
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c in arrays["classes"].tolist():
            values, items = (arrays[f"{k}{c}"].reshape(SAMPLES, -1) for k in ("values", "items"))
            self.classes[c] = list(zip(values, items))
        self.marks = {c: [_marks(v) for v, _ in table] for c, table in self.classes.items()}

    @staticmethod
    def arrays(ids: pa.Array, texts: pa.Array) -> dict[str, np.ndarray]:
        """What the file of an index holds."""
        w, first = hashed_words(texts)
        rows, hashes = distinct_by_row(*shingles(w, first, WORDS)[:2])
        n = np.bincount(rows, minlength=len(ids))
        bounds = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(n)
        size_class = np.ceil(np.log2(n[some])).astype(np.int64)
        out = {"ids": longs(ids), "no_id": ids.is_null().to_numpy(zero_copy_only=False), "hashes": hashes, "bounds": bounds, "classes": np.unique(size_class)}
        if len(some):
            values = np.array([np.minimum.reduceat(_sample(hashes, m), bounds[some]) for m in _MULTIPLIERS])
        for c in out["classes"].tolist():
            own = np.flatnonzero(size_class == c)
            order = np.argsort(values[:, own], axis=1, kind="stable")
            out |= {f"values{c}": np.take_along_axis(values[:, own], order, 1).ravel(), f"items{c}": some[own][order].ravel()}
        return out

    def set(self, item: int) -> np.ndarray:
        return self.hashes[self.bounds[item] : self.bounds[item + 1]]


def _marks(values: np.ndarray) -> np.ndarray:
    """A small table that says quickly that most values are not among these."""
    marks = np.zeros(1 << 16, bool)
    marks[(values >> np.uint64(5)) & np.uint64(0xFFFF)] = True
    return marks


def _sample(hashes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    x = hashes * multiplier
    return x ^ (x >> np.uint64(29))


def _candidates(index: Index, rows: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) pairs where a window of the row and the item share a MinHash value."""
    found: set[tuple[int, int]] = set()
    if not len(rows) or not index.classes:
        return found
    n = np.bincount(rows)
    ends = np.cumsum(n)
    place = np.arange(len(rows)) - (ends - n)[rows]
    wanted = sorted(index.classes)
    plans = []
    unit = place >> wanted[0]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (unit[1:] != unit[:-1])
    starts = np.flatnonzero(new)
    owner, unit = rows[starts], unit[starts]
    for c in wanted:
        if plans:
            coarse = unit >> (c - plans[-1][0])
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (coarse[1:] != coarse[:-1])
            at = np.flatnonzero(new)
            owner, unit = owner[at], coarse[at]
        else:
            at = starts
        next_same = np.flatnonzero(owner[1:] == owner[:-1])
        plans.append((c, at, owner, next_same))
    for k in range(SAMPLES):
        values = _sample(hashes, _MULTIPLIERS[k])
        for c, at, owner, next_same in plans:
            values = np.minimum.reduceat(values, at)
            windows = values.copy()
            windows[next_same] = np.minimum(values[next_same], values[next_same + 1])
            likely = np.flatnonzero(index.marks[c][k][(windows >> np.uint64(5)) & np.uint64(0xFFFF)])
            if len(likely):
                known, items = index.classes[c][k]
                left = np.searchsorted(known, windows[likely], "left")
                right = np.searchsorted(known, windows[likely], "right")
                for i, a, b in zip(likely, left, right):
                    found.update((int(owner[i]), int(x)) for x in items[a:b])
    return found


def _contained(indexes: Iterable[Index], part: pa.RecordBatch) -> Iterator[tuple[Index, int, int, int, int]]:
    """(index, row, item, shared, size) of the verified pairs of a slice."""
    words, first = hashed_words(part.column("text"))
    rows, hashes, _ = shingles(words, first, WORDS)
    bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
    for index in indexes:
        for row, item in sorted(_candidates(index, rows, hashes)):
            own = index.set(item)
            shared = int(np.isin(own, hashes[bounds[row] : bounds[row + 1]]).sum())
            if 100 * shared >= PERCENT * len(own):
                yield index, row, item, shared, len(own)


def _index_files(benchmark: DataFrame) -> list[str]:
    """Paths of the indexes that tasks build from the items they read, each of about INDEX_BYTES of text and sketches."""
    limit, folder = INDEX_BYTES, f"{shared_dir(benchmark.sparkSession).rstrip('/')}/items"
    cost = lambda texts: pc.sum(pc.binary_length(texts)).as_py() or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def saved() -> pa.RecordBatch:
            items = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.record_batch([pa.array([save(folder, Index.arrays(items.column("item_id"), items.column("text")))])], ["path"])

        for part in slices(batches, "text", min(SLICE_BYTES, limit // 8)):
            own = cost(part.column("text")) * 4 + part.num_rows * SAMPLES * 16
            if held and size + own > limit:
                yield saved()
                held, size = [], 0
            held.append(part)
            size += own
        if held:
            yield saved()

    size = benchmark.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) * 4 + SAMPLES * 16)).first()[0] or 0
    return sorted(r.path for r in benchmark.coalesce(int(size // limit) + 1).mapInArrow(run, "path string").collect())


def _reader(paths: list[str]):
    """Gives, in a task, the indexes one after the other."""
    read_one = lru_cache(LOADED)(lambda path: Index(load(path)))
    return lambda: map(read_one, paths)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds 75 % of the shingles or more."""
    paths = _index_files(_items(benchmark))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _reader(paths)
        for part in slices(batches, "text"):
            found = list(_contained(indexes(), part))
            if found:
                index, row, item, shared, size = zip(*found)
                ids = pa.array([None if i.no_id[k] else int(i.ids[k]) for i, k in zip(index, item)], pa.int64())
                yield pa.record_batch([part.column("doc_id").take(pa.array(row)), ids, pa.array(shared, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    paths = _index_files(_items(benchmark))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _reader(paths)
        for part in slices(batches, "text"):
            keep = np.ones(part.num_rows, bool)
            keep[[row for _, row, *_ in _contained(indexes(), part)]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, n_item
FROM shingles d JOIN shingles b ON d.kind = 0 AND b.kind = 1 AND d.s = b.s JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

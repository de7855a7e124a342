"""What several operators share: batches, word hashes, tables in the shared folder, components.

Texts reach Python as Arrow batches and are handled in slices of a few MB, so memory is bounded by the
longest text, not by the partition. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, SLICE_ROWS = 2 << 20, 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Span hashes are polynomials modulo the prime 2**61 - 1 in a base that was drawn at random once.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 1_402_847_293_658_120_933
#: Spans are summed in parts of this many bytes at most, so that no sum passes 64 bits.
_PART = 1 << 23
_PLACES = np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
_powers: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many `_` in front as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- tables in the folder that driver and executors share ---------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of our own only where it is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "table", few_files: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    few_files: the last stage has a task for each core only; for tables of a few numbers a row.
    """
    if few_files:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- Arrow batches ----------------------------------------------------------------------------------


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about `limit` bytes of `column` and SLICE_ROWS rows at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(size, done + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Gives freed memory back: workers live on between stages, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets); null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column: pa.Array) -> np.ndarray:
    """Values as int64, null as 0 (see the column's validity for nulls)."""
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-contiguous 2-d array."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32)), pa.py_buffer(matrix)])


def binaries(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)]).cast(pa.binary())


# --- words and shingles -----------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo _PRIME."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo _PRIME of values below it, from halves of 30 and 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _raised(base: int, n: int) -> np.ndarray:
    """Powers 0 to n of the base modulo _PRIME."""
    out, prime = np.ones(1, np.uint64), int(_PRIME)
    while len(out) <= n:
        out = np.concatenate([out, _product(out, np.full(1, pow(base, len(out), prime), np.uint64))])
    return out[: n + 1].copy()


class Spans:
    """64-bit hashes of spans of some bytes by prefix sums of a polynomial modulo 2**61 - 1.

    Two given texts of up to n bytes have equal hashes for n of 2**61 bases at most, whatever their structure.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_powers.get("down", ())) <= n:
            m = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            up = _raised(_BASE, m)
            _powers.update(low=(up & np.uint64(0xFFFFFFFF)).astype(np.uint32), high=(up >> np.uint64(32)).astype(np.uint32), down=_raised(pow(_BASE, -1, int(_PRIME)), m))
        digit = data.astype(np.uint64) + np.uint64(1)
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(digit * _powers["low"][:n], out=self.low[1:])
        np.cumsum(digit * _powers["high"][:n], out=self.high[1:])

    def _sums(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = _reduced(self.high[ends] - self.high[starts])
        high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))  # times 2**32
        return _reduced(_reduced(self.low[ends] - self.low[starts]) + high)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[starts[i]:ends[i]] for all spans at once."""
        size = ends - starts
        total = self._sums(starts, np.minimum(ends, starts + _PART))
        for k in np.flatnonzero(size > _PART):
            more = np.arange(starts[k] + _PART, ends[k], _PART)
            for part in self._sums(more, np.minimum(more + _PART, ends[k])):
                total[k] = (int(total[k]) + int(part)) % int(_PRIME)
        return mix(_product(total, _powers["down"][starts]) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for all spans at once."""
    return Spans(data).of(starts, ends)


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all rows; row i has words first[i] to first[i + 1]. breaks: by byte."""
    word = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(column: pa.Array, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each row and the end). breaks: bytes that end words."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, breaks)
    return span_hashes(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, position) of every run of `size` words; a row with fewer words gives its whole sequence as one."""
    n = np.diff(first)
    row_of = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(size):
        total[: max(0, len(words) - k)] += mix(words[k:] + _PLACES[k])
    whole = np.arange(len(words)) + size <= first[1:][row_of] if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    rows, hashes = row_of[at], mix(total[at])
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        parts = np.zeros(len(few), dtype=np.uint64)
        for k in range(size - 1):
            has = n[few] > k
            parts[has] += mix(words[first[few[has]] + k] + _PLACES[k])
        parts = mix(parts + n[few].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        rows, hashes, at = np.concatenate([rows, few]), np.concatenate([hashes, parts]), np.concatenate([at, first[few]])
        order = np.argsort(rows, kind="stable")
        rows, hashes, at = rows[order], hashes[order], at[order]
    return rows, hashes, at


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


# --- groups in a sorted stream ------------------------------------------------------------------------


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by `key`: tables that hold only whole groups, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        cut = int(pc.index(keys, keys[-1]).as_py())  # the last group may go on in the next batch
        if held and (cut or not held[-1].column(key)[-1].equals(keys[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


# --- components -----------------------------------------------------------------------------------


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id that each linked id reaches.

    links has long columns a and b. Alternating large-star and small-star steps until every id has one
    smaller neighbour that has none itself: each round is two shuffles of at most as many rows as links,
    hubs are summed by partial aggregation and joined by plain joins that adaptive execution can split,
    and every round is a table in the shared folder. Not done after `rounds`, it raises.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links", few_files=True)
    for _ in range(rounds):
        if _is_forest_of_stars(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", few_files=True)
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", few_files=True)
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "below", few_files=True)
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.filter("u > v").distinct(), "links", few_files=True)
        for old in (edges, least, large, below):
            discard(old)
        edges = after
    else:
        if not _is_forest_of_stars(edges):
            raise RuntimeError(f"components are not complete after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()

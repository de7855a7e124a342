"""Line dedup with two Bloom filters.

1. One pass fills two bitmaps for each task: keys seen once and keys seen twice (in two documents).
   Tasks' bitmaps are merged segment by segment: twice |= other.twice | (once & other.once).
   The size follows the exact count of lines, BITS_PER_LINE bits for each up to MAX_BITS.
2. A second pass tests each line's key against the twice-seen filter, which is at most MAX_BITS / 8
   bytes and so can be broadcast. Only suspected repeats shuffle, as 16-byte digests: a key is
   confirmed if its smallest and largest doc_id differ, and the smallest one keeps its lines.
   Beyond MAX_BITS more lines become suspects; the result stays exact.
3. Documents are joined to the digests they lose and put together again.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased.
Defined cases: null and empty texts are one empty line; rows with a null id neither count nor lose
lines; rows that repeat an id count as one document; lines under MIN_CHARS code points always stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import group_bounds, materialize, read, slices, text_bytes, unused, whole_groups

MIN_CHARS = 10
BITS_PER_LINE, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 29
HASHES = 4
SEGMENT_BYTES = 1 << 13


def _key(line: bytes) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return key


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(row, key, hash) of the distinct keys of each row that has an id."""
    data, offsets = text_bytes(part.column("text"))
    raw, rows, keys = data.tobytes(), [], []
    for i, known in enumerate(part.column("doc_id").is_valid().to_pylist()):
        if known:
            own = {_key(line) for line in raw[offsets[i] : offsets[i + 1]].split(b"\n")} - {None}
            keys.extend(own)
            rows.extend([i] * len(own))
    return np.array(rows, np.int64), keys, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _put(bitmap: np.ndarray, hashes: np.ndarray) -> None:
    at = _places(hashes, len(bitmap) * 8).ravel()
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _fill(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in slices(batches, "text"):
            _, _, hashes = _keys(part)
            if len(hashes):
                hashes, n = np.unique(hashes, return_counts=True)
                _put(twice, hashes[(n > 1) | _has(once, hashes)])
                _put(once, hashes)
        once, twice = once.reshape(-1, min(SEGMENT_BYTES, bits // 8)), twice.reshape(-1, min(SEGMENT_BYTES, bits // 8))
        for s in np.flatnonzero(once.any(axis=1)):
            yield pa.record_batch([pa.array([s], pa.int64())] + [pa.array([pa.compress(x[s].tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (once, twice)], ["segment", "once", "twice"])

    return run


def _merge(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "segment"):
            segments = table.column("segment").to_numpy()
            bounds = group_bounds(segments)
            for a, b in zip(bounds[:-1], bounds[1:]):
                once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
                for i in range(a, b):
                    o, t = (np.frombuffer(pa.decompress(table.column(c)[i].as_py(), width, "zstd", asbytes=True), np.uint8) for c in ("once", "twice"))
                    twice |= t | (once & o)
                    once |= o
                if twice.any():
                    yield pa.record_batch([pa.array([segments[a]]), pa.array([pa.compress(twice.tobytes(), "zstd", asbytes=True)], pa.binary())], ["segment", "twice"])

    return run


def _suspects(bits: int, filter_of):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = min(SEGMENT_BYTES, bits // 8)
        twice = np.zeros(bits // 8, np.uint8)
        for s, packed in filter_of.value:
            twice[s * width : (s + 1) * width] = np.frombuffer(pa.decompress(packed, width, "zstd", asbytes=True), np.uint8)
        for part in slices(batches, "text"):
            rows, keys, hashes = _keys(part)
            if len(keys):
                found = np.flatnonzero(_has(twice, hashes))
                yield pa.record_batch([part.column("doc_id").take(pa.array(rows[found])), pa.array([_digest(keys[i]) for i in found], pa.binary())], ["doc_id", "digest"])

    return run


def _apply(columns: list[str], text: str, lost: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            data, offsets = text_bytes(part.column(text))
            raw, kept, n, dropped = data.tobytes(), [], [], []
            for i, gone in enumerate(part.column(lost)):
                own = raw[offsets[i] : offsets[i + 1]]
                lines = own.count(b"\n") + 1
                n.append(lines)
                if gone.is_valid:
                    gone = set(gone.as_py())
                    stay = [x for x in own.split(b"\n") if (k := _key(x)) is None or _digest(k) not in gone]
                    dropped.append(lines - len(stay))
                    kept.append(b"\n".join(stay))
                else:
                    dropped.append(0)
                    kept.append(own)
            arrays = [part.column(c) for c in columns[:-3]]
            yield pa.record_batch([*arrays, pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=columns)

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, then _kept (bytes of the text that stays), _lines and _dropped.

    A name that docs has already gets a further `_` in front; the three are always the last columns.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    lines = own.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_LINE * int(lines)).bit_length()))
    filled = own.mapInArrow(_fill(bits), "segment long, once binary, twice binary")
    merged = filled.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge(min(SEGMENT_BYTES, bits // 8)), "segment long, twice binary")
    twice = spark.sparkContext.broadcast([(r.segment, bytes(r.twice)) for r in merged.collect()])  # at most MAX_BITS / 8 bytes
    suspects = materialize(own.mapInArrow(_suspects(bits, twice), "doc_id long, digest binary"), "suspects")
    repeated = materialize(suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("digest", "first"), "repeated")
    lost, key = unused(docs, "_gone"), unused(docs, "_id")
    gone = suspects.join(repeated, "digest").filter("doc_id <> first").groupBy("doc_id").agg(F.collect_set("digest").alias(lost)).withColumnRenamed("doc_id", key)
    joined = docs.join(gone, docs[id_col].cast("long") == gone[key], "left").select(*[docs[c] for c in docs.columns], lost)
    names = [*docs.columns, *(unused(docs, c) for c in ("_kept", "_lines", "_dropped"))]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(names[-3:], (T.BinaryType(), T.LongType(), T.LongType())))])
    return joined.mapInArrow(_apply(names, text_col, lost), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) <> max(doc_id)
), marked AS (
  SELECT keyed.doc_id, i, line, first IS NOT NULL AND keyed.doc_id <> first AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

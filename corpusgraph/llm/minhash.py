"""MinHash near-dedup with odd sketches and exact confirmation.

1. One pass over whole texts gives, for each document, its distinct 5-word shingles' count and digest,
   BANDS band keys of ROWS MinHash values, and an odd sketch: the MinHash samples of BINS bins are
   hashed to SKETCH_BITS bits and a bit holds the parity of what fell on it. The XOR of two sketches
   has about bits/2 * (1 - exp(-2d/bits)) ones for d differing samples, so its population count
   estimates high similarities closely.
2. Documents with equal shingle sets are one class; only its smallest id goes on.
3. First each class is paired with two leaders at most: the smallest one of its buckets, and that of its
   largest bucket. Then, SKETCH_ROUNDS times, the classes of buckets that still hold several components
   meet by sketch, and each component goes on with its best partner only. What still is apart then, and
   can't be told by sketch, meets by its full sets inside the buckets, which give spanning forests of
   links. So a round makes at most one pair for each class, no group is expanded into its pairs, and no
   candidate pair between components stays unseen.
4. Every pair is confirmed on the full sets (100 * intersection >= 75 * union) before it links.
Large buckets are dealt out as pairs of blocks; the rows of a bucket's largest component don't meet each
other, so that a bucket which is nearly joined costs in proportion to its rows.
With 32 bands of 4 a pair at similarity 0.75 shares no bucket with probability 0.000005.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing;
rows with a null id are left out; rows that repeat an id count as one document with the union of links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    binary_rows,
    connected_components,
    discard,
    distinct_by_row,
    group_bounds,
    hashed_words,
    materialize,
    mix,
    read,
    shingles,
    slices,
    whole_groups,
)

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: An odd sketch folds the samples of one permutation, one for each of BINS bins, into SKETCH_BITS bits.
BINS, SKETCH_BITS = 1024, 2048
#: A pair goes on to exact confirmation unless its estimate is this many standard errors below the threshold.
DEVIATIONS = 5
#: Bits of the filter over ids that spares texts the way to a join; beyond it more texts pass, never fewer.
FILTER_BITS = 1 << 24
#: Rows of a bucket that one task compares, or bytes of their sets; larger buckets are dealt out in blocks of this size.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Rounds of best partners by sketch before full sets meet.
SKETCH_ROUNDS = 2

_SAMPLES = BANDS * ROWS
_MULTIPLIERS = mix(np.arange(1, _SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def samples_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples of the sets hashes[bounds[i]:bounds[i + 1]] (none empty), one row each."""
    out = np.empty((len(bounds) - 1, _SAMPLES), np.uint64)
    for k in range(_SAMPLES):
        x = hashes * _MULTIPLIERS[k]
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), bounds[:-1])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys + samples[:, r::ROWS] + np.uint64(r + 1))
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def odd_sketches(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(parity bitmaps as rows of 64-bit words, number of samples) of distinct (row, hash)."""
    x = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    slot = rows * BINS + (x >> np.uint64(54)).astype(np.int64)
    order = np.lexsort((x, slot))
    first = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])] if len(order) else order
    place = rows[first] * SKETCH_BITS + (mix(x[first]) >> np.uint64(53)).astype(np.int64)
    bits = np.zeros(n_rows * SKETCH_BITS // 8, np.uint8)
    np.bitwise_xor.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return bits.view(np.uint64).reshape(n_rows, -1), np.bincount(rows[first], minlength=n_rows)


def may_link(apart: np.ndarray, samples: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether pairs may reach the threshold, from their XOR counts, summed samples and summed set sizes.

    At the threshold t the union has sizes / (1 + t) members, which fill `bins` bins, and t * bins samples
    agree; the spread comes from sampling without replacement and from collisions in the bitmap.
    """
    t = PERCENT / 100
    union = sizes / (1 + t)
    bins = -BINS * np.expm1(union * np.log1p(-1 / BINS))
    differing = -SKETCH_BITS / 2 * np.log1p(-2 * np.minimum(apart, SKETCH_BITS * 0.49) / SKETCH_BITS)
    d = np.maximum(samples - 2 * t * bins, 0)
    away = np.exp(-4 * d / SKETCH_BITS)
    noise = (SKETCH_BITS * (1 - away) / 4 - d * away) / away / 4
    spread = np.sqrt(t * (1 - t) * bins * np.maximum(1 - bins / np.maximum(union, 1), 0) + np.maximum(noise, 0) + 1)
    return (samples - differing) / 2 >= t * bins - DEVIATIONS * spread


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words, first = hashed_words(part.column("text"))
        rows, hashes, _ = shingles(words, first, WORDS)
        rows, hashes = distinct_by_row(rows, hashes)
        n = np.bincount(rows, minlength=part.num_rows)
        full = np.flatnonzero(n)
        bounds = np.concatenate([[0], np.cumsum(n[full])])
        digest = np.zeros((part.num_rows, 2), np.uint64)
        keys = np.zeros((part.num_rows, BANDS), np.uint64)
        sketch, samples_in = odd_sketches(rows, hashes, part.num_rows)
        if len(full):
            samples = samples_of(hashes, bounds)
            digest[full, 0] = np.add.reduceat(mix(hashes), bounds[:-1])
            digest[full, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1])
            keys[full] = band_keys(samples)
        offsets = pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32())
        yield pa.record_batch(
            [part.column("doc_id"), pa.array(n, pa.int64()), binary_rows(digest), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))), binary_rows(sketch), pa.array(samples_in, pa.int64())],
            ["doc_id", "n_shingles", "digest", "keys", "sketch", "samples"],
        )


def _sets(filter_of):
    """Sorted distinct shingle hashes of the texts whose id the filter has, as 64-bit words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, part in filter_of.value:
            bits[bucket * len(part) : (bucket + 1) * len(part)] = np.frombuffer(part, np.uint8)
        for batch in batches:
            at = _filter_place(batch.column("doc_id").to_numpy())
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices([batch], "text"):
                words, first = hashed_words(part.column("text"))
                rows, hashes, _ = shingles(words, first, WORDS)
                rows, hashes = distinct_by_row(rows, hashes)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))]) * 8
                yield pa.record_batch([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hashes)])], ["doc_id", "shingles"])

    return run


def _filter_place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(needed: DataFrame) -> list[tuple[int, bytes]]:
    """A bitmap over hashed ids in parts of 4 KB, FILTER_BITS / 8 bytes at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(_filter_place(batch.column("doc_id").to_numpy())))], ["at"])

    places = needed.mapInArrow(run, "at long")
    parts = places.groupBy((F.col("at") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("part"))
    return [(r.bucket, bytes(r.part)) for r in parts.collect()]


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * same >= PERCENT * (len(x) + len(y) - same)
        yield pa.record_batch([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _numbers(table: pa.Table | pa.RecordBatch, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketches, samples, set sizes) of rows."""
    packed = b"".join(table.column(f"{prefix}sketch").to_pylist())
    return np.frombuffer(packed, np.uint64).reshape(-1, SKETCH_BITS // 64), table.column(f"{prefix}samples").to_numpy(), table.column(f"{prefix}n_shingles").to_numpy()


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose odd sketches allow the wanted similarity."""
    for batch in batches:
        if batch.num_rows:
            (x, m, n), (y, k, o) = _numbers(batch, "x_"), _numbers(batch, "y_")
            good = pa.array(may_link(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), m + k, n + o))
            yield pa.record_batch([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


class Bucket:
    """Rows that meet in one place: a bucket, or two blocks of a large one."""

    def __init__(self, table: pa.Table, lo: int, hi: int):
        group = table.slice(lo, hi - lo)
        self.ids, self.side = group.column("id").to_numpy(), group.column("side").to_numpy()
        self.sketch, self.samples, self.sizes = _numbers(group)
        self.keys = pc.list_flatten(group.column("keys")).to_numpy().reshape(-1, BANDS)
        self.band = int(np.flatnonzero((self.keys == group.column("key")[0].as_py()).any(axis=0))[0])
        names, self.root, n = np.unique(group.column("part").to_numpy(), return_inverse=True, return_counts=True)
        self.mixed = len(names) > 1
        # rows of the largest component meet the others only from the other side
        self.small = self.root != n.argmax()

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, the rows they meet); rows of side 1 meet rows of side 2."""
        every, one = np.arange(len(self.ids)), self.side == 1
        if self.side[0] == 0:
            yield every[self.small], every
        else:
            yield every[self.small & one], every[~one]
            yield every[self.small & ~one], every[one]

    def partners(self, own: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether sketches allow a link, XOR counts) of rows with rows of other components."""
        apart = np.bitwise_count(self.sketch[own, None, :] ^ self.sketch[None, right, :]).sum(axis=2, dtype=np.int64)
        good = may_link(apart, self.samples[own, None] + self.samples[None, right], self.sizes[own, None] + self.sizes[None, right])
        return good & (self.root[own, None] != self.root[None, right]), apart

    def unseen(self, k: int, fit: np.ndarray) -> np.ndarray:
        """Those of the rows that share no earlier band with row k: a pair is seen in its first common band only."""
        return fit[~(self.keys[fit, : self.band] == self.keys[k, : self.band]).any(axis=1)]


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, Bucket]]:
    for table in whole_groups(batches, "place"):
        bounds = group_bounds(table.column("place").to_numpy())
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            bucket = Bucket(table, lo, hi)
            if bucket.mixed:
                yield table, lo, hi, bucket


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, part, other, score): the rows of a bucket that may link with other components, with their best partner."""
    for table, lo, hi, x in _buckets(batches):
        met, best, score = np.zeros(hi - lo, bool), np.full(hi - lo, -1), np.full(hi - lo, np.inf)
        for left, right in x.meetings():
            for start in range(0, len(left), 16):
                own = left[start : start + 16]
                good, apart = x.partners(own, right)
                for k in np.flatnonzero(good.any(axis=1)):
                    fit = np.flatnonzero(good[k])
                    fit = fit[np.isin(right[fit], x.unseen(own[k], right[fit]), assume_unique=True)]
                    if len(fit):
                        away = apart[k, fit] / (x.sizes[own[k]] + x.sizes[right[fit]])
                        met[own[k]], met[right[fit]] = True, True
                        best[own[k]], score[own[k]] = right[fit[away.argmin()]], away.min()
        at = np.flatnonzero(met)
        if len(at):
            rows = table.slice(lo, hi - lo).take(pa.array(at))
            some = pa.array(best[at] < 0)
            yield pa.record_batch(
                [rows.column(c).combine_chunks() for c in ("key", "id", "part")] + [pc.if_else(some, None, pa.array(x.ids[best[at]])), pc.if_else(some, None, pa.array(score[at]))], ["key", "id", "part", "other", "score"]
            )


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between components in each bucket, by full sets."""
    for table, lo, hi, x in _buckets(batches):
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.slice(lo, hi - lo).column("shingles")]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        ends = np.cumsum(size)
        begins = ends - size
        a, b = [], []
        for left, right in x.meetings():
            for k in left:
                good, _ = x.partners(np.array([k]), right)
                fit = x.unseen(k, right[good[0]])
                fit = fit[100 * np.minimum(size[fit], size[k]) >= PERCENT * np.maximum(size[fit], size[k])]
                if not len(fit):
                    continue
                mark = np.zeros(len(names), np.int64)
                mark[flat[begins[k] : ends[k]]] = 1
                n = size[fit]
                to = np.cumsum(n)
                shared = np.add.reduceat(mark[flat[np.repeat(begins[fit] - (to - n), n) + np.arange(to[-1])]], to - n)
                for j in fit[100 * shared >= PERCENT * (n + size[k] - shared)]:
                    if x.root[j] != x.root[k]:
                        x.root[x.root == x.root[j]] = x.root[k]
                        a.append(x.ids[k])
                        b.append(x.ids[j])
        if a:
            a, b = np.array(a), np.array(b)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted full sets of the documents with these ids."""
    needed = ids.select(F.col("id").alias("doc_id")).distinct()
    known = docs.sparkSession.sparkContext.broadcast(_filter(needed))
    return materialize(docs.mapInArrow(_sets(known), "doc_id long, shingles binary").join(needed, "doc_id", "left_semi"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_sets = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return with_sets.select("a", "b", "left", "right").mapInArrow(_confirmed, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """(place, side, key, id, part): buckets with their rows; large buckets as pairs of blocks.

    `rows` has key, id, part and share, the part of a block that a row takes. Of a large bucket the rows of the
    largest component make up blocks of their own, which meet all blocks of others but not each other.
    """
    parts = rows.groupBy("key", "part").agg(F.sum("share").alias("n"))
    size = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "part")).alias("top")).filter("all > 1")
    size = size.select("key", F.col("top.part").alias("top"), F.ceil(F.col("all") - F.col("top.n") + 1e-9).cast("int").alias("few"), F.ceil(F.col("top.n") + 1e-9).cast("int").alias("many"))
    large = rows.join(size, "key").withColumn("small", F.col("part") != F.col("top"))
    large = large.withColumn("own", F.expr("if(small, pmod(xxhash64(id), few), few + pmod(xxhash64(id), many))").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("small"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)))
    pair = [F.least("own", "other"), F.greatest("own", "other")]
    large = large.select(F.xxhash64("key", *pair).alias("place"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "key", "id", "part")
    small = rows.join(size, "key", "left_anti").select(F.xxhash64("key", F.lit(-1), F.lit(-1)).alias("place"), F.lit(0).alias("side"), "key", "id", "part")
    return small.union(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row with an id."""
    docs = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary, samples long"), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = materialize(full.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    members = materialize(full.select("doc_id", "digest", "n_shingles").join(classes, ["digest", "n_shingles"]).filter("doc_id <> id").select("doc_id", "id").distinct(), "members")
    chosen = materialize(full.join(classes.select(F.col("id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "keys", "sketch", "samples"), "chosen")
    sizes = materialize(signed.select("doc_id", "n_shingles"), "sizes")
    discard(signed)
    # a repeated id with different texts belongs to several classes and joins them
    several = members.groupBy("doc_id").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("doc_id").union(chosen.select("id"))
    bridges = members.join(several, "doc_id", "left_semi").toDF("b", "a").select("a", "b")
    components = _components(docs, chosen, bridges)
    by_class = members.join(components, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "id")).alias("component_id"))
    alone = components.withColumnRenamed("id", "doc_id").join(members, "doc_id", "left_anti")
    return (
        sizes
        .join(by_class.union(alone), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def _apart(rows: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """(key, id, part) of the rows whose bucket still holds several components."""
    labelled = rows.select("key", "id").join(components, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("key")
    return materialize(labelled.join(mixed, "key", "left_semi"), name)


def _components(docs: DataFrame, chosen: DataFrame, bridges: DataFrame) -> DataFrame:
    """(id, component_id) of the classes that are linked to others by confirmed pairs."""
    banded = chosen.select("id", F.explode("keys").alias("key"))
    leaders = materialize(banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n")).filter("leader <> last").select("key", "leader", "n"), "leaders")
    led = materialize(banded.join(leaders, "key"), "led")
    numbers = ["id", "sketch", "samples", "n_shingles"]
    firsts = led.filter("id <> leader").groupBy("id").agg(F.min("leader").alias("x"), F.max(F.struct("n", "leader")).alias("y"))
    pairs = firsts.select(F.explode(F.array_distinct(F.array("x", "y.leader"))).alias("a"), F.col("id").alias("b"))
    sketches = chosen.select(numbers)
    both = pairs.join(sketches.toDF("a", *[f"x_{c}" for c in numbers[1:]]), "a").join(sketches.toDF("b", *[f"y_{c}" for c in numbers[1:]]), "b")
    fresh = materialize(both.mapInArrow(_similar, "a long, b long"), "fresh", few_files=True)
    sets = _full_sets(docs, led)
    found = materialize(_confirm(fresh, sets).union(bridges), "found", few_files=True)
    components = materialize(connected_components(found), "components", few_files=True)
    rows, tried = _apart(led, components, "rows"), fresh
    for _ in range(SKETCH_ROUNDS):
        if rows.isEmpty():
            return components
        dealt = _dealt(rows.withColumn("share", F.lit(1 / BLOCK))).join(chosen, "id").select("place", "side", "key", "part", "keys", *numbers)
        met = materialize(dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_met, "key long, id long, part long, other long, score double"), "met", few_files=True)
        best = met.filter("other is not null").groupBy("part").agg(F.min(F.struct("score", "id", "other")).alias("x"))
        best = best.select(F.least("x.id", "x.other").alias("a"), F.greatest("x.id", "x.other").alias("b")).distinct()
        fresh = materialize(best.join(tried, ["a", "b"], "left_anti"), "fresh", few_files=True)
        new = fresh if fresh.isEmpty() else materialize(_confirm(fresh, sets), "new", few_files=True)
        if not new.isEmpty():
            found, tried = found.union(new.select("a", "b")), tried.union(fresh)
            components = materialize(connected_components(found), "components", few_files=True)
        rows = _apart(met, components, "rows")
    if rows.isEmpty():
        return components
    share = F.lit(1 / BLOCK) + F.col("n_shingles") * 8 / BLOCK_BYTES
    dealt = _dealt(rows.join(chosen.select("id", share.alias("share")), "id").select("key", "id", "part", "share"))
    dealt = dealt.join(chosen, "id").join(sets.withColumnRenamed("doc_id", "id"), "id").select("place", "side", "key", "part", "keys", "shingles", *numbers)
    new = materialize(dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_joined, "a long, b long"), "new", few_files=True)
    return components if new.isEmpty() else materialize(connected_components(found.union(new)), "components", few_files=True)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

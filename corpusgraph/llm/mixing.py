r"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

1. Targets. Source i (by code point, null last) weighs WEIGHTS[i mod 3]; the sources share all words by weight. A target
   stops at MOST times its source's words and the excess is shared again by weight until no target is above: sorted by
   MOST * words / weight, the capped sources are a prefix, so running sums over the sources find the level at once.
2. Certain copies. Every document of a source is taken floor(target / words) times.
3. Pareto sampling. What is left is met by one more copy of some documents. Documents of a source are split into cells of
   a quarter of an octave of size. From the largest sizes to the smallest a cell gets a whole number of documents, the
   nearest to the words still owed; inside the cell the inclusion probabilities are tilted by size so that the
   expected words equal what is owed, and the rest of the rounding is owed to the next cell. A document's rank is
   (odds of u) / (odds of its inclusion probability), u a digest of id and text; the cell's smallest ranks are taken.

A cell's n-th smallest rank is found by a histogram of BUCKETS buckets; rows below its edge are taken where they are, and only the
one bucket at the edge, a share of about 1 / BUCKETS of the cell, is ordered, with equal rows summed up before. So no
source or cell, however large, meets in one task. The tables of sources and cells have at most a few hundred rows for each source.
Texts are read once, for words and digests; a narrow table in the shared folder keeps these.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own; rows with a
null id are mixed like others; rows that repeat are documents of their own (of equal rows some may be taken more often
than others); very long texts count whole; empty tables give no rows; other columns are not looked at. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

# Fixed values of the contract
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

BUCKETS = 4096
#: Equal rows that one row is exploded to at a time.
TOGETHER = 1024


def n_words(text: Column) -> Column:
    """The number of words of a text; its words shrink to one letter each, so no array of words is made."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    octave = "length(bin(size)) - 1"
    cell = f"if(size = 0, -1, cast(4 * ({octave}) + ((size - shiftleft(1L, {octave})) * 4) div shiftleft(1L, {octave}) as int))"
    return own.select("doc_id", "source", n_words(F.col("text")).alias("size"), u.alias("u")).withColumn("cell", F.expr(cell))


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds target to (source, source_size): the sources' shares, capped at `most` times their size."""
    every, ordered = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("fill", "at")
    out = sources.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    level = F.coalesce(F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(every), F.lit(0.0))
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))


#: One cell of a source after the other, large sizes first: how many documents it gives and the tilt of their probabilities.
_ALLOT = """aggregate(array_sort(filter(cells, x -> x.cell >= 0)),
  named_struct('owed', 0D, 'out', cast(array() as array<struct<cell:int,n:bigint,take:bigint,share:double,tilt:double,mean:double>>)),
  (a, x) -> {step}, a -> a.out)"""


def _allotted(owed: str) -> str:
    """SQL of the step: an array with one struct gives each value a name, so that it is worked out once."""
    named = lambda fields, then, v: f"transform(array({fields}), {v} -> {then})[0]"
    k = "cast(greatest(0D, least(x.n, floor(o.owed / (x.words / x.n) + 0.5))) as double)"
    room = "(0.5 * least(t.k / x.n, 1 - t.k / x.n) / greatest(1D, pow(2D, floor(x.cell / 4) - 2)))"
    tilt = f"if(o.spread > 0, greatest(-{room}, least({room}, (o.owed - t.k * (x.words / x.n)) / o.spread)), 0D)"
    out = "named_struct('cell', x.cell, 'n', x.n, 'take', cast(t.k as bigint), 'share', t.k / x.n, 'tilt', t.tilt, 'mean', x.words / x.n)"
    last = f"named_struct('owed', o.owed - t.k * (x.words / x.n) - t.tilt * o.spread, 'out', concat(a.out, array({out})))"
    with_tilt = named(f"named_struct('k', t.k, 'tilt', {tilt})", last, "t")
    with_k = named(f"named_struct('k', {k})", with_tilt, "t")
    return named(f"named_struct('owed', {owed}, 'spread', x.squares - (cast(x.words as double) * x.words) / x.n)", with_k, "o")


def _plan(base: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source and cell: target, certain copies, documents to take once more and their probabilities."""
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    cells = base.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.sum(square.cast("decimal(38,0)")).cast("double").alias("squares"))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.collect_list(F.struct((-F.col("cell")).alias("order"), "cell", "n", "words", "squares")).alias("cells"))
    out = _targets(sources, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("copies", F.least(F.floor(ratio), F.lit(most)).cast("long")).withColumn("part", ratio - F.col("copies"))
    allotted = F.expr(_ALLOT.format(step=_allotted("a.owed + part * x.words")))
    none = F.array(F.expr("named_struct('cell', -1, 'n', 0L, 'take', 0L, 'share', 0D, 'tilt', 0D, 'mean', 0D)"))
    return out.select("source", "source_size", "target", "copies", F.explode(F.concat(none, allotted)).alias("c")).select("source", "source_size", "target", "copies", "c.*")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each document; taken counts its words with repeats."""
    base = materialize(_measured(docs), "mix")
    plan = materialize(_plan(base, weights, most), "mixplan", few_files=True)
    chance = F.col("share") + F.col("tilt") * (F.col("size") - F.col("mean"))
    rank = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    some = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int"))

    def ranked(plan: DataFrame) -> DataFrame:
        here = plan.withColumnsRenamed({"source": "_source", "cell": "_cell"})
        out = base.join(here, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell"))).drop("_source", "_cell")
        return out.withColumn("rank", F.when(some, rank)).withColumn("bucket", F.when(some, bucket))

    own = Window.partitionBy("source", "cell")
    counts = ranked(plan).filter("bucket is not null").groupBy("source", "cell", "bucket", "take").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("below", F.sum("rows").over(own.orderBy("bucket")) - F.col("rows"))
    edges = counts.filter("below < take and below + rows >= take").select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.col("bucket").alias("edge"), "below")
    plan = materialize(plan.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")), "left").drop("_s", "_c"), "mixplan", few_files=True)

    rows = ranked(plan)
    said = F.when(~some, (F.col("take") > 0).cast("long")).when(F.col("bucket") < F.col("edge"), F.lit(1)).when(F.col("bucket") > F.col("edge"), F.lit(0)).cast("long")
    shown = ["doc_id", "source", "size", "source_size", "target"]
    out = lambda df, more: df.select(*shown, (F.col("size") * (F.col("copies") + more)).alias("taken"))
    clear = out(rows.filter(said.isNotNull()), said)

    groups = rows.filter(some & (F.col("bucket") == F.col("edge"))).groupBy(*shown, "cell", "copies", "take", "below", "rank").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(own.orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    groups = groups.withColumn("got", F.greatest(F.lit(0), F.least(F.col("rows"), F.col("take") - F.col("below") - before)))
    parts = groups.withColumn("part", F.explode(F.array(F.struct(F.lit(1).alias("more"), F.col("got").alias("m")), F.struct(F.lit(0).alias("more"), (F.col("rows") - F.col("got")).alias("m"))))).filter("part.m > 0")
    parts = parts.withColumn("from", F.explode(F.expr(f"sequence(0L, part.m - 1, {TOGETHER}L)"))).withColumn("one", F.explode(F.expr(f"sequence(from, least(from + {TOGETHER}, part.m) - 1)")))
    return clear.unionByName(out(parts, F.col("part.more")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
base AS (
  SELECT doc_id, source, size, (('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN size = 0 THEN -1 ELSE 4 * (length(bin(size)) - 1) + ((size - (1::BIGINT << (length(bin(size)) - 1))) * 4) // (1::BIGINT << (length(bin(size)) - 1)) END AS cell
  FROM own),
cells AS (
  SELECT source, cell, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS words, sum(size::HUGEINT * size)::DOUBLE AS squares,
    row_number() OVER (PARTITION BY source ORDER BY cell DESC) AS k
  FROM base GROUP BY source, cell),
sources AS (
  SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM cells GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / [5, 2, 1][(place - 1) % 3 + 1] AS fill FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(max(CASE WHEN fill >= level THEN level END) OVER (), 0.0::DOUBLE)) AS target FROM levels),
ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS ratio FROM targets),
copied AS (SELECT *, least(floor(ratio), 3) AS copies, ratio - least(floor(ratio), 3) AS part FROM ratios),
walk AS (
  SELECT source, 0::BIGINT AS k, -1 AS cell, 0::DOUBLE AS take, 0::DOUBLE AS n, 0::DOUBLE AS mean, 0::DOUBLE AS tilt, 0::DOUBLE AS owed FROM copied
  UNION ALL
  SELECT source, k, cell, take, n, mean, tilt, due - take * mean - tilt * spread FROM (
    SELECT *, CASE WHEN spread > 0 THEN greatest(-room, least(room, (due - take * mean) / spread)) ELSE 0 END AS tilt FROM (
      SELECT *, 0.5 * least(take / n, 1 - take / n) / greatest(1, pow(2::DOUBLE, floor(cell / 4) - 2)) AS room FROM (
        SELECT *, greatest(0, least(n, floor(due / mean + 0.5))) AS take FROM (
          SELECT c.source, c.k, c.cell, c.n, c.words / c.n AS mean, c.squares - (c.words * c.words) / c.n AS spread, w.owed + p.part * c.words AS due
          FROM walk w JOIN cells c ON c.source IS NOT DISTINCT FROM w.source AND c.k = w.k + 1 AND c.cell >= 0
          JOIN copied p ON p.source IS NOT DISTINCT FROM w.source))))),
ranked AS (
  SELECT b.doc_id, b.size, b.source, b.cell, p.source_size, p.target, p.copies, w.take, w.n,
    CASE WHEN w.take > 0 AND w.take < w.n THEN (u / (1 - u)) / ((w.take / w.n + w.tilt * (b.size - w.mean)) / (1 - (w.take / w.n + w.tilt * (b.size - w.mean)))) ELSE 0 END AS rank
  FROM base b JOIN copied p ON b.source IS NOT DISTINCT FROM p.source
  LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM b.source AND w.cell = b.cell AND w.k > 0)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN take > 0 AND row_number() OVER (PARTITION BY source, cell ORDER BY rank, doc_id NULLS LAST, size) <= take THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

"""Order-dependent operators as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _islands(df: DataFrame, starts: Column, by: list[str], order: list) -> DataFrame:
    """Adds `island`: the running count of rows that start a new group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_start", starts.cast("long")).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def session_ids(df: DataFrame, source: str, ts: str, tie: str, gap_seconds: int = 3600) -> DataFrame:
    """Adds `island`; a gap of more than gap_seconds starts a new one, an equal gap does not."""
    w = Window.partitionBy(source).orderBy(ts, tie)
    gap = _micros(F.col(ts)) - _micros(F.lag(ts).over(w))
    return _islands(df.withColumn("_gap", gap), F.coalesce(F.col("_gap") > gap_seconds * 1_000_000, F.lit(True)), [source], [ts, tie]).drop("_gap")


def session_clusters(df: DataFrame, source: str, ts: str, tag: str, tie: str, gap_seconds: int = 3600, topics: int = 3) -> DataFrame:
    """(cluster_id, source, started, ended, n, topic): runs of rows of a source; the topic is its most frequent tags."""
    rows = session_ids(df, source, ts, tie, gap_seconds)
    keys = [source, "island"]
    spans = rows.groupBy(*keys).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
    counted = rows.groupBy(*keys, tag).agg(F.count("*").alias("uses"))
    best = counted.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("uses").desc(), tag))).filter(F.col("_k") <= topics)
    topic = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", tag))).alias("t")).select(*keys, F.array_join(F.transform("t", lambda x: x[tag].cast("string")), ", ").alias("topic"))
    digits = F.date_format("started", "yyyyMMddHHmmss")
    return spans.join(topic, keys, "left").select(F.concat_ws("_", F.lit("cluster"), F.col(source).cast("string"), digits).alias("cluster_id"), F.col(source).alias("source"), "started", "ended", "n", "topic")


def coalesce_by_proximity(df: DataFrame, threshold: int = 500, most: int | None = None, most_tags: int = 15) -> DataFrame:
    """Merges ranges of a compound whose gap to the furthest end so far is at most the threshold.

    df: compound_id, start_byte, end_byte, score, ts, tags (array). With `most`, each compound keeps
    max(3, min(8, ceil(most / 15))) ranges and the whole keeps `most`, best scores first.
    """
    w = Window.partitionBy("compound_id").orderBy("start_byte", "end_byte")
    reached = F.max("end_byte").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = _islands(df.withColumn("_reached", reached), F.coalesce(F.col("start_byte") - F.col("_reached") > threshold, F.lit(True)), ["compound_id"], ["start_byte", "end_byte"])
    out = rows.groupBy("compound_id", "island").agg(
        F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.max("score").alias("score"), F.min("ts").alias("ts"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), 1, most_tags).alias("tags"), F.count("*").alias("n"),
    ).drop("island")
    if most is None:
        return out
    each = max(3, min(8, -(-most // 15)))
    rank = F.row_number().over(Window.partitionBy("compound_id").orderBy(F.col("score").desc(), "start_byte"))
    return out.withColumn("_k", rank).filter(F.col("_k") <= each).drop("_k").orderBy(F.col("score").desc(), "compound_id", "start_byte").limit(most)


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; with `rank` the place stays as a column."""
    out = df.withColumn(rank or "_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank or "_k") <= k)
    return out if rank else out.drop("_k")


def distinct_on(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return top_k(df, by, order, 1)


def progressive_radius(df: DataFrame, by: list[str], order: list, radius: int) -> DataFrame:
    """Adds `radius`: the best tenth gets twice, the next two fifths one and a half times, the rest the plain one."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by))
    first = F.greatest(F.lit(1), F.floor(n * 0.1))
    factor = F.when(F.col("_k") <= first, 2.0).when(F.col("_k") <= first + F.floor(n * 0.4), 1.5).otherwise(1.0)
    return df.withColumn("_k", place).withColumn("radius", factor * radius).drop("_k")


def round_robin(df: DataFrame, by: list[str], group: str, order: list) -> DataFrame:
    """Adds `turn` and `place`: first every group's best row, then every group's second, groups in order of their best."""
    inner = Window.partitionBy(*by, group).orderBy(*order)
    ranked = df.withColumn("_all", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("turn", F.row_number().over(inner))
    ranked = ranked.withColumn("_first", F.min("_all").over(Window.partitionBy(*by, group)))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "_first"))).drop("_all", "_first")


def budget_prefix(df: DataFrame, by: list[str], order: list, size: Column, budget: Column | int) -> DataFrame:
    """Rows in order as long as their running size stays within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def centrality_score(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Adds `centrality`: (n - i) / n for the i-th row, counted from 0."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("centrality", F.round((n - place) / n, 4))


def carry_forward(df: DataFrame, by: list[str], order: list, value: str, default: Column) -> DataFrame:
    """Replaces a null by the last value before it, else by the default."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), default))


def adjacent_chunks(df: DataFrame, source: str, seq: str, node: str, near: int = 5) -> DataFrame:
    """(a, b, relation): pairs of a source whose sequence numbers differ by 1 (next_chunk) or by less than `near`."""
    left = df.select(F.col(source).alias("_s"), F.col(node).alias("a"), F.col(seq).alias("x"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(near - 1)))
    left = left.withColumn("step", steps).withColumn("y", F.col("x") + F.col("step"))
    right = df.select(F.col(source).alias("_s"), F.col(node).alias("b"), F.col(seq).alias("y"))
    return left.join(right, ["_s", "y"]).select("a", "b", F.when(F.col("step") == 1, "next_chunk").otherwise("near").alias("relation"))


def timeline(df: DataFrame, by: list[str], ts: str, relevance: str, label: str, moments: int = 5, least: float = 0.7) -> DataFrame:
    """(by, earliest, latest, span_days, moments): the span of results and the first relevant ones."""
    span = df.groupBy(*by).agg(F.min(ts).alias("earliest"), F.max(ts).alias("latest"))
    span = span.withColumn("span_days", F.ceil((_micros(F.col("latest")) - _micros(F.col("earliest"))) / 86_400_000_000).cast("long"))
    key = top_k(df.filter(F.col(relevance) > least), by, [ts, label], moments, "_k")
    key = key.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", label))), lambda x: x[label].cast("string")), ",").alias("moments"))
    return span.join(key, by, "left").withColumn("moments", F.coalesce("moments", F.lit("")))


def rolling_context(df: DataFrame, by: list[str], text: str, ts: str, relevance: str, now: Column, temporal: Column, tokens: int) -> DataFrame:
    """Fills 95 % of tokens * 4 characters by .7 relevance + .3 recency (.4 and .6 where `temporal`), over 30 days.

    The first row that doesn't fit is cut at its last sentence end past the middle if more than 200
    characters are left. Rows come out with their place in time order.
    """
    age = (_micros(now) - _micros(F.col(ts))) / 86_400_000_000
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / 30))
    score = F.when(temporal, 0.4 * F.col(relevance) + 0.6 * recency).otherwise(0.7 * F.col(relevance) + 0.3 * recency)
    budget = int(tokens * 4 * 0.95)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), ts, text)
    rows = df.withColumn("score", F.round(score, 6)).withColumn("_used", F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("_used")
    part = F.expr(f"substring({text}, 1, {budget} - _used)")
    cut = F.regexp_extract(part, r"(?s)^(.*[.!?])", 1)
    piece = F.when(F.length(text) <= left, F.col(text)).when(left > 200, F.when(F.length(cut) > left / 2, cut).otherwise(part))
    return rows.filter(F.col("_used") < budget).withColumn("piece", piece).filter("piece is not null").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(ts, text))).drop("_used")

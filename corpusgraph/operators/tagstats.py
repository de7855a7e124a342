"""Aggregates over tags, nodes and sources. tags: node_id, tag, bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def density_map(tags: DataFrame, sources: DataFrame | None = None, most: int = 100) -> DataFrame:
    """(tag, n, sources, pct): the most used tags with their share among the rows returned. sources: node_id, source."""
    rows = tags.join(sources, "node_id") if sources is not None else tags.withColumn("source", F.col("bucket"))
    top = rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).orderBy(F.col("n").desc(), "tag").limit(most)
    return top.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))  # over `most` rows


def density_by_bucket(tags: DataFrame, most: int = 50) -> DataFrame:
    return tags.groupBy("tag", "bucket").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag", "bucket").limit(most)


def tier(n: Column) -> Column:
    """How hard a concept is to retrieve: frequent ones need little."""
    return F.when(n >= 50, "light").when(n >= 5, "medium").otherwise("heavy")


def density_terms(terms: DataFrame, molecules: DataFrame, tags: DataFrame) -> DataFrame:
    """(term, molecules, tag_rows, tier, doc_limit) for a table of single-word terms. molecules: mol_id, content."""
    tokens = molecules.select("mol_id", F.explode(F.array_distinct(T.words(F.col("content")))).alias("term"))
    hits = tokens.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("molecules"))
    uses = tags.withColumn("term", F.lower(F.regexp_replace("tag", "^#", ""))).groupBy("term").agg(F.count("*").alias("tag_rows"))
    zero = F.lit(0).cast("long")
    out = terms.select("term").distinct().join(hits, "term", "left").join(uses, "term", "left").select("term", F.coalesce("molecules", zero).alias("molecules"), F.coalesce("tag_rows", zero).alias("tag_rows"))
    return out.withColumn("tier", tier(F.col("molecules"))).withColumn("doc_limit", F.when(F.col("tier") == "light", 10).when(F.col("tier") == "medium", 25).otherwise(0))


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for each value and for `total`."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.lit("total").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def corpus_stats(molecules: DataFrame, documents: DataFrame, tags: DataFrame, source: str = "source") -> DataFrame:
    """(metric, n): molecules, documents, sources and tags."""
    parts = [("molecules", molecules.agg(F.count("*").alias("n"))), ("documents", documents.agg(F.count("*").alias("n"))), ("sources", documents.agg(F.count_distinct(source).alias("n"))), ("tags", tags.agg(F.count_distinct("tag").alias("n")))]
    first, *rest = [p.select(F.lit(name).alias("metric"), "n") for name, p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first


def corpus_chars(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.round(F.count("*") * F.avg(F.length(text))).cast("long").alias("chars"))


def tag_statistics(tags: DataFrame) -> DataFrame:
    """(avg_tags, max_tags, median_tags, unique_tags, used_once)."""
    per_node = tags.groupBy("node_id").agg(F.count_distinct("tag").alias("k")).agg(F.round(F.avg("k"), 4).alias("avg_tags"), F.max("k").alias("max_tags"), F.percentile("k", 0.5).alias("median_tags"))
    per_tag = tags.groupBy("tag").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_tags"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0).cast("long")).alias("used_once"))
    return per_node.crossJoin(per_tag)  # one row each


def orphan_tags(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).filter("n = 1").select("tag")


def list_values(df: DataFrame, column: str, most: int = 5000, bucket: str | None = None) -> DataFrame:
    """Sorted distinct tags or buckets, of one bucket if given."""
    rows = df if bucket is None else df.filter(F.col("bucket") == bucket)
    return rows.select(F.col(column).alias("value")).distinct().orderBy("value").limit(most)


def top_tags(tags: DataFrame, most: int = 50) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("node_id").alias("degree")).orderBy(F.col("degree").desc(), "tag").limit(most)


def hub_atoms(tags: DataFrame, most: int = 50) -> DataFrame:
    return tags.groupBy("node_id").agg(F.count_distinct("tag").alias("degree")).orderBy(F.col("degree").desc(), "node_id").limit(most)


def source_counts(documents: DataFrame, source: str = "source") -> DataFrame:
    return documents.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))


def frequent_entities(entities: DataFrame, known: dict[str, list[str]], most: int = 50) -> DataFrame:
    """(entity, n, category): entities seen more than once, with the list they are in. entities: entity, one row a use."""
    category = F.lit("concept")
    for name, values in known.items():
        category = F.when(F.lower("entity").isin([v.lower() for v in values]), name).otherwise(category)
    return entities.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "entity").limit(most).withColumn("category", category)


def graph_report(tags: DataFrame, documents: DataFrame, most: int = 50) -> DataFrame:
    """(section, rank, key, value): top tags, hubs and sources."""
    ranked = lambda name, df, key, value: df.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(F.col(value).desc(), key)).cast("long").alias("rank"), F.col(key).cast("string").alias("key"), F.col(value).cast("long").alias("value"))  # noqa: E731  at most `most` rows each
    sources = source_counts(documents).orderBy(F.col("n").desc(), "source").limit(most)
    return ranked("tags", top_tags(tags, most), "tag", "degree").unionByName(ranked("hubs", hub_atoms(tags, most), "node_id", "degree")).unionByName(ranked("sources", sources, "source", "n"))


def report_markdown(report: DataFrame) -> DataFrame:
    """The report as lines of Markdown, in order."""
    return report.orderBy("section", "rank").select(F.format_string("- %s %d: %s (%d)", "section", "rank", "key", "value").alias("value"))


def global_tags(rows: DataFrame, column: str = "tags", k: int = 50) -> DataFrame:
    """(tag): the first k distinct non-empty tags of the arrays, by name."""
    return rows.select(F.explode(column).alias("tag")).filter("tag <> ''").distinct().orderBy("tag").limit(k)

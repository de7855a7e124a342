"""Lifecycle of stored tables: upserts, incremental ingest, purges, quarantine and checks.

Tables are immutable Parquet; every job gives the new table, to be written as a new version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows of both; on equal keys the new ones win, or with replace=False the old ones."""
    if replace:
        return existing.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)
    return existing.unionByName(rows.join(existing.select(keys).distinct(), keys, "left_anti"))


def ingest_outcomes(rows: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows with `hash` and `outcome`: error for empty content, skipped for a known or repeated hash, else imported."""
    from .windows import top_k

    hashed = rows.withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    first = top_k(hashed, ["hash"], [key], 1).select("hash", F.col(key).alias("_first"))
    known = ledger.select("hash").distinct().withColumn("_known", F.lit(True))
    marked = hashed.join(first, "hash").join(known, "hash", "left")
    outcome = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "error").when(F.col("_known") | (F.col(key) != F.col("_first")), "skipped").otherwise("imported")
    return marked.withColumn("outcome", F.coalesce(outcome, F.lit("imported"))).drop("_known", "_first")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def changes(rows: DataFrame, ledger: DataFrame, path: str = "path") -> DataFrame:
    """(path, hash, change): new, changed and unchanged paths against the ledger (path, hash). Paths that left are `removed`."""
    now = rows.select(F.col(path).alias("path"), F.sha2("text", 256).alias("hash")).distinct()
    both = now.join(ledger.select("path", F.col("hash").alias("old")), "path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("old") == F.col("hash"), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("hash", "old").alias("hash"), change.alias("change"))


def incremental_ingest(rows: DataFrame, stored: DataFrame, ledger: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(stored, ledger) after rows came in: unchanged paths stay, changed ones are purged and replaced."""
    diff = changes(rows, ledger, path)
    fresh = diff.filter("change in ('new', 'changed')").select(F.col("path").alias(path))
    kept = stored.join(fresh, path, "left_anti").unionByName(rows.join(fresh, path, "left_semi").select(stored.columns))
    return kept, upsert(ledger.select("path", "hash"), diff.filter("change in ('new', 'changed')").select("path", "hash"), ["path"])


def purge(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of doomed compounds (compound_id), edges at either end included.

    tables: molecules (mol_id, compound_id), tags (node_id), edges (source_id, target_id), positions (compound_id), documents (doc_id).
    """
    gone = doomed.select("compound_id").distinct()
    ids = tables["molecules"].join(gone, "compound_id", "left_semi").select(F.col("mol_id").cast("string").alias("id")).unionByName(gone.select(F.col("compound_id").cast("string").alias("id")))
    without = lambda df, column: df.join(ids.withColumnRenamed("id", "_id"), df[column].cast("string") == F.col("_id"), "left_anti")
    out = {"molecules": tables["molecules"].join(gone, "compound_id", "left_anti"), "positions": tables["positions"].join(gone, "compound_id", "left_anti"), "tags": without(tables["tags"], "node_id"), "edges": without(without(tables["edges"], "source_id"), "target_id")}
    if "documents" in tables:
        out["documents"] = without(tables["documents"], "doc_id")
    return out


def purge_source(tables: dict[str, DataFrame], documents: DataFrame, source: str) -> dict[str, DataFrame]:
    return purge(tables, documents.filter(F.col("source") == source).select(F.col("doc_id").alias("compound_id")))


def purge_directory(tables: dict[str, DataFrame], documents: DataFrame, prefix: str, path: str = "path") -> dict[str, DataFrame]:
    inside = F.col(path).startswith(prefix.rstrip("/") + "/")
    return purge(tables, documents.filter(inside).select(F.col("doc_id").alias("compound_id")))


MARKS = ("#quarantined", "#manually_quarantined")


def quarantine(nodes: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    """Nodes with listed ones in quarantine and marked. nodes: provenance, tags."""
    marked = nodes.join(ids.select(key).distinct().withColumn("_q", F.lit(True)), key, "left")
    hit = F.coalesce("_q", F.lit(False))
    return marked.withColumn("provenance", F.when(hit, "quarantine").otherwise(F.col("provenance"))).withColumn("tags", F.when(hit, F.array_union("tags", F.array(F.lit(MARKS[1])))).otherwise(F.col("tags"))).drop("_q")


def restore_quarantined(nodes: DataFrame, ids: DataFrame, key: str = "node_id", provenance: str = "internal") -> DataFrame:
    marked = nodes.join(ids.select(key).distinct().withColumn("_q", F.lit(True)), key, "left")
    hit = F.coalesce("_q", F.lit(False)) & (F.col("provenance") == "quarantine")
    return marked.withColumn("tags", F.when(hit, F.array_except("tags", F.array(*[F.lit(m) for m in MARKS]))).otherwise(F.col("tags"))).withColumn("provenance", F.when(hit, provenance).otherwise(F.col("provenance"))).drop("_q")


def list_quarantined(nodes: DataFrame, ts: str, key: str = "node_id", most: int = 100) -> DataFrame:
    return nodes.filter("provenance = 'quarantine'").orderBy(F.col(ts).desc(), key).limit(most)


def delete_quarantined(nodes: DataFrame, ids: DataFrame, key: str = "node_id") -> DataFrame:
    doomed = nodes.join(ids.select(key).distinct(), key, "left_semi").filter("provenance = 'quarantine'").select(key)
    return nodes.join(doomed, key, "left_anti")


def validate_provenance(nodes: DataFrame, key: str = "node_id", path: str = "path") -> DataFrame:
    """(key, problem): rows without id or path, or that end before they start."""
    problem = F.when(F.col(key).isNull(), "no id").when(F.coalesce(F.col(path), F.lit("")) == "", "no path").when(F.col("end_byte") < F.col("start_byte"), "ends before it starts")
    return nodes.select(key, problem.alias("problem")).filter("problem is not null")


def _count(df: DataFrame, check: str, condition: Column | str | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    return rows.agg(F.lit(check).alias("check"), F.count("*").alias("violations"))


def integrity_checks(molecules: DataFrame, documents: DataFrame, tags: DataFrame, edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """(check, violations). provenance: source, provenance."""
    parts = [
        _count(molecules.join(documents.select(F.col("doc_id").alias("compound_id")), "compound_id", "left_anti"), "molecules without document"),
        _count(tags.join(molecules.select(F.col("mol_id").alias("node_id")), "node_id", "left_anti"), "tags without molecule"),
        _count(provenance.groupBy("source").agg(F.count_distinct("provenance").alias("n")), "sources of several provenances", "n > 1"),
        _count(documents.groupBy("doc_id").agg(F.count("*").alias("n")), "repeated document ids", "n > 1"),
        _count(tags.groupBy("node_id", "tag", "bucket").agg(F.count("*").alias("n")), "repeated tag rows", "n > 1"),
        _count(edges.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("n")), "repeated edges", "n > 1"),
    ]
    return reduce(DataFrame.unionByName, parts)

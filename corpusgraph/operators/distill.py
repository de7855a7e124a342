"""Line-level distillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import near_blocks
from .positions import stored
from .windows import top_k


def collect_for_distill(molecules: DataFrame, compounds: list | None = None, buckets: list[str] | None = None, terms: list[str] | None = None) -> DataFrame:
    """Rows (compound_id, bucket, content) of listed compounds or buckets, or with any of the terms."""
    wanted = F.lit(False) if compounds or buckets or terms else F.lit(True)
    if compounds:
        wanted = wanted | F.col("compound_id").isin(compounds)
    if buckets:
        wanted = wanted | F.col("bucket").isin(buckets)
    if terms:
        wanted = wanted | F.arrays_overlap(T.words(F.col("content")), F.array(*[F.lit(x.lower()) for x in terms]))
    return molecules.filter(wanted)


def lines(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, source, line_no, content, hash) of the non-blank lines of distinct blocks."""
    return lines_of(top_k(blocks.withColumn("_h", F.sha2("text", 256)), ["_h"], ["doc_id"], 1), strict)


def lines_of(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """The same of all blocks, equal ones too."""
    rows = blocks.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "content"))
    rows = rows.withColumn("norm", T.normalize_line(F.col("content"), strict)).filter("norm <> ''")
    return rows.withColumn("hash", F.sha2("norm", 256))


def distill_lines(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """(hash, content, sources, n, first_doc): each distinct line with its first form, its sources and its count."""
    rows = lines(blocks, strict)
    place = F.struct("doc_id", "line_no")
    return rows.groupBy("hash").agg(F.min_by("content", place).alias("content"), F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min(place)["line_no"].alias("first_line"))


def distill_stats(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """(total, unique, duplicate, ratio)."""
    counts = lines(blocks, strict).groupBy("hash").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"), F.count("*").alias("unique_lines"))
    ratio = F.when(F.col("unique_lines") > 0, F.concat(F.format_string("%.2f", F.col("total") / F.col("unique_lines")), F.lit(":1"))).otherwise("1.00:1")
    return total.select("total", "unique_lines", (F.col("total") - F.col("unique_lines")).alias("duplicate_lines"), ratio.alias("ratio"))


def distill_incremental(blocks: DataFrame, processed: DataFrame, strict: bool = True) -> DataFrame:
    """distill_lines of the blocks whose doc_id isn't in the ledger of processed ones."""
    return distill_lines(blocks.join(processed.select("doc_id").distinct(), "doc_id", "left_anti"), strict)


def distill_by_tag(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, total, unique_lines): lines of the blocks of each tag. tags: doc_id, tag."""
    rows = lines(blocks).join(tags.select("doc_id", "tag").distinct(), "doc_id").groupBy("tag", "hash").agg(F.count("*").alias("n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("unique_lines"))


def distill_tags_near(blocks: DataFrame, tags: DataFrame, distance: int = 3) -> DataFrame:
    """(tag, blocks, kept, total, unique_lines): each class of near-duplicate blocks is one block with the tags of all its members.

    Classes are made over all tags at once, so a text is read and cut once, for the smallest id of its class; then each tag has
    the lines of its classes. tags: doc_id, tag.
    """
    roots = near_blocks(blocks, distance)
    named = tags.select("doc_id", "tag").distinct().join(roots, "doc_id")
    sizes = named.groupBy("tag").agg(F.count_distinct("doc_id").alias("blocks"), F.count_distinct("root").alias("kept"))
    first = blocks.join(roots.select(F.col("root").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counted = lines_of(first).groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    held = counted.join(named.select(F.col("root").alias("doc_id"), "tag").distinct(), "doc_id").groupBy("tag", "hash").agg(F.sum("n").alias("n"))
    per = held.groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("unique_lines"))
    return sizes.join(per, "tag", "left").fillna(0, ["total", "unique_lines"])


def reassemble(distilled: DataFrame, lines_per_chunk: int = 1000, parts: int = 200) -> DataFrame:
    """(chunk, place, content) in order of first appearance.

    Places come from ordered range partitions and their sizes, so no task holds more than its range. The ranges come from
    samples and would differ between two readings, so sizes and rows are taken from one that is written.
    """
    ordered = distilled.repartitionByRange(parts, "first_doc", "first_line").sortWithinPartitions("first_doc", "first_line", "hash")
    held = stored(ordered.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "content"), "ordered")
    sizes = held.groupBy("p").agg(F.count("*").alias("size"), F.min("i").alias("low"))
    from pyspark.sql.window import Window

    offsets = sizes.withColumn("before", F.sum("size").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))  # one row for each part
    placed = held.join(F.broadcast(offsets.select("p", "low", "before")), "p").withColumn("place", F.col("i") - F.col("low") + F.col("before"))
    return placed.select(F.floor(F.col("place") / lines_per_chunk).cast("long").alias("chunk"), "place", "content")


def title_of(text: Column) -> Column:
    return T.truncate_sentence(F.trim(F.regexp_replace(T.strip_inline_tags(F.element_at(F.split(text, "\n"), 1)), r"^[#*\-\s]+", "")), 80)


def decision_records(distilled: DataFrame, least: int = 10) -> DataFrame:
    """(hash, title, summary, content, tags) of distilled lines of `least` characters or more."""
    clean = T.strip_inline_tags(F.col("content"))
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit("#[A-Za-z][A-Za-z0-9_]+"), F.lit(0))))
    out = distilled.withColumn("clean", clean).filter(F.length("clean") >= least)
    return out.select("hash", title_of(F.col("clean")).alias("title"), T.truncate_sentence(F.col("clean"), 200).alias("summary"), F.col("clean").alias("content"), tags.alias("tags"))


def record_run(stats: DataFrame, session: str, buckets: list[str], parameters: dict, at: str) -> DataFrame:
    """One row of the run ledger."""
    import json

    values = F.array(*[F.lit(b) for b in buckets]) if buckets else F.array().cast("array<string>")
    return stats.select(F.sha2(F.concat_ws("|", F.lit(session), F.lit(at), F.lit(json.dumps(parameters, sort_keys=True))), 256).alias("run_id"), F.lit(session).alias("session"), values.alias("buckets"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), F.lit(at).cast("timestamp").alias("at"), "total", "unique_lines", "ratio")


def runs(ledger: DataFrame, session: str | None = None, bucket: str | None = None, parameter: tuple[str, str] | None = None) -> DataFrame:
    out = ledger
    if session is not None:
        out = out.filter(F.col("session") == session)
    if bucket is not None:
        out = out.filter(F.array_contains("buckets", bucket))
    if parameter is not None:
        out = out.filter(F.get_json_object("parameters", f"$.{parameter[0]}") == parameter[1])
    return out


def delete_runs(ledger: DataFrame, ids: list[str]) -> DataFrame:
    return ledger.filter(~F.col("run_id").isin(ids))

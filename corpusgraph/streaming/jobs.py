"""Structured Streaming: ingest, dedup, distillation and sessions as their batch jobs, run on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _version(folder: str, epoch: int) -> str:
    return f"{folder}/epoch={epoch}"


def stream_ingest(rows: DataFrame, table: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Appends rows of unseen content to `table`; a content hash is stored once.

    Each micro-batch writes its own folder and overwrites it if it runs again, so a restart repeats
    nothing. A batch is joined to hashes of earlier folders only.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("hash", F.sha2(F.coalesce(text, F.lit("")), 256)).filter(F.trim(F.coalesce(text, F.lit(""))) != "")
        first = hashed.groupBy("hash").agg(F.min_by(F.struct(*batch.columns), key).alias("r")).select("hash", "r.*")
        fresh = first
        if epoch:
            known = spark.read.schema("hash string, epoch long").parquet(table).filter(F.col("epoch") < epoch).select("hash")
            fresh = first.join(known, "hash", "left_anti")
        fresh.write.mode("overwrite").parquet(_version(table, epoch))

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(rows: DataFrame, ts: str, late: str = "1 hour", text: str = "text") -> DataFrame:
    """Rows whose content hash wasn't seen within the watermark."""
    return rows.withColumn("hash", F.sha2(text, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def stream_distill(rows: DataFrame, table: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Keeps counts of distinct lines as one partial table for each micro-batch; distilled() sums them."""

    def store(batch: DataFrame, epoch: int) -> None:
        lines = batch.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "content")).withColumn("norm", T.normalize_line(F.col("content"))).filter("norm <> ''")
        place = F.struct(key, "line_no")
        counts = lines.groupBy(F.sha2("norm", 256).alias("hash")).agg(F.count("*").alias("n"), F.min(place).alias("place"), F.min_by("content", place).alias("content"))
        counts.write.mode("overwrite").parquet(_version(table, epoch))

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distilled(spark: SparkSession, table: str) -> DataFrame:
    """(hash, content, n) over all micro-batches."""
    return spark.read.parquet(table).groupBy("hash").agg(F.min_by("content", "place").alias("content"), F.sum("n").alias("n"))


def stream_sessions(events: DataFrame, source: str, ts: str, late: str = "2 hours", gap: str = "1 hour") -> DataFrame:
    """(source, started, ended, n) of sessions; rows exactly `gap` apart stay together, later ones than the watermark are dropped."""
    windowed = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(source).alias("source"))
    return windowed.agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended")).select("source", "started", "ended", "n")

"""Streams whose memory is keyed state instead of a table: each micro-batch touches only the state of what came in.

State is kept by prefixes of content hashes: 16 ** PREFIX groups spread evenly over the state partitions, and a hash is one entry of
its group's map in the RocksDB state store, so state may outgrow memory and a batch costs what it brings, not what is stored. A
restart goes on from the checkpoint; rows later than the watermark are dropped before they reach the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PREFIX = 2


def keep_in_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, which keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """One frame of plain Python values, none for no rows."""
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object).convert_dtypes(convert_string=False)


class FirstSeen(StatefulProcessor):
    """Lets a content hash pass once; of a batch's rows the one with the smallest key. Hashes are forgotten after `ttl_ms`."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best: dict[str, tuple] = {}
        for part in rows:
            for hash_, id_ in zip(part["hash"], part["key"]):
                if hash_ not in best or id_ < best[hash_]:
                    best[hash_] = id_
        fresh = [h for h in best if not self.seen.containsKey((h,))]
        for h in fresh:
            self.seen.updateValue((h,), (pd.Timestamp.now(),))
        yield from _frames([(best[h], h) for h in fresh], ["key", "hash"])

    def close(self) -> None:
        pass


def unseen(rows: DataFrame, key: str = "doc_id", text: str = "text", ttl_ms: int | None = None) -> DataFrame:
    """(key, hash) of rows whose content no earlier row had (within `ttl_ms`); blank texts don't pass. Texts stay out of the state.

    A time to live makes Spark run batches without data for ever: such a stream is for a processing-time trigger, not availableNow.
    """
    keep_in_rocksdb(rows.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    own = rows.filter(F.trim(content) != "").select(F.col(key).cast("long").alias("key"), F.sha2(content, 256).alias("hash")).withColumn("prefix", F.left("hash", F.lit(PREFIX)))
    found = own.groupBy("prefix").transformWithStateInPandas(FirstSeen(ttl_ms), "key long, hash string", "Append", "ProcessingTime" if ttl_ms else "None")
    return found.withColumnRenamed("key", key)


class LineCounts(StatefulProcessor):
    """Counts of lines; with `idle_ms` a group that got nothing for so long gives its lines and forgets them, else every batch gives what changed."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "hash string", "n long, place string, content string")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch: dict[str, tuple[int, str, str]] = {}
        latest = 0
        for part in rows:
            for hash_, place, content, at in zip(part["hash"], part["place"], part["content"], part["at"]):
                n, p, c = batch.get(hash_, (0, place, content))
                batch[hash_] = (n + 1, *min((p, c), (place, content)))
                latest = max(latest, int(at))
        changed = []
        for hash_, (n, place, content) in batch.items():
            if self.lines.containsKey((hash_,)):
                m, p, c = self.lines.getValue((hash_,))
                n, (place, content) = n + m, min((p, c), (place, content))
            self.lines.updateValue((hash_,), (n, place, content))
            changed.append((hash_, content, n))
        if self.idle_ms is None:
            yield from _frames(changed, ["hash", "content", "n"])
            return
        due = latest + self.idle_ms
        if self.due.exists():
            (old,) = self.due.get()
            if old >= due:
                return
            self.handle.deleteTimer(old)
        self.due.update((due,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = [(h, content, n) for (h,), (n, _, content) in self.lines.iterator()]
        self.lines.clear()
        self.due.clear()
        yield from _frames(rows, ["hash", "content", "n"])

    def close(self) -> None:
        pass


def distill(rows: DataFrame, key: str = "doc_id", text: str = "text", ts: str | None = None, late: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """(hash, content, n): distinct lines and how often they came, in the wording of the first (key, line).

    Without idle_ms the lines a batch touched come with their new totals (output mode update). With it, and event times `ts`, the lines of a
    prefix come once, as soon as the watermark is idle_ms past the last of them.
    """
    keep_in_rocksdb(rows.sparkSession)
    if idle_ms is not None:
        rows = rows.withWatermark(ts, late)
    at = F.unix_millis(ts) if ts else F.lit(0).cast("long")
    lines = rows.select(key, *([ts] if ts else []), at.alias("at"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "content")).withColumn("norm", T.normalize_line(F.col("content"))).filter("norm <> ''")
    # places sort as text: ids and line numbers in fixed width
    place = F.format_string("%020d:%010d", F.col(key).cast("long"), F.col("line_no"))
    keyed = lines.select(*([ts] if ts else []), "at", F.sha2("norm", 256).alias("hash"), place.alias("place"), "content").withColumn("prefix", F.left("hash", F.lit(PREFIX)))
    return keyed.groupBy("prefix").transformWithStateInPandas(LineCounts(idle_ms), "hash string, content string, n long", "Update" if idle_ms is None else "Append", "EventTime" if idle_ms is not None else "None")

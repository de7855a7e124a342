"""Merges of ranges as table functions: sorted rows stream through with one row of state, so a group may exceed a task's memory.

The functions themselves ask for their partitioning and order. In SQL, after register(spark):

    SELECT * FROM merge_byte_windows(TABLE(positions), 500, 500, 4000)
    SELECT * FROM merge_near_anchors(TABLE(hits), 50)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn


def _windows():
    class MergeByteWindows:
        @staticmethod
        def analyze(rows, radius, gap, most) -> AnalyzeResult:
            schema = StructType([rows.dataType["compound_id"], StructField("start_byte", LongType()), StructField("end_byte", LongType())])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("compound_id")], orderBy=[OrderingColumn("byte_offset")])

        def __init__(self):
            self.held = None

        def eval(self, rows, radius, gap, most):
            at = rows["byte_offset"]
            if at is None:
                return
            start, end = max(0, at - radius), at + radius
            if self.held is not None:
                key, first, last = self.held
                if start - last < gap and end - first <= most:
                    self.held = (key, first, max(last, end))
                    return
                yield self.held
            self.held = (rows["compound_id"], start, end)

        def terminate(self):
            if self.held is not None:
                yield self.held

    return F.udtf(MergeByteWindows)


def _anchors():
    class MergeNearAnchors:
        @staticmethod
        def analyze(rows, near) -> AnalyzeResult:
            order = [OrderingColumn(c) for c in ("start_byte", "end_byte", "node_id")]
            return AnalyzeResult(schema=rows.dataType, partitionBy=[PartitioningColumn("query_id"), PartitioningColumn("compound_id")], orderBy=order)

        def __init__(self):
            self.held = None

        def eval(self, rows, near):
            if rows["start_byte"] is None or rows["end_byte"] is None:
                return
            if self.held is not None:
                a, b, x, y = self.held["start_byte"], self.held["end_byte"], rows["start_byte"], rows["end_byte"]
                over, small = min(b, y) - max(a, x), max(1, min(b - a, y - x))
                alike = abs(x - a) < 5 and abs(y - b) < 5
                if x <= b + near and (alike or over >= small or over > 0.5 * small):
                    if (rows["score"] or 0) > (self.held["score"] or 0):
                        self.held = rows
                    return
                yield tuple(self.held)
            self.held = rows

        def terminate(self):
            if self.held is not None:
                yield tuple(self.held)

    return F.udtf(MergeNearAnchors)


def merge_byte_windows(rows: DataFrame, radius: int, gap: int = 500, most: int = 4000) -> DataFrame:
    """(compound_id, start_byte, end_byte): windows of +-radius around offsets, merged from left to right while the space between
    them is under `gap` and the whole at most `most` bytes. rows: compound_id, byte_offset, more columns are ignored. Null offsets
    give no window, null compounds are one group, repeated offsets change nothing."""
    return _windows()(rows.select("compound_id", "byte_offset").asTable(), F.lit(radius), F.lit(gap), F.lit(most))


def merge_near_anchors(rows: DataFrame, near: int = 50) -> DataFrame:
    """Within (query_id, compound_id), in byte order: of ranges that nearly equal, contain or overlap by half, the best stays.

    rows: query_id, compound_id, node_id, start_byte, end_byte, score and any others, which stay. The first of equal scores stays, a
    null score counts 0, rows without a range go.
    """
    return _anchors()(rows.asTable(), F.lit(near))


def register(spark: SparkSession) -> None:
    """Makes both available to spark.sql."""
    spark.udtf.register("merge_byte_windows", _windows())
    spark.udtf.register("merge_near_anchors", _anchors())

"""Frame verbs and a small query builder over tables.

Every verb takes and gives a DataFrame, so a chain of them is one Catalyst plan. Functions of rows may
be Columns or SQL text; a plain Python function goes through `vectorized`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(f"%{v}%"),
    "CONTAINS": lambda c, v: c.like(f"%{v}%"),
}


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table or field name: {name!r}")
    return name


class Query:
    """select, where, order_by, limit and transform over one table; nothing runs before an action."""

    def __init__(self, df: DataFrame):
        self._df = df

    def select(self, *fields: str) -> Query:
        return self if not fields or fields == ("*",) else Query(self._df.select(*[checked_name(f) for f in fields]))

    def where(self, field: str, op: str, value: object) -> Query:
        """Conditions are joined by AND; LIKE and CONTAINS both look for the value anywhere; an unknown operator means equality."""
        compare = _COMPARE.get(op.upper(), _COMPARE["="])
        return Query(self._df.filter(compare(F.col(checked_name(field)), value)))

    def order_by(self, field: str, direction: str = "ASC") -> Query:
        """Nulls come last in ascending and first in descending order."""
        c = F.col(checked_name(field))
        return Query(self._df.orderBy(c.desc_nulls_first() if direction.upper() == "DESC" else c.asc_nulls_last()))

    def limit(self, n: int) -> Query:
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError("limit needs a positive whole number")
        return Query(self._df.limit(n))

    def transform(self, columns: Mapping[str, Column | str]) -> Query:
        return Query(transform_cols(self._df, columns))

    def to_df(self) -> DataFrame:
        return self._df


def query(source: SparkSession | DataFrame, table: str | None = None) -> Query:
    return Query(source if isinstance(source, DataFrame) else source.table(checked_name(table or "")))


def vectorized(function: Callable[[pd.Series], pd.Series], returns: str):
    """A Python function over whole columns, run on Arrow batches."""
    return F.pandas_udf(function, returns)


def vectorized_agg(function: Callable[[pd.Series], object], returns: str):
    """A Python aggregate over the values of a group of bounded size."""
    @F.pandas_udf(returns, F.PandasUDFType.GROUPED_AGG)
    def aggregate(values):
        return function(values)

    return aggregate


def select_cols(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    return df.select(*[_column(c).alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def transform_cols(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Adds or replaces columns; all expressions see the input row."""
    return df.withColumns({n: _column(c) for n, c in columns.items()})


def sort_rows(df: DataFrame, column: str, direction: str = "asc", tie: str | None = None) -> DataFrame:
    """Nulls count as smallest: first in ascending, last in descending order."""
    c = F.col(column)
    keys = [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first()]
    return df.orderBy(*keys, *([tie] if tie else []))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def skip(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(n)


def tail(df: DataFrame, n: int, column: str) -> DataFrame:
    return df.orderBy(F.col(column).desc()).limit(n)


def list_rows(df: DataFrame, order: str, allowed: tuple[str, ...], limit: int = 50, offset: int = 0, tie: str | None = None) -> DataFrame:
    """A page of rows, newest first; at most 100 and ordered by a listed column only."""
    order = order if order in allowed else allowed[0]
    return df.orderBy(F.col(order).desc(), *([tie] if tie else [])).offset(max(0, offset)).limit(min(100, max(1, limit)))


def group_rows(df: DataFrame, column: str) -> DataFrame:
    """(key, rows): each value with its rows; null is a group of its own. For groups of bounded size."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("key")).agg(F.collect_list(F.struct("*")).alias("rows"))


def agg_all(df: DataFrame, aggregates: Mapping[str, Column | str], by: list[str] | None = None) -> DataFrame:
    columns = [_column(c).alias(n) for n, c in aggregates.items()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def column_names(df: DataFrame) -> DataFrame:
    """(position, name, type) of the columns."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "position int, name string, type string")


# --- predicates -------------------------------------------------------------------------------------


def has_any(array: Column, values: list) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values]))


def has(array: Column, value: object) -> Column:
    return F.array_contains(array, value)


def ilike_contains(text: Column, part: str, prefix: bool = False) -> Column:
    return text.ilike(f"{part}%" if prefix else f"%{part}%")


def by_provenance(df: DataFrame, wanted: str, column: str = "provenance") -> DataFrame:
    """`all` means everything but quarantine; any other value means itself."""
    c = F.coalesce(F.col(column), F.lit("internal"))
    return df.filter(c != "quarantine" if wanted == "all" else c == wanted)


def in_range(column: Column, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high)
    return out


def under_tagged(df: DataFrame, text: str = "content", tags: str = "tags", chars: int = 500, least: int = 2) -> DataFrame:
    return df.filter((F.length(text) > chars) & (F.col(tags).isNull() | (F.size(tags) < least)))


# --- joins and set operations -----------------------------------------------------------------------


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of a table for a batch of keys; adaptive execution picks the join by the keys' size."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def self_pairs(df: DataFrame, row: str, value: str) -> DataFrame:
    """(a, b) of values of one row with a < b."""
    left = df.select(F.col(row).alias("_row"), F.col(value).alias("a"))
    right = df.select(F.col(row).alias("_row"), F.col(value).alias("b"))
    return left.join(right, "_row").filter("a < b").select("a", "b")


def byte_range_join(rows: DataFrame, anchors: DataFrame, radius: int = 500, bin_bytes: int = 1 << 16) -> DataFrame:
    """Rows of the anchor's document that overlap it, widened by radius. A byte bin joins the key, so one huge document is dealt out.

    rows: compound_id, node_id, start_byte, end_byte; anchors: compound_id, anchor_id, start_byte, end_byte.
    """
    span = lambda a, b: F.explode(F.sequence((F.greatest(a, F.lit(0)) / bin_bytes).cast("long"), (F.greatest(b, F.lit(0)) / bin_bytes).cast("long")))
    left = rows.select("compound_id", "node_id", "start_byte", "end_byte").withColumn("bin", span(F.col("start_byte"), F.col("end_byte")))
    right = anchors.select("compound_id", "anchor_id", (F.col("start_byte") - radius).alias("low"), (F.col("end_byte") + radius).alias("high")).withColumn("bin", span(F.col("low"), F.col("high")))
    met = left.join(right, ["compound_id", "bin"]).filter("end_byte >= low and start_byte <= high")
    first = F.greatest((F.greatest("start_byte", F.lit(0)) / bin_bytes).cast("long"), (F.greatest("low", F.lit(0)) / bin_bytes).cast("long"))
    return met.filter(F.col("bin") == first).select("anchor_id", "node_id", "compound_id", "start_byte", "end_byte")


def union_first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; of equal keys the row of the earliest part stays."""
    ranked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_part"))).filter("_n = 1").drop("_part", "_n")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap_share(a: Column, b: Column) -> Column:
    """Intersection over the smaller set."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)

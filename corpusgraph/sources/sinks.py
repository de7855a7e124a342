"""Writing results, and backups of tables as tagged JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_results(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """csv, json, yaml, parquet or table (padded text of a bounded page)."""
    if fmt == "csv":
        flat = df.select([F.col(n).cast("string").alias(n) if t.startswith(("array", "map", "struct")) is False else F.to_json(n).alias(n) for n, t in df.dtypes])
        flat.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "yaml":
        df.select(yaml_line(df)).write.mode(mode).text(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "table":
        table_lines(df).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format: {fmt!r}")


def yaml_line(df: DataFrame):
    """A row as an item of a YAML list in flow style."""
    return F.concat(F.lit("- "), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value")


def table_lines(df: DataFrame, width: int = 24) -> DataFrame:
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), width, " ") for c in df.columns]
    return df.select(F.concat_ws(" | ", *cells).alias("value"))


def backup_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): rows of all tables as JSON, each with the name of its table."""
    parts = [df.select(F.to_json(F.struct(F.lit(name).alias("_table"), *df.columns)).alias("value")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def restore_tables(lines: DataFrame, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of a backup; rows of other names are left out."""
    named = lines.withColumn("_table", F.get_json_object("value", "$._table"))
    return {name: named.filter(F.col("_table") == name).select(F.from_json("value", schema).alias("r")).select("r.*") for name, schema in schemas.items()}


def restore_from(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    return restore_tables(spark.read.text(path), schemas)

"""Tables laid out by hash buckets of a key, so that a change rewrites only the buckets it touches.

A table is a folder of Parquet partitions `_bucket=0` to `_bucket=n-1`. A change finds its buckets (at most n numbers reach the driver), reads
these partitions only, and replaces them by dynamic partition overwrite: new files are staged and moved in when the
job commits, files of all other buckets stay as they are. Choose n so that a bucket is a few files; `files` deals each
bucket out to so many tasks. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table: rows whose `keys` are equal share a bucket."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 64
    files: int = 1

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        named = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket())
        spread = named.repartition(min(self.buckets * self.files, 4096), BUCKET, F.pmod(F.xxhash64(*self.schema.names), F.lit(self.files)))
        spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> Bucketed:
        self._write(rows, "error")
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(BUCKET, "integer")).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _touched(self, rows: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets of some keys and what is stored in them."""
        found = [r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect()]
        return found, self._stored().filter(F.col(BUCKET).isin(found)).drop(BUCKET)

    def upsert(self, rows: DataFrame, replace: bool = True) -> list[int]:
        """Rows come in; those of equal keys go first, or with replace=False stay and keep the new ones out. Gives the buckets it wrote."""
        found, stored = self._touched(rows)
        if not found:
            return found
        if replace:
            merged = self._apart(stored, rows).unionByName(rows.select(*self.schema.names))
        else:
            merged = stored.unionByName(self._apart(rows.select(*self.schema.names), stored))
        self._write(merged, "overwrite")
        return found

    def remove(self, keys: DataFrame) -> list[int]:
        """Rows with these keys go. Gives the buckets it wrote."""
        found, stored = self._touched(keys)
        if not found:
            return found
        left = self._apart(stored, keys)
        kept = {r[0] for r in left.select(self.bucket().alias(BUCKET)).distinct().collect()}
        self._write(left, "overwrite")
        for empty in set(found) - kept:  # nothing is written to these, so nothing replaced them
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={empty}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return found

    def _apart(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """rows whose keys (nulls are equal) aren't among the others'."""
        named = others.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(named, same, "left_anti")


def ingest_changed(table: Bucketed, ledger: Bucketed, rows: DataFrame, path: str = "path") -> list[int]:
    """Rows of new and changed paths replace what is stored of them; table and ledger (path, hash) are bucketed by the path.

    The table goes first, so that after a failure the same rows come in again. Gives the buckets of the table it wrote.
    """
    from .lifecycle import changes

    fresh = changes(rows, ledger.read(), path).filter("change in ('new', 'changed')").select("path", "hash")
    wrote = table.upsert(rows.join(fresh.select(F.col("path").alias(path)), path, "left_semi"))
    ledger.upsert(fresh)
    return wrote

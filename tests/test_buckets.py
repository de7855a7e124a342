"""Bucketed tables: what a change leaves alone, equal keys, nulls, emptied buckets, repeated ingests."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import buckets


def files(table):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(table.path) for n in names if n.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n_files", [1, 3])
def test_untouched_buckets_stay(spark, tmp_path, n_files):
    old = spark.createDataFrame([(i if i else None, f"v{i}") for i in range(200)], "k long, v string")
    table = buckets.Bucketed(spark, str(tmp_path / "t"), old.schema, ("k",), 16, n_files).create(old)
    before = files(table)
    new = spark.createDataFrame([(5, "new"), (5, "new twice"), (1000, "more"), (None, "null")], old.schema)
    wrote = table.upsert(new)
    assert rows_of(table.read()) == sorted([(i, f"v{i}") for i in range(1, 200) if i != 5] + [(5, "new"), (5, "new twice"), (1000, "more"), (None, "null")], key=str)
    after, touched = files(table), {f"_bucket={b}" for b in wrote}
    alone = {f: t for f, t in before.items() if not any(f"/{b}/" in f for b in touched)}
    assert alone and all(after.get(f) == t for f, t in alone.items())
    assert not any(f in after for f in before if f not in alone)
    table.upsert(spark.createDataFrame([(6, "no"), (2000, "yes")], old.schema), replace=False)
    assert {r.k: r.v for r in table.read().filter("k in (6, 2000)").collect()} == {6: "v6", 2000: "yes"}
    assert table.upsert(new.limit(0)) == []


def test_removal_empties_buckets(spark, tmp_path):
    old = spark.createDataFrame([(i % 5, i) for i in range(50)], "k long, v long")
    table = buckets.Bucketed(spark, str(tmp_path / "t"), old.schema, ("k",), 64).create(old)
    table.remove(spark.createDataFrame([(1,), (3,), (77,)], "k long"))
    assert rows_of(table.read()) == sorted([(i % 5, i) for i in range(50) if i % 5 not in (1, 3)], key=str)
    assert table.remove(old.select("k").limit(0)) == []


def test_ingest_of_changed_paths(spark, tmp_path):
    schema = "path string, text string"
    first = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], schema)
    table = buckets.Bucketed(spark, str(tmp_path / "t"), first.schema, ("path",), 32).create(first)
    known = first.select("path", F.sha2("text", 256).alias("hash"))
    ledger = buckets.Bucketed(spark, str(tmp_path / "l"), known.schema, ("path",), 32).create(known)
    before = files(table)
    again = spark.createDataFrame([("a", "one"), ("b", "two changed"), ("d", "four")], schema)
    wrote = buckets.ingest_changed(table, ledger, again)
    assert rows_of(table.read()) == [("a", "one"), ("b", "two changed"), ("c", "three"), ("d", "four")]
    assert len(wrote) <= 2 and sum(f in files(table) for f in before) >= 1
    assert buckets.ingest_changed(table, ledger, again) == []
    assert {r.path for r in ledger.read().collect()} == {"a", "b", "c", "d"}

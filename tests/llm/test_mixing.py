"""Mixing against its SQL on given and on made tables: edge cases, hot sources, equal rows at the edge of a sample."""

import collections

import duckdb
import pandas as pd
import pytest

from corpusgraph.llm import mixing
from corpusgraph.llm.common import read

EDGE = [(1, None, "b"), (2, "", "b"), (3, " \t\n", "b"), (4, "One two", None), (4, "One two", None), (None, "one two three", "a"), (None, "one two three", "a"), (5, "x " * 30_000, "c"), (6, "éß 中文 😀 it's", "é"), (7, None, "empty"), (8, None, None)]
SHOWN = ["doc_id", "size", "source_size", "target", "taken"]


def by_sql(rows):
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con.register("t", table)
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM t")
    return sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(SHOWN)} FROM ({mixing.OP11_SQL})").fetchall()), key=str)


def by_spark(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1.0, -1, "clash") for r in rows], "doc_id long, text string, source string, target double, cell int, rank string")
    return sorted((tuple(r) for r in mixing.mix(docs, **more).select(SHOWN).collect()), key=str)


def test_edge_cases(spark):
    assert by_spark(spark, EDGE) == by_sql(EDGE)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    none = [(1, None, "a"), (2, "", "b")]
    assert [r[-1] for r in by_spark(spark, none)] == [0, 0]


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_edges_of_samples(spark, buckets):
    """Few buckets: whole cells are ordered; many equal rows: some are taken once more."""
    rows = [(i, "w " * (1 + i % 37), f"s{min(i % 9, 4)}") for i in range(900)] + [(None, "same old text " * 3, "s1")] * 700 + [(7, "one more text", "s0")] * 60
    found = by_spark(spark, rows, buckets=buckets)
    assert found == by_sql(rows)
    same = collections.Counter(r[-1] for r in found if r[0] is None)
    assert len(same) == 2 and sum(same.values()) == 700


def test_targets(spark, sf):
    """Sources come near their targets, nothing is taken more than three times, the targets share all words, reruns agree."""
    docs = read(spark, sf, "documents")
    found = mixing.mix(docs).toPandas()
    sums = found.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()
    assert abs(sums.target.sum() - sums["size"].sum()) < 1e-6 * sums["size"].sum()
    assert ((sums.taken - sums.target).abs() <= 0.05 * sums.target + sums.most).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, found.values.tolist()))


def test_inclusion_follows_the_probabilities(spark):
    """Over many documents of one cell the share that is taken once more follows the tilted probabilities."""
    rows = [(i, "w " * (64 + i % 16), "a") for i in range(20_000)] + [(-1, "w " * 400_000, "b"), (-2, "w " * 400_000, "c")]
    found = pd.DataFrame(by_spark(spark, rows), columns=SHOWN)
    own = found[found["size"] < 1000]
    more = (own.taken / own["size"] - own.target.iloc[0] / own.source_size.iloc[0]).abs()
    assert more.max() < 1
    assert abs(own.taken.sum() / own.target.iloc[0] - 1) < 0.002

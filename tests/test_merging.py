"""Table functions for merges against loops over one group after the other."""

import random

from corpusgraph.operators import dedup, merging


def windows(offsets, radius, gap, most):
    out = []
    for at in sorted(offsets):
        a, b = max(0, at - radius), at + radius
        if out and a - out[-1][1] < gap and b - out[-1][0] <= most:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def test_windows(spark):
    r = random.Random(5)
    rows = [(c, r.randrange(40_000), "x") for c in ["a", "b", "c", None] for _ in range(80)] + [("a", None, "x"), ("d", None, "x"), ("e", 3, "x"), ("e", 3, "y")]
    df = spark.createDataFrame(rows, "compound_id string, byte_offset long, start_byte string").repartition(5)
    want = sorted(((c, a, b) for c in {x[0] for x in rows} for a, b in windows([x[1] for x in rows if x[0] == c and x[1] is not None], 300, 500, 4000)), key=str)
    assert sorted(map(tuple, merging.merge_byte_windows(df, 300).collect()), key=str) == want
    merging.register(spark)
    df.createOrReplaceTempView("offsets_")
    assert sorted(map(tuple, spark.sql("SELECT * FROM merge_byte_windows(TABLE(offsets_), 300, 500, 4000)").collect()), key=str) == want
    assert merging.merge_byte_windows(df.limit(0), 300).count() == 0


def test_one_large_group(spark):
    """All rows in one group stream through."""
    df = spark.range(400_000, numPartitions=8).selectExpr("1 AS compound_id", "id * 700 AS byte_offset")
    found = merging.merge_byte_windows(df, 100)
    rows = found.selectExpr("count(*) AS n", "max(end_byte - start_byte) AS most", "sum(end_byte - start_byte) AS covered").first()
    want = windows(range(0, 280_000_000, 700), 100, 500, 4000)
    assert (rows.n, rows.most, rows.covered) == (len(want), max(b - a for a, b in want), sum(b - a for a, b in want))


def test_anchors(spark):
    r = random.Random(8)
    rows = []
    for q in range(3):
        for c in ["a", "b"]:
            for i in range(60):
                a = r.randrange(3000)
                rows.append((q, c, f"n{i}", a, a + r.choice([3, 60, 61, 200]), float(r.randrange(5)), "tail"))
    df = spark.createDataFrame(rows, "query_id int, compound_id string, node_id string, start_byte long, end_byte long, score double, extra string").repartition(5)
    want = sorted(map(tuple, dedup.merge_anchors(df).collect()))
    assert sorted(map(tuple, merging.merge_near_anchors(df).collect())) == want and len(want) < len(rows)
    odd = spark.createDataFrame([(1, "a", "n", None, 4, 1.0), (1, "a", "n", 0, 4, None), (None, None, "n", 0, 4, 2.0), (1, "a", "m", 1, 5, 0.5)], "query_id int, compound_id string, node_id string, start_byte long, end_byte long, score double")
    assert sorted(map(tuple, merging.merge_near_anchors(odd).collect()), key=str) == [(1, "a", "m", 1, 5, 0.5), (None, None, "n", 0, 4, 2.0)]

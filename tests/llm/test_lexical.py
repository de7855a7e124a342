"""Ranked search against its SQL on given and made tables, and its upper bounds against exact scores."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corpusgraph.llm import lexical

EDGE = [(1, None), (2, ""), (3, " \t\n--"), (4, "One two"), (4, "One two"), (None, "one two three"), (None, "ONE"), (5, "x One " * 30_000), (6, "éß 中文 😀 it's İ one"), (7, "\x00\x01one\x7ftwo</s>"), (8, "0 00 000")]


def by_sql(docs, items):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.register(f"t_{name}", pd.DataFrame(rows, columns=[key, "text"]).astype({key: "Int64", "text": "object"}))
        con.execute(f"CREATE VIEW {name} AS SELECT {key}::BIGINT AS {key}, text::VARCHAR AS text FROM t_{name}")
    return sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP12_SQL})").fetchall(), key=str)


def by_spark(spark, docs, items, **more):
    index = lexical.build_index(spark.createDataFrame([(*r, 1.0, "clash", -1) for r in docs], "doc_id long, text string, score double, terms string, item_id int"))
    asked = spark.createDataFrame([(*r, "clash", -1) for r in items], "item_id long, text string, rank string, doc_id int")
    return sorted((tuple(r) for r in lexical.search(index, asked, **more).collect()), key=str)


def test_edge_cases(spark):
    items = [(1, "one"), (2, "two THREE two"), (3, None), (4, " .. "), (5, "none of them"), (None, "One x x 00"), (6, "it s 中文"), (6, "it s 中文")]
    want = by_sql(EDGE, items)
    assert by_spark(spark, EDGE, items) == want
    assert by_spark(spark, EDGE, items, most=2) == want
    assert by_spark(spark, EDGE, items, most_terms=1) == want
    assert by_spark(spark, EDGE, []) == [] and by_spark(spark, [], items) == [] and by_spark(spark, [(1, None)], items) == []


@pytest.mark.parametrize("cells", [1 << 21, 64])
def test_common_terms_and_copies(spark, monkeypatch, cells):
    """Many equal scores, thousands of copies, counts beyond the exact levels, matrices cut into parts."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[int(300 * draw.random() ** 3)] for _ in range(draw.choice([1, 5, 40, 300])))) for i in range(900)]
    docs += [(10_000 - i, "w1 w2 w2 copy of a text") for i in range(1500)] + [(20_000 + i, "w3 " * i) for i in range(120)]
    draw.shuffle(docs)
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 30])))) for i in range(25)] + [(99, "copy copy text w3 w1")]
    assert by_spark(spark, docs, items) == by_sql(docs, items)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{int(x)}" for x in draw.zipf(1.4, draw.integers(1, 400)) % 2000) for _ in range(300)])
    queries = pa.array([" ".join(f"w{x}" for x in draw.integers(0, 2000, 20)) for _ in range(30)])
    rows, terms, counts, n = lexical.term_counts(queries)
    starts = np.searchsorted(rows, np.arange(len(n) + 1))
    items = lexical.Items([(terms[a:b], counts[a:b]) for a, b in zip(starts, starts[1:])])
    items.weights = draw.integers(0, 9000, len(items.terms))
    part = pa.record_batch([pa.array(range(300), pa.int64()), texts], ["doc_id", "text"])
    exact = excess = 0
    import unittest.mock as mock

    with mock.patch.object(lexical.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
        blocks = list(lexical._indexed([part]))
    assert sorted(i for b in blocks for i in b.column("ids")[0].as_py()) == list(range(300))
    for b in blocks:
        own, m = b.column("texts")[0].values, 25 + b.column("lengths")[0].values.to_numpy()
        bitmaps = np.frombuffer(b.column("slices")[0].as_buffer(), np.uint8).reshape(b.column("width")[0].as_py(), -1)
        upper, true = lexical._bounds(items, len(bitmaps), bitmaps, m), lexical._exact(items, own, m)
        assert (upper >= true).all()
        exact, excess = exact + true.sum(), excess + (upper - true).sum()
    assert excess < 0.03 * exact  # false positives and levels above 4 are all that is added


def test_levels():
    assert lexical.LEVELS[:10].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 10, 12]
    assert (lexical._MOST[np.searchsorted(lexical.LEVELS, np.arange(1, 10_000), side="right")] >= np.arange(1, 10_000)).all()

"""The pipeline against a version that works it out by brute force, stage by stage."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, language
from corpusgraph.llm.common import materialize

from .test_dedup_ops import components, line_brute_force, shingle_set


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language.train(language.training_rows(docs))
    known = {r.doc_id for r in language.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    rows = [r for r in rows if r[0] in known]
    rows = [(i, t) for i, *_, t in line_brute_force(rows)]
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = components(sets, links)
    rows = [(i, t) for i, t in rows if part[i] == i]
    rows = [(i, t) for i, t in rows if not any(s and 100 * len(s & sets[i]) >= 75 * len(s) for s in items)]
    encoder = bpe._encoder(bpe.ranks_path())
    want = {i: (len(encoder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert len(corpus_pipeline.STAGES) == 5
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = materialize(stage(spark, now, sf))
        assert now.columns == columns, k
    assert {r.doc_id for r in now.collect()} == set(want)
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_edges(spark, sf, tmp_path):
    """Null, empty, long and repeated texts, repeated and null ids and clashing columns go through every stage."""
    text = "the same line of words stands here\n" + " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").limit(5).collect())
    own = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    rows = [(1000, None), (1001, ""), (1002, text), (1002, text), (1003, text + " and more"), (None, text), (1004, text * 30), (1005, "\n" * 50), (1006, text)]
    edge = spark.createDataFrame([(i, t, None, "edge", None) for i, t in rows], own.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    clash = {c: F.lit(c) for c in ("_kept", "_gone", "_lines", "_dropped", "_id", "id", "key", "digest", "score", "component_id", "kept", "ids")}
    own.union(edge).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").withColumns(clash).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert 1000 not in got and 1001 not in got and 1005 not in got  # no language
    assert got.count(1002) == 2 and got.count(None) == 1 and 1004 in got  # rows that repeat an id are one document; without an id a row passes
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = materialize(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, k
        if k == 1:  # each line stays in its first document only
            assert all(len(line.strip()) < 10 for r in now.filter("doc_id = 1006").collect() for line in r.text.split("\n"))


def test_empty(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Keyed streams: restarts, late rows, idle groups, and that no batch reads what earlier ones stored."""

import datetime as dt
import hashlib
import time

from corpusgraph.streaming import jobs, stateful

SCHEMA = "doc_id long, text string, ts timestamp"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(stream, folder, name, mode):
    """What the stream gives over all files that are there; a second call restarts it."""
    out = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, e: out.extend((e, *r) for r in b.collect())).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return out, q.recentProgress


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_unseen_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, f"{folder}/in", [(3, "same", at(0)), (2, "same", at(0)), (1, "other", at(0)), (4, "", at(0)), (5, None, at(0)), (6, " ", at(0))])
    make = lambda: stateful.unseen(jobs.read_stream(spark, f"{folder}/in", spark.read.schema(SCHEMA).parquet(f"{folder}/in").schema))
    first, _ = run(make(), folder, "u", "append")
    assert sorted((r[1], r[2]) for r in first) == [(1, hashlib.sha256(b"other").hexdigest()), (2, hashlib.sha256(b"same").hexdigest())]
    put(spark, f"{folder}/in", [(7, "same", at(1)), (8, "new", at(1)), (9, "new", at(2))])
    second, progress = run(make(), folder, "u", "append")
    assert [(r[1], r[2]) for r in second] == [(8, hashlib.sha256(b"new").hexdigest())]
    # a batch reads its own three rows, nothing that is stored
    assert sum(p["numInputRows"] for p in progress) == 3


def test_distill_totals_over_batches(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, f"{folder}/in", [(1, "A line.\nB line", at(0)), (2, "a line.", at(0))])
    make = lambda: stateful.distill(jobs.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
    totals = {r[1]: r[2:] for r in run(make(), folder, "d", "update")[0]}
    put(spark, f"{folder}/in", [(0, "a LINE.", at(1)), (3, None, at(1)), (4, "C\n\nC", at(1))])
    totals |= {r[1]: r[2:] for r in run(make(), folder, "d", "update")[0]}
    assert sorted(totals.values()) == [("B line", 1), ("C", 2), ("a LINE.", 3)]  # the wording of document 0, which came last


def test_idle_groups_come_once_and_late_rows_never(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, f"{folder}/in", [(1, "early line", at(0)), (2, "early line", at(1))])
    make = lambda: stateful.distill(jobs.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_trigger=1), ts="ts", late="10 minutes", idle_ms=60_000)
    first, _ = run(make(), folder, "i", "append")
    assert first == []  # the watermark is not past it
    put(spark, f"{folder}/in", [(3, "later line", at(500))])
    second, _ = run(make(), folder, "i", "append")
    assert [(r[2], r[3]) for r in second] == [("early line", 2)]
    put(spark, f"{folder}/in", [(4, "early line", at(2))])  # later than the watermark: dropped
    put(spark, f"{folder}/in", [(5, "last line", at(2000))])
    third, _ = run(make(), folder, "i", "append")
    assert [(r[2], r[3]) for r in third] == [("later line", 1)]


def test_forgetting(spark, tmp_path):
    """With a time to live an old hash may pass again; before that it may not."""
    folder, out = str(tmp_path), []
    put(spark, f"{folder}/in", [(1, "same", at(0))])
    stream = stateful.unseen(jobs.read_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema), ttl_ms=15_000)
    q = stream.writeStream.foreachBatch(lambda b, e: out.extend(r[0] for r in b.collect())).option("checkpointLocation", f"{folder}/t").trigger(processingTime="1 second").start()
    try:
        until(lambda: out == [1])
        put(spark, f"{folder}/in", [(2, "same", at(1)), (3, "new", at(1))])
        until(lambda: len(out) > 1)
        assert out == [1, 3]
        time.sleep(16)
        put(spark, f"{folder}/in", [(4, "same", at(1))])
        until(lambda: len(out) > 2)
        assert out == [1, 3, 4]
    finally:
        q.stop()


def until(done):
    end = time.time() + 60
    while not done():
        assert time.time() < end
        time.sleep(0.2)

"""Streams against their batch twins: several micro-batches, a restart in between, and state that goes when its time is over."""

import datetime as dt
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from docmeter.operators import usage
from docmeter.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def in_parts(spark, rows, schema, path, n):
    """A stream that reads one of n files a micro-batch."""
    size = -(-len(rows) // n)
    for k in range(n):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1)
        part.write.parquet(f"{path}/{k:03d}")
    return lambda upto: spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{upto}")


def run(stream, where, name, ends_after=None):
    """All that a stream puts out to files, with its progress. A query with a time to live never runs out of batches: it is stopped."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/{name}-cp").option("path", f"{where}/{name}")
    q = (writer.trigger(availableNow=True) if ends_after is None else writer.trigger(processingTime="1 second")).start()
    if ends_after is None:
        q.awaitTermination()
    else:
        until = time.monotonic() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < ends_after and q.exception() is None and time.monotonic() < until:
            time.sleep(0.2)
        q.stop()
    return [p for p in q.recentProgress if p["stateOperators"]]


def restarted(spark, source, build, where, name, n, ends=True):
    """The stream over the first half of the files, then with the rest, from its checkpoint."""
    folder, read = f"{where}/{name}-in", 0
    progress = []
    for half in (range(n // 2), range(n // 2, n)):
        for k in half:
            spark.read.parquet(f"{source}/{k:03d}").coalesce(1).write.mode("append").parquet(folder)
        there = spark.read.parquet(folder)
        schema, new, read = there.schema, there.count() - read, there.count()
        progress.append(run(build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), where, name, None if ends else new))
    return spark.read.parquet(f"{where}/{name}"), progress


def test_limiter(spark, tmp_path):
    r = random.Random(2)
    rows = sorted((T0 + dt.timedelta(seconds=r.randrange(4000)), i, r.randrange(5)) for i in range(300))
    hits = [(k, at, i) for at, i, k in rows]
    in_parts(spark, hits, "key long, at timestamp, id long", f"{tmp_path}/s", 4)
    got, progress = restarted(spark, f"{tmp_path}/s", lambda s: streams.limiter_stream(s, 2, 300), tmp_path, "limiter", 4)
    want = {tuple(x) for x in streams.limiter(spark.createDataFrame(hits, "key long, at timestamp, id long"), 2, 300).collect()}
    assert {tuple(x) for x in got.collect()} == want and {x[2] for x in want} == {True, False} and got.count() == 300


def test_limiter_state_goes(spark, tmp_path):
    early = [(k, T0, k) for k in range(40)]
    late = [(99, T0 + dt.timedelta(hours=h), 100 + h) for h in (5, 6)]
    in_parts(spark, early + [late[0]] * 20 + [late[1]] * 20, "key long, at timestamp, id long", f"{tmp_path}/s", 4)
    _, progress = restarted(spark, f"{tmp_path}/s", lambda s: streams.limiter_stream(s, 2, 300), tmp_path, "limiter", 4)
    states = [p["stateOperators"][0]["numRowsTotal"] for half in progress for p in half]
    assert max(states) >= 20 and states[-1] < max(states) / 4


def test_quota(spark, tmp_path):
    r = random.Random(5)
    times = sorted(r.randrange(4 * 86400) for _ in range(240))
    rows = [(i, r.randrange(4), T0 + dt.timedelta(seconds=t), r.choice([None, 1.0, 2.5]), r.choice(["admin", "user", None]), r.random() < 0.1) for i, t in enumerate(times)]
    schema = "request_id long, user_id long, created_at timestamp, cost double, role string, own_key boolean"
    in_parts(spark, rows, schema, f"{tmp_path}/s", 4)
    shape = lambda df: sorted((x["request_id"], round(x["spent_before"], 8), x["unknown_before"], x["blocked"]) for x in df.collect())
    for name, limit in (("five", 5.0), ("none", None), ("zero", 0.0)):
        got, _ = restarted(spark, f"{tmp_path}/s", lambda s, n=limit: streams.quota_stream(s, n), tmp_path, name, 4)
        assert shape(got) == shape(usage.quota(spark.createDataFrame(rows, schema), limit))
        assert any(x[3] for x in shape(got)) == (name == "five")


def test_summaries(spark, tmp_path):
    rows = [(s, n, f"u{s}.{n}") for n in range(9) for s in range(3)]
    in_parts(spark, rows, "session_id long, turn_no int, user string", f"{tmp_path}/s", 3)
    got, _ = restarted(spark, f"{tmp_path}/s", lambda s: streams.rolling_summaries(s, 2, lambda old, said: " ".join([old, *said] if old else said)), tmp_path, "sum", 3, ends=False)
    last = got.groupBy("session_id").agg(F.max_by("summary", "cursor").alias("summary"), F.max("cursor").alias("cursor"))
    assert {tuple(x) for x in last.collect()} == {(s, " ".join(f"u{s}.{n}" for n in range(7)), 6) for s in range(3)}


def test_first_seen(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"m{r.randrange(12)}", r.choice(["E", None]), T0 + dt.timedelta(minutes=k * 2 + r.randrange(-5, 5))) for k in range(200)] + [("end", "E", T0 + dt.timedelta(days=2))]
    in_parts(spark, rows, "message string, exception string, ts timestamp", f"{tmp_path}/s", 5)
    got, _ = restarted(spark, f"{tmp_path}/s", lambda s: streams.first_seen_stream(s, ["message", "exception"]), tmp_path, "first", 5)
    batch = streams.first_seen(spark.createDataFrame(rows, "message string, exception string, ts timestamp"), ["message", "exception"]).where("message <> 'end'")
    want = {tuple(x) for x in batch.select(F.to_json(F.struct("message", "exception"), {"ignoreNullFields": "false"}), "ts").collect()}
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_stuck(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", "processing", at(0)), ("b", "processing", at(1)), ("b", "indexed", at(5)), ("c", "processing", at(20)), ("d", "processing", at(70)), ("a", "processing", at(2)), ("e", "indexed", at(80)), ("z", "indexed", at(95))]
    rows = sorted(rows, key=lambda r: r[2])
    schema = "id string, status string, at timestamp"
    in_parts(spark, rows, schema, f"{tmp_path}/s", 4)
    got, _ = restarted(spark, f"{tmp_path}/s", lambda s: streams.stuck_stream(s, 30), tmp_path, "stuck", 4)
    last = spark.createDataFrame(rows, schema).groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    want = {r["id"] for r in streams.stuck(last, F.lit(at(95)), 30).collect()}
    assert {r["id"] for r in got.collect()} == want == {"a", "c"}


def test_attempt_windows_and_late_records(spark, tmp_path):
    hits = [(1, T0 + dt.timedelta(seconds=5 * k)) for k in range(20)]
    spark.createDataFrame(hits, "key long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/h")
    stream = spark.readStream.schema("key long, at timestamp").parquet(f"{tmp_path}/h")
    got = {(r["key"], r["start"]): r["count"] for r in streams.drained(streams.attempt_windows(stream), "update").collect()}
    exact = pd.Series([t for _, t in hits])
    for (_, start), n in got.items():
        assert n == ((exact >= start) & (exact < start + dt.timedelta(seconds=60))).sum()
    assert len(got) == 15
    r = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=3))], "id long, created_at timestamp")
    assert [x["id"] for x in streams.late_records(r, F.lit(T0 + dt.timedelta(days=2))).collect()] == [1]


def test_limiter_reads_keys_in_order(spark):
    """Many keys a task and keys over many Arrow batches, null keys and times too; no call of Python for each burst."""
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), None if i % 50 == 0 else T0 + dt.timedelta(seconds=r.randrange(40_000)), i) for i in range(1500)]
    want, held = {}, {}
    for k, at, i in sorted(rows, key=lambda x: (x[1] or T0 - dt.timedelta(1), x[2])):
        mine = [h for h in held.get(k, []) if at and h > at - dt.timedelta(seconds=900)]
        want[i] = at is None or len(mine) < 2
        if at:
            held[k] = mine + [at] * want[i]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = streams.limiter(spark.createDataFrame(rows, "key long, at timestamp, id long"), 2, 900)
        got = {x["id"]: x["allowed"] for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and set(want.values()) == {True, False}
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_drained_through_files(spark, tmp_path):
    """What a stream puts out is read from files, not from a table in the driver."""
    spark.range(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    out = streams.drained(stream.where("id >= 10"), "append")
    assert out.count() == 40 and out.inputFiles()
    assert [x["n"] for x in streams.drained(stream.agg(F.count("*").alias("n")), "complete").collect()] == [50]
    assert streams.drained(stream.where("id < 0"), "append").count() == 0

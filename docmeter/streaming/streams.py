"""The stateful pieces as streams, each with a batch twin (ST1 to ST9)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from docmeter.functions import text
from docmeter.operators import chunking, kept_index
from docmeter.operators.kept import shared_path, written
from docmeter.sources import chunk_sink

#: Typed state, timers and its expiry need Spark's RocksDB store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NONE = iter(())


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, clock: str = "EventTime") -> DataFrame:
    """rows by `key` through a stateful processor. Sets the session's state store, which queries take when they start."""
    rows.sparkSession.conf.set(*STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", clock)


def merged(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in order."""
    return pd.concat(list(rows)).sort_values(list(by))


def drained(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that a bounded stream puts out, in files beside its checkpoint (of the shared folder, if none is given): no row
    passes through the driver. A batch that is run again replaces its own files, and `complete` keeps the last batch alone."""
    checkpoint = checkpoint or shared_path(stream.sparkSession, "stream")  # state is written by executors
    path = f"{checkpoint.rstrip('/')}-out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("append").parquet(path if mode == "complete" else f"{path}/batch=-1")  # so that there is a folder
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def into_index(pages: DataFrame, path: str, checkpoint: str, deleted: Callable[[SparkSession], DataFrame]) -> None:
    """ST1: new pages to chunks, into the keyed chunk table and the kept keyword index; deleted documents do not come back.

    Both replace what an earlier batch wrote for a chunk's id, and a batch that is run again changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        gone = deleted(spark).select(F.col("doc_id").cast("string").alias("doc_id"))
        kb = F.col("kb_id") if "kb_id" in batch.columns else F.lit("all")
        owners = batch.select(F.col("doc_id").cast("string").alias("doc_id"), kb.alias("kb_id")).dropDuplicates(["doc_id"])
        made = written(chunking.chunks(batch).join(gone, "doc_id", "left_anti").join(owners, "doc_id"), "new-chunks")
        chunk_sink.upsert(made, f"{path}/chunks")
        kept_index.change(spark, f"{path}/index", f"{batch_id:09d}", made.where("chunk_type = 'child'"), scope=("kb_id",))

    pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def allowed_hits(times: list[float], held: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """ST2: for hits in order, which are allowed: fewer than `limit` allowed ones in the last `seconds`; denied ones do not count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held.append(t)
    return out, held


def limiter(hits: DataFrame, limit: int, seconds: float) -> DataFrame:
    """ST2 in batch: hits(key, at, id) with `allowed`. Tasks read their keys' hits in order, any number of keys at a time,
    and hold the present key's allowed hits in the window. A hit without a time is allowed and counts for none."""
    length = int(seconds * 1_000_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, known = None, [], False
        for b in batches:
            if not len(b):
                continue
            keys, times = b.column("key").to_pylist(), b.column("t").to_pylist()
            same = lambda x, y: x == y or (x != x and y != y)
            starts = [0, *(i for i in range(1, len(keys)) if not same(keys[i], keys[i - 1])), len(keys)]
            ok = []
            for lo, hi in itertools.pairwise(starts):
                if not (known and same(keys[lo], key)):
                    key, held, known = keys[lo], [], True
                timed = [t for t in times[lo:hi] if t is not None]
                answers, held = allowed_hits(timed, held, limit, length)
                ok += [limit > 0] * (hi - lo - len(timed)) + answers  # hits without a time stand first
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(ok, pa.bool_())], names=["key", "id", "allowed"])

    kind = {f.name: f.dataType.simpleString() for f in hits.schema}
    timed = hits.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("t"), "id")
    return timed.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(task, f"key {kind['key']}, id {kind['id']}, allowed boolean")


class Limiter(StatefulProcessor):
    """ST2: a list of the times of hits allowed in the window, at most `limit`; an event-time timer drops it when the last is out of the window."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "t double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits = merged(rows, "t", "id")
        ok, held = allowed_hits(hits["t"].tolist(), [r[0] for r in self.held.get()] if self.held.exists() else [], self.limit, self.seconds)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.held.put([(float(t),) for t in held])
            self.handle.registerTimer(max(int((held[-1] + self.seconds) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": hits["key"], "id": hits["id"], "allowed": ok})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return NONE

    def close(self) -> None:
        pass


def limiter_stream(hits: DataFrame, limit: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """ST2 as a stream. A hit counts against hits before it, in this batch or earlier ones; hits beyond the watermark are dropped."""
    kind = {f.name: f.dataType.simpleString() for f in hits.schema}
    timed = hits.withWatermark("at", late).select("key", "id", "at", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("t"))
    return with_state(timed, "key", Limiter(limit, seconds), f"key {kind['key']}, id {kind['id']}, allowed boolean")


def attempts(hits: DataFrame, seconds: int = 60) -> DataFrame:
    """ST3: how many hits of the key stand in the last `seconds`, each hit included."""
    order = Window.partitionBy("key").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumn("attempts", F.count("*").over(order))


def attempt_windows(hits: DataFrame, length: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """ST3 as a stream: counts by sliding windows."""
    return hits.withWatermark("at", late).groupBy("key", F.window("at", length, slide).alias("w")).count().select("key", F.col("w.start").alias("start"), "count")


def daily_cost(records: DataFrame, late: str = "1 day") -> DataFrame:
    """ST4: cost by user and day; the same expression in batch and stream."""
    rows = records.withWatermark("created_at", late) if records.isStreaming else records
    return rows.groupBy("user_id", F.window("created_at", "1 day").alias("w")).agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("records")).select("user_id", F.col("w.start").alias("day"), "cost", "records")


def late_records(records: DataFrame, seen_until: F.Column, late: str = "1 day") -> DataFrame:
    """ST4: what lies beyond the watermark, for a side table."""
    return records.where(F.col("created_at") < seen_until - F.expr(f"interval {late}"))


class Quota(StatefulProcessor):
    """ST5: what a user spent in the present window; a timer drops it when the window is over."""

    def __init__(self, limit: float | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("spent", "start long, spent double, unknown long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, spent, unknown = self.state.get() if self.state.exists() else (-1, 0.0, 0)
        out, end = [], 0
        for r in merged(rows, "t", "request_id").itertuples():
            if r.start != start:
                start, spent, unknown = int(r.start), 0.0, 0
            exempt = r.role == "admin" or r.own_key is True
            over = self.limit is not None and self.limit > 0 and round(spent, 8) >= self.limit
            out.append((key[0], r.request_id, spent, unknown, bool(over and not exempt)))
            unknown, spent, end = (unknown + 1, spent, r.end) if pd.isna(r.cost) else (unknown, spent + float(r.cost), r.end)
        self.state.update((start, float(spent), int(unknown)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int(end), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "request_id", "spent_before", "unknown_before", "blocked"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return NONE

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, limit: float | None, window: str = "day", late: str = "1 hour") -> DataFrame:
    """ST5, the twin of usage.quota: requests(request_id, user_id, created_at, cost, role, own_key), which arrive in order by window.

    Reaching the limit blocks the next request. Admins and users of their own key are exempt; no limit never blocks.
    """
    at = F.col("created_at")
    start = text.window_start(at, window)
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    kind = {f.name: f.dataType.simpleString() for f in requests.schema}
    end = start + F.expr("interval 1 month" if window == "month" else "interval 1 day")
    rows = requests.withWatermark("created_at", late).select("user_id", "request_id", "created_at", F.col("cost").cast("double").alias("cost"), "role", "own_key", F.unix_micros(at.cast("timestamp")).alias("t"), ms(start).alias("start"), ms(end).alias("end"))
    return with_state(rows, "user_id", Quota(limit), f"user_id {kind['user_id']}, request_id {kind['request_id']}, spent_before double, unknown_before long, blocked boolean")


class Summaries(StatefulProcessor):
    """ST6: a session's summary, cursor and recent turns; Spark drops them when the session was silent for the time to live."""

    def __init__(self, keep: int, summarize: Callable[[str | None, list[str]], str], ttl_ms: int):
        self.keep, self.summarize, self.ttl_ms = keep, summarize, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "summary string, cursor int", self.ttl_ms)
        self.recent = handle.getListState("recent", "turn_no int, user string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.done.get() if self.done.exists() else None
        turns = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        turns += [(int(r.turn_no), r.user or "") for r in merged(rows, "turn_no").itertuples()]
        if len(turns) > self.keep:
            summary, cursor = self.summarize(old[0] if old else None, [t[1] for t in turns[: -self.keep]]), turns[-self.keep - 1][0]
            turns = turns[-self.keep :]
            self.done.update((summary, cursor))
            yield pd.DataFrame([(key[0], summary, cursor)], columns=["session_id", "summary", "cursor"])
        elif old:
            self.done.update(tuple(old))  # the session spoke: its time to live begins anew
        self.recent.put(turns)

    def close(self) -> None:
        pass


def rolling_summaries(turns: DataFrame, keep: int, summarize: Callable[[str | None, list[str]], str], ttl_days: float = 30) -> DataFrame:
    """ST6: turns beyond the last `keep` go into the session's summary; put out on change only."""
    return with_state(turns.select("session_id", "turn_no", "user"), "session_id", Summaries(keep, summarize, int(ttl_days * 86_400_000)), "session_id long, summary string, cursor int", "ProcessingTime")


def first_seen(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """ST7: the first event of each signature."""
    return events.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).where("k = 1").drop("k")


class First(StatefulProcessor):
    """ST7: a signature's earliest time until no earlier event can come; then a mark, which a later timer drops."""

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("first", "ms long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = min(int(b["ms"].min()) for b in rows)
        old = self.state.get() if self.state.exists() else None
        if old and (old[1] or old[0] <= ms):
            return NONE
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((ms, False))
        self.handle.registerTimer(max(ms + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return NONE

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, told = self.state.get()
        if told:
            self.state.clear()
            return NONE
        self.state.update((ms, True))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.keep_ms)
        return iter([pd.DataFrame({"signature": [key[0]], "ms": [ms]})])

    def close(self) -> None:
        pass


def first_seen_stream(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes", keep_days: int = 365) -> DataFrame:
    """ST7 as a stream: (signature as JSON of the keys, first): the earliest event, put out once the watermark has passed it.
    A signature that comes back after `keep_days` is new again."""
    rows = events.withWatermark(at, late).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("signature"), at, F.unix_millis(F.col(at).cast("timestamp")).alias("ms"))
    found = with_state(rows, "signature", First(1, keep_days * 86_400_000), "signature string, ms long")
    return found.select("signature", F.timestamp_millis("ms").alias("first"))


def stuck(items: DataFrame, as_of: F.Column, minutes: int) -> DataFrame:
    """ST8: items still processing after `minutes`."""
    return items.where((F.col("status") == "processing") & (F.col("at") < as_of - F.make_interval(mins=F.lit(minutes))))


class Stuck(StatefulProcessor):
    """ST8: when an item began; a timer tells if nothing has finished it by then."""

    def __init__(self, minutes: int):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.began = handle, handle.getValueState("began", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = merged(rows, "ms").iloc[-1]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if last["status"] == "processing":
            self.began.update((int(last["ms"]),))
            self.handle.registerTimer(max(int(last["ms"]) + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.began.clear()
        return NONE

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = self.began.get()[0]
        self.began.clear()
        return iter([pd.DataFrame({"id": [key[0]], "started": [ms]})])

    def close(self) -> None:
        pass


def stuck_stream(items: DataFrame, minutes: int, late: str = "0 seconds") -> DataFrame:
    """ST8 as a stream: items that no later event has finished when event time is `minutes` past their start."""
    kind = items.schema["id"].dataType.simpleString()
    rows = items.withWatermark("at", late).select("id", "status", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"))
    return with_state(rows, "id", Stuck(minutes), f"id {kind}, started long")


def in_flight(requests: DataFrame, cap: int = 2) -> DataFrame:
    """ST9: requests(user_id, start, end): the most at once for each user, and whether that is over the cap. Ends come first."""
    marks = requests.select("user_id", F.col("start").alias("at"), F.lit(1).alias("d")).union(requests.select("user_id", F.col("end"), F.lit(-1)))
    order = Window.partitionBy("user_id").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("n", F.sum("d").over(order)).groupBy("user_id").agg(F.max("n").alias("most")).withColumn("over_cap", F.col("most") > cap)

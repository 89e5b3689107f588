"""Review state, saves, history and meters as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from inkstone.operators.log import SAVE_KEY, append_history, save_entries
from inkstone.operators.reviews import INTERVALS, OUTCOMES, STEPS
from inkstone.session import path_exists

OUTPUT = "kind string, entry_id bigint, ts timestamp, box int, due timestamp, streak bigint, review_count bigint, event_id bigint, outcome string"
CARD = "box int, streak bigint, n bigint, last bigint, told bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State with maps and timers needs the RocksDB store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class ReviewQueue(StatefulProcessor):
    """One card: its state, and its reviews that the watermark has not passed yet, one map entry each.

    The stream's own watermark runs ``horizon`` behind the one that counts here, so that late reviews arrive and are told.
    """

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", CARD)
        self.waiting = handle.getMapState("waiting", "ts bigint, event_id bigint", "outcome string")

    def close(self) -> None:
        pass

    def _passed(self, timers: TimerValues) -> int:
        """Event time in microseconds up to which no more reviews count; negative before there is a watermark."""
        now = timers.getCurrentWatermarkInMs()
        return (now + self.horizon) * 1000 if now > 0 else -1

    def _wake(self, micros: int, timers: TimerValues) -> None:
        self.handle.registerTimer(max(-(-micros // 1000) - self.horizon, timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, earliest = self._passed(timerValues), None
        for pdf in rows:
            micros = pdf["ts"].astype("datetime64[us]").astype("int64")
            late = micros <= passed
            for at, event, outcome in zip(micros[~late].tolist(), pdf["event_id"][~late].tolist(), pdf["outcome"][~late].tolist()):
                self.waiting.updateValue((at, event), (outcome,))
                earliest = at if earliest is None else min(earliest, at)
            if late.any():
                own = pdf[late]
                yield _told("late", key[0], own["ts"], event_id=own["event_id"], outcome=own["outcome"])
        if earliest is not None:
            self._wake(earliest, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self._passed(timerValues)
        box, streak, n, last, told = self.card.get() if self.card.exists() else (0, 0, 0, 0, -1)
        pending = sorted(self.waiting.keys())
        ready = [at for at in pending if at[0] <= passed]
        for at in ready:
            code = OUTCOMES.index(self.waiting.getValue(at)[0])
            self.waiting.removeKey(at)
            box, streak, n, last = int(STEPS[code][box]), 0 if code == 0 else streak + 1, n + 1, at[0]
        due = last + INTERVALS[box] * 1_000_000
        state = {"box": box, "due": _time(due), "streak": streak, "review_count": n}
        if ready:
            yield _told("state", key[0], [_time(last)], **state)
        if len(ready) < len(pending):
            self._wake(pending[len(ready)][0], timerValues)
        if n and told != due:
            if due <= passed:
                told = due
                yield _told("due", key[0], [_time(due)], **state)
            else:
                self._wake(due, timerValues)
        if n:
            self.card.update((box, streak, n, last, told))


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _told(kind: str, entry: int, ts, **values) -> pd.DataFrame:
    names = ["box", "due", "streak", "review_count", "event_id", "outcome"]
    out = pd.DataFrame({"kind": kind, "entry_id": entry, "ts": list(ts)})
    for name in names:
        value = values.get(name)
        out[name] = value.tolist() if isinstance(value, pd.Series) else value
    out["ts"], out["due"] = pd.to_datetime(out["ts"]), pd.to_datetime(out["due"])
    return out.astype({"box": "Int32", "streak": "Int64", "review_count": "Int64", "event_id": "Int64"})


def review_queue_stream(reviews: DataFrame, delay: str = "1 hour", horizon_days: int = 3650) -> DataFrame:
    """What happens to cards as a stream of reviews (entry_id, ts, event_id, outcome): rows told apart by ``kind``.

    - ``state``: the card after all its reviews that the watermark (the latest time seen, less ``delay``) has passed, in the
      order of (ts, event_id), whatever the order in which they came.
    - ``due``: the card has fallen due and no review that counts came since; at ``ts``, once for each due time. It is sent
      when the watermark passes that time.
    - ``late``: a review that came behind the watermark, with its outcome. It does not count.

    Spark itself only drops reviews that are ``horizon_days`` older than the watermark. Outcomes that are none are left out.
    A card's waiting reviews are single entries of its state; nothing in it grows with the log.
    """
    _keep_state_on_disk(reviews.sparkSession)
    rows = reviews.filter(F.col("outcome").isin(*OUTCOMES)).select("entry_id", "ts", "event_id", "outcome")
    later = f"{delay} {horizon_days} days"
    return rows.withWatermark("ts", later).groupBy("entry_id").transformWithStateInPandas(ReviewQueue(horizon_days * 86_400_000), OUTPUT, "Update", "EventTime")


def review_state_stream(reviews: DataFrame, delay: str = "1 hour") -> DataFrame:
    """State per entry after each batch of reviews: the ``state`` rows of ``review_queue_stream``. Equals the batch replay of the reviews in time."""
    return review_queue_stream(reviews, delay).filter("kind = 'state'").select("entry_id", "box", "due", "streak", "review_count")


class FirstSave(StatefulProcessor):
    """Lets the earliest row of the first batch of a key through; a key of the table or of an earlier batch is known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def close(self) -> None:
        pass

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.known.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known, first = self.known.exists(), None
        for pdf in rows:
            if not known and len(pdf):
                own = pdf.sort_values(["created_at", "id"], kind="stable").head(1)
                first = own if first is None else pd.concat([first, own]).sort_values(["created_at", "id"], kind="stable").head(1)
        if first is not None:
            self.known.update((True,))
            yield first


def new_saves(saves: DataFrame, table: str, keys: list[str] = SAVE_KEY) -> DataFrame:
    """The stream of saves whose key is new: first of its key in the stream, and not in the table as the stream first starts.

    The table's keys are read once, as the state that the stream starts with, and spread over the state's partitions; later batches
    read nothing but their own rows. A restart from the checkpoint goes on with the state.
    """
    spark = saves.sparkSession
    _keep_state_on_disk(spark)
    stored = spark.read.parquet(table).select(*keys).distinct() if path_exists(spark, table) else spark.createDataFrame([], saves.select(*keys).schema)
    return saves.groupBy(*keys).transformWithStateInPandas(FirstSave(), saves.schema, "Append", "None", stored.groupBy(*keys))


def dedupe_saves_stream(saves: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the first save of each key to the table, by state.

    The first batch of a run looks the table up once more, since it may repeat one that was
    written but not yet recorded when a run before was lost.
    """
    started = []

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(table) if not started and path_exists(spark, table) else batch.limit(0)
        started.append(True)
        fresh = save_entries(stored, batch).filter("not duplicate").drop("duplicate")
        fresh.select(*batch.columns).write.mode("append").parquet(table)

    query = new_saves(saves, table).writeStream.foreachBatch(append).outputMode("append").option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def history_stream(asks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append asks, prepared as in batch, to a table with one folder per day."""
    sink = append_history(asks).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return sink.partitionBy("day").trigger(availableNow=True).start()


def meter_stream(meter: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Recovery counters per tumbling window and label."""
    return (
        meter.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "served_by")
        .agg(F.count("*").alias("pages"), F.sum("proposals").alias("proposals"), F.sum("verified").alias("verified"))
    )

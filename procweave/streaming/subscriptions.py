"""Subscriptions to run logs: numbered delivery to every subscriber, an end mark, late subscribers, and state that goes after the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a message can be.
ENTRY, SUBSCRIBE, LEAVE, END = "entry", "subscribe", "leave", "end"

#: What a subscriber gets: numbers count from 0; the end mark carries no entry.
DELIVERY = "run_id long, subscriber long, sequence long, entry_id long, text string, last boolean"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Broadcast(StatefulProcessor):
    """The channel of one run. Messages have run_id, message_id, kind, subscriber, text and at (the event time)."""

    def __init__(self, replay: bool, keep_ms: int) -> None:
        self.replay, self.keep_ms = replay, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "subscriber long", "following long")
        self.kept = handle.getListState("kept", "entry_id long, text string")
        self.ended = handle.getValueState("ended", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's messages of one run, in order; files_each of the source bounds them.
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        batch = pd.concat(frames).sort_values("message_id", kind="stable")
        following = {s: n for (s,), (n,) in self.open.iterator()}
        before, ended, out = set(following), self.ended.exists(), []
        for row in batch.itertuples(index=False):
            if row.kind == SUBSCRIBE and not pd.isna(row.subscriber) and int(row.subscriber) not in following:
                who, number = int(row.subscriber), 0
                for entry_id, text in self.kept.get() if self.replay else ():
                    out.append((key[0], who, number, entry_id, text, False))
                    number += 1
                if ended:
                    out.append((key[0], who, number, None, None, True))
                else:
                    following[who] = number
            elif row.kind == LEAVE and not pd.isna(row.subscriber):
                following.pop(int(row.subscriber), None)
            elif row.kind == ENTRY and not ended:
                if self.replay:
                    self.kept.appendValue((int(row.message_id), row.text))
                for who, number in following.items():
                    out.append((key[0], who, number, int(row.message_id), row.text, False))
                    following[who] = number + 1
            elif row.kind == END and not ended:
                out += [(key[0], who, number, None, None, True) for who, number in following.items()]
                following, ended = {}, True
                at = max(int(row.at.timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
                self.ended.update((at,))
                self.handle.registerTimer(at + self.keep_ms)
            if len(out) >= 10_000:
                yield delivered(out)
                out = []
        for who in before - set(following):
            self.open.removeKey((who,))
        for who, number in following.items():
            self.open.updateValue((who,), (number,))
        if out:
            yield delivered(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.open, self.kept, self.ended):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def delivered(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["run_id", "subscriber", "sequence", "entry_id", "text", "last"])
    return frame.astype({"entry_id": "Int64", "text": "object"})


def deliveries(messages: DataFrame, replay: bool = False, late: str = "0 seconds", keep_ms: int = 3_600_000) -> DataFrame:
    """What every subscriber of every run gets, from a stream of messages (run_id, message_id, kind, subscriber, text, at).

    A subscriber gets the entries that come after it joined, numbered from 0 without gaps, then one end mark; with ``replay``
    also those before. Messages of a trigger are taken in the order of message_id, triggers in the order of arrival. One who joins
    after the end gets the end mark at once (with ``replay``, after the entries), until the run's state goes: ``keep_ms`` of event
    time after its end. Entries after the end, messages without a run, an id or a known kind, and a second subscription under an
    open number give nothing. A message without a time counts as old. One run is one task's work, as its order has to be.
    The stream needs the state store that ``deliver`` sets.
    """
    rows = messages.selectExpr("run_id", "message_id", "kind", "subscriber", "text", "coalesce(at, timestamp_seconds(0)) AS at")
    rows = rows.filter("run_id IS NOT NULL AND message_id IS NOT NULL AND kind IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(Broadcast(replay, keep_ms), DELIVERY, "Append", "EventTime")


def deliver(messages: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Append what is delivered to a folder, until all that is there is read. Started again, it goes on where it ended.

    The file sink's log names the files of finished batches, so a batch that runs twice is read once.
    """
    conf, name = messages.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)
    try:
        sink = deliveries(messages, **options).writeStream.format("parquet").outputMode("append").option("path", path)
        # A stream takes a copy of the settings when it starts.
        running = sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    running.awaitTermination()


def inboxes(spark: SparkSession, path: str) -> DataFrame:
    """All that was delivered so far."""
    return spark.read.schema(DELIVERY).parquet(path)

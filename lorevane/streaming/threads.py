"""Conversations as streams, and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import NO_HISTORY


def running_history(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text", n: int = 3) -> DataFrame:
    """thread, turn, history for a stream of turns: the last n texts of the thread, kept as state between batches.

    The rows are those of the batch operator `recent`: a null text has its place among the n and adds nothing. Turns of a
    thread must reach the stream in order of batches; within a batch their order does not matter. A turn that comes in a
    later batch than its followers takes its place among the n that are kept: its own history may lack what was dropped,
    rows that were put out before stay as they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values("turn").itertuples(index=False):
            held = sorted([*held, (row.turn, row.text)], key=lambda x: x[0])
            seen = [x for t, x in held if t <= row.turn][-n:]
            out.append((key[0], row.turn, " -> ".join(x for x in seen if x is not None) or NO_HISTORY))
            held = held[-n:]
        state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame(out, columns=[thread, turn, "history"])

    renamed = turns.select(F.col(thread), F.col(turn).alias("turn"), F.col(text).alias("text"))
    return renamed.groupBy(thread).applyInPandasWithState(run, f"{thread} {kinds[thread]}, {turn} {kinds[turn]}, history string", f"turns array<{kinds[turn]}>, held array<string>", "append", GroupStateTimeout.NoTimeout)


class _Corrected(StatefulProcessor):
    """The turns of a thread that may still get a neighbour, in order, and how often the thread has been told of."""

    def __init__(self, schema: str, names: tuple[str, str], n: int, horizon: int) -> None:
        self.schema, self.names, self.n, self.horizon = schema, names, n, horizon
        self.least = max(n, 2)  # a thread keeps one less than so many turns at least, so that it is known by them

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", self.schema)
        self.revision = handle.getValueState("revision", "revision long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = list(self.turns.get())
        held = {t: (t, at, text) for t, at, text in before}
        came = set()
        for frame in rows:
            for turn, at, text in zip(frame["turn"].tolist(), frame["at"].tolist(), frame["text"].tolist()):
                held[turn] = (turn, at, text)
                came.add(turn)
        order = sorted(held)
        told = sorted({j for i, t in enumerate(order) if t in came for j in range(i, min(i + self.n, len(order)))})
        revision = ((self.revision.get() or (0,))[0] if before else 0) + 1  # a thread that has been told of holds turns
        self.revision.update((revision,))
        self._keep([held[t] for t in order], self._timer(sorted(before)))
        said = lambda j: " -> ".join(x for x in (held[t][2] for t in order[max(0, j - self.n + 1) : j + 1]) if x is not None) or NO_HISTORY
        yield pd.DataFrame({self.names[0]: [key[0]] * len(told), self.names[1]: [order[j] for j in told], "history": [said(j) for j in told], "revision": revision})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drop the turns that no late one can follow closely any more."""
        over = timerValues.getCurrentWatermarkInMs() - self.horizon
        held = sorted(self.turns.get())
        first = next((i for i, (_, at, _) in enumerate(held) if at > over), len(held))
        self._keep(held[max(0, first - self.least + 1) :], None)
        return iter([])

    def _timer(self, held: list[tuple]) -> int | None:
        """When the oldest turn can be dropped; fewer than `least` are kept as long as the thread lives."""
        return held[self.least - 1][1] + self.horizon + 1 if len(held) >= self.least else None

    def _keep(self, held: list[tuple], timer: int | None) -> None:
        """Put the turns, and their timer in place of the one that is set; each call is a round trip to the state store."""
        self.turns.put(held)
        new = self._timer(held)
        if timer != new:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if new is not None:
                self.handle.registerTimer(new)


def corrected_history(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text", time: str = "at", n: int = 3, horizon: int = 3_600_000) -> DataFrame:
    """thread, turn, history, revision for a stream of turns with a watermark on `time`: the last n texts of the thread.

    A turn that comes after its followers is put in its place, and they are told of again under a higher revision, so that
    the rows with the highest revision are those of the batch operator `recent`. A turn that comes twice counts as its
    last. State is a list of turns: those younger than the watermark less `horizon` milliseconds, and the n - 1 before them;
    an event-time timer drops the others. The stream's watermark leaves out turns that are later than its delay. Turns must
    be ordered as their times are. Runs on the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    given = turns.select(F.col(thread), F.col(turn).alias("turn"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(text).alias("text"), F.col(time).alias("__time"))
    processor = _Corrected(f"turn {kinds[turn]}, at long, text string", (thread, turn), n, horizon)
    return given.groupBy(thread).transformWithStateInPandas(processor, f"{thread} {kinds[thread]}, {turn} {kinds[turn]}, history string, revision long", "Update", "EventTime")


#: The state store that transformWithStateInPandas needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(files: DataFrame, store, checkpoint: str):
    """Run store(batch, number) over files that a file stream has not seen yet; the checkpoint is the marker."""
    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

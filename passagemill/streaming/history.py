"""Bounded conversation history as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = "conv_id long, turn long, user_text string, assistant_text string, age int"
STATE_SCHEMA = "turn long, user_text string, assistant_text string"
PENDING_SCHEMA = "turn long, role string, text string"


class TurnBuffer(StatefulProcessor):
    """Keeps the newest ``max_turns`` turns per conversation and drops idle conversations.

    A message waits for its counterpart, in either order and across micro-batches, for as long
    as its turn could be among the newest ``max_turns`` complete ones. Output (update mode) is a conversation's buffer after each
    batch that touched it. With ``idle_ms`` an event-time timer clears a
    conversation that saw nothing for that long.
    """

    def __init__(self, max_turns: int = 10, idle_ms: int | None = None):
        self.max_turns = max_turns if max_turns > 0 else 10
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", STATE_SCHEMA)
        self.open = handle.getListState("open", PENDING_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # messages whose counterpart has not come yet, by role and the turn of the user message
        waiting: dict[str, dict[int, str]] = {"user": {}, "assistant": {}}
        if self.open.exists():
            for turn, role, text in self.open.get():
                waiting[role][turn] = text
        latest = None
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                if row.role in waiting:
                    waiting[row.role][int(row.turn) - (row.role == "assistant")] = row.text
            if self.idle_ms is not None and len(pdf):
                seen = pdf["ts"].max()
                latest = seen if latest is None else max(latest, seen)
        buffer = {t: (u, a) for t, u, a in self.turns.get()} if self.turns.exists() else {}
        for turn in waiting["user"].keys() & waiting["assistant"].keys():
            buffer[turn] = (waiting["user"].pop(turn), waiting["assistant"].pop(turn))
        kept = sorted(buffer)[-self.max_turns :]
        oldest = kept[0] if len(kept) == self.max_turns else None
        self._store(self.turns, [(t, *buffer[t]) for t in kept])
        self._store(
            self.open,
            [(t, role, texts[t]) for role, texts in waiting.items() for t in sorted(texts) if oldest is None or t > oldest],
        )
        if latest is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle_ms)
        if not kept:
            return
        yield pd.DataFrame(
            {
                "conv_id": [key[0]] * len(kept),
                "turn": kept,
                "user_text": [buffer[t][0] for t in kept],
                "assistant_text": [buffer[t][1] for t in kept],
                "age": list(range(len(kept), 0, -1)),
            }
        )

    @staticmethod
    def _store(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, max_turns: int = 10, idle_ms: int | None = None) -> DataFrame:
    """Streaming messages ``(conv_id, turn, role, text[, ts])`` to bounded buffers.

    Eviction needs ``ts`` with a watermark on it. The session must use the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return messages.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TurnBuffer(max_turns, idle_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Update",
        timeMode="EventTime" if idle_ms is not None else "None",
    )

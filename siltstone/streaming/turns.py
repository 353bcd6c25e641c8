"""Streams over the append-only logs: turns as they close, settlements once, activity by day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOSED = "conv_id long, turn_no long, opened long, closed long, answers long, n_chars long, closure string"
STATE = "turn_no long, opened long, closed long, answers long, n_chars long"

#: Rows may arrive this late; a turn without news for so long is closed.
PATIENCE = "10 minutes"
PATIENCE_MS = 600_000


def _closure(turn: tuple, left: str) -> str:
    return "preamble" if turn[0] == 0 else "completed" if turn[3] else left


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a conversation in order; a user row closes the open turn and opens the next. A null text has no characters."""
    (conv,), out = key, []
    held = list(state.get) if state.exists else None
    if state.hasTimedOut:
        state.remove()
        out.append((conv, *held, _closure(held, "open")))
    else:
        rows = pd.concat(list(batches)).sort_values("turn")
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            if role == "user" or held is None:
                if held is not None:
                    out.append((conv, *held, _closure(held, "superseded")))
                held = [(held[0] if held is not None else 0) + (role == "user"), turn, turn, 0, 0]
            held[2], held[3], held[4] = turn, held[3] + (role == "assistant"), held[4] + (len(text) if isinstance(text, str) else 0)
        state.update(tuple(int(x) for x in held))
        news = int(rows["at"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(news, state.getCurrentWatermarkMs()) + PATIENCE_MS)
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CLOSED.split(", ")])


def turns(log: DataFrame) -> DataFrame:
    """A stream of (conv_id, turn, role, text, at: timestamp) to turns, each when the next one opens or ten minutes of event time bring nothing.

    Time is that of the rows, so a bounded log ends when it is read; turns that are open then stay in the state for the next run.
    Rows of a conversation are folded in the order of arrival of their batches, by turn within a batch; rows without a conversation are left out.
    """
    timed = log.where("conv_id is not null and turn is not null and at is not null").withWatermark("at", PATIENCE)
    return timed.groupBy("conv_id").applyInPandasWithState(_fold, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled_once(events: DataFrame, at: str, key: list[str]) -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed."""
    return events.withWatermark(at, PATIENCE).dropDuplicatesWithinWatermark(key)


def activity(events: DataFrame, at: str, width: str = "1 hour") -> DataFrame:
    """(start, event_type, events): counts by window and type, final when the watermark has passed."""
    counted = events.withWatermark(at, PATIENCE).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "events")

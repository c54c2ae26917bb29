"""Conversation context and activity on streams, with the batch reducer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.dialogue import CONTEXT, Context


def running_context(turns: DataFrame, group: str = "conv_id", forget_ms: int | None = None) -> DataFrame:
    """The context of each conversation after each batch that has turns of it.

    ``turns`` is a stream of (group, turn_no, topic, faq_id, step); turns of a
    batch are taken in order, repeated and older turns than the last seen are
    skipped. With ``forget_ms`` a conversation without turns for so long is
    forgotten; that needs batches without data, so a run to the end of what is
    available must leave it out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        topic, faq_id, step, n, last = state.get if state.exists else (None, None, 0, 0, -1)
        context = Context(topic, faq_id, step, n)
        rows = pd.concat(list(frames)).sort_values("turn_no", kind="stable")
        for r in rows.itertuples():
            if r.turn_no <= last:
                continue
            last = int(r.turn_no)
            context.turn(None if pd.isna(r.topic) else r.topic, None if pd.isna(r.faq_id) else int(r.faq_id), None if pd.isna(r.step) else int(r.step))
        state.update((*context.row(), last))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame([(key[0], *context.row())], columns=[group, "topic", "faq_id", "step", "turns"])

    kind = turns.schema[group].dataType.simpleString()
    return turns.groupBy(group).applyInPandasWithState(update, f"{group} {kind}, {CONTEXT}", f"{CONTEXT}, last int", "update", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, at: str, late: str, length: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling window and keys; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def first_deliveries(rows: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Rows without redeliveries of a key that arrive within ``late`` of each other."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def activity_sessions(events: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    """Sessions of activity: a gap of ``gap`` ends one."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n")).select(key, "session_window.start", "session_window.end", "n")

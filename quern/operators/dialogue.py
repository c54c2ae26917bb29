"""Conversations: history, topic, sessions, memory.

Turns arrive late, out of order and again. ``latest`` keeps one row a key first.
Orders end in the turn number. A null user is a user of its own. The user with
a tenth or a third of all rows is a large window; where only the last n turns
are kept, the engine's group limit drops rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import terms_in


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key, the one ingested last (ties and repeated rows: any of them, they're equal but for the time).

    By aggregation, so copies are dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    orderable = [c for c in rest if df.schema[c].dataType.typeName() != "map"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), *[F.col(c) for c in orderable if c != at]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def last_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def carried(df: DataFrame, group: str, order: list[str], column: str, name: str, default: str | None = None) -> DataFrame:
    """The last value that isn't null so far, or ``default``."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(column, ignorenulls=True).over(w)
    return df.withColumn(name, F.coalesce(value, F.lit(default)) if default else value)


def topic_sessions(df: DataFrame, group: str, order: list[str], topic: str) -> DataFrame:
    """Sessions numbered by change of the carried topic within a group."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = carried(df, group, order, topic, "sticky")
    changed = (F.coalesce(F.lag("sticky").over(w), F.lit("")) != F.coalesce("sticky", F.lit(""))).cast("int")
    return rows.withColumn("session", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def summary_marks(df: DataFrame, group: str, order: list[str], texts: list[str], budget: int, keep: int) -> DataFrame:
    """Turns that a summary would take in: older than the ``keep`` last once a quarter of the characters exceeds the budget."""
    size = F.ceil(sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0)) / 4)
    up = Window.partitionBy(group).orderBy(*order)
    down = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("used", F.sum(size).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(size).over(Window.partitionBy(group)))
    return rows.withColumn("summarised", (F.col("total") > budget) & (F.row_number().over(down) > keep))


def enhanced(turns: DataFrame, text: Column, statuses: list[tuple[str, list[str]]], refers: list[tuple[str, list[str]]], afresh: list[str], still: str) -> DataFrame:
    """(conv_id, turn_no, reset, step, enhanced) of turns with ``before``, the topic of the turn before, and a step for each status.

    A turn starts afresh where its topic is another one (none within the other),
    where it asks something new (``afresh``) or reports trouble after success
    (``still``). Else, where it refers back or reports a status, it goes on with
    the step it names, the step of its answer for the status (2 without), or 1.
    """
    first = lambda table: F.coalesce(*[F.when(terms_in(text, t, any_=True), F.lit(k)) for k, t in table])
    topic, before = F.col("topic"), F.col("before")
    moved = F.coalesce((topic != before) & ~F.contains(topic, before) & ~F.contains(before, topic), F.lit(False)) | F.lower(F.coalesce(text, F.lit(""))).rlike(still)
    rows = turns.withColumns({"status": first(statuses), "reset": moved | terms_in(text, afresh, any_=True), "refers": first(refers)})
    named = F.nullif(F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"(?:bước|step) (\d{1,4})", 1), F.lit("")).cast("int")
    by_status = F.coalesce(*[F.when(F.col("status") == k, F.coalesce(F.col(k), F.lit(2))) for k, _ in statuses])
    goes_on = ~F.col("reset") & (F.col("refers").isNotNull() | F.col("status").isNotNull())
    step = F.coalesce(named, by_status, F.lit(1))
    query = F.concat_ws(" ", before, F.concat(F.lit("trạng thái "), F.col("status")), F.concat(F.lit("Bước "), step), text)
    return rows.select("conv_id", "turn_no", "reset", F.when(goes_on, step).alias("step"), F.when(goes_on, query).otherwise(text).alias("enhanced"))


class Context:
    """What is carried from turn to turn; one reducer for batch and stream."""

    def __init__(self, topic: str | None = None, faq_id: int | None = None, step: int = 0, turns: int = 0):
        self.topic, self.faq_id, self.step, self.turns = topic, faq_id, step, turns

    def turn(self, topic: str | None, faq_id: int | None, step: int | None) -> None:
        """A new topic clears the step; a named step sets it; the last answer is kept until the next."""
        if topic and topic != self.topic:
            self.topic, self.step = topic, 0
        if faq_id is not None:
            self.faq_id = faq_id
        if step is not None:
            self.step = step
        self.turns += 1

    def row(self) -> tuple:
        return self.topic, self.faq_id, self.step, self.turns


CONTEXT = "topic string, faq_id long, step int, turns int"


def folded_context(turns: DataFrame, group: str) -> DataFrame:
    """The context after each conversation's last turn; turns(group, turn_no, topic, faq_id, step).

    Turns are sorted within partitions and folded as they stream by, so no
    conversation is held as a whole; null conversations are one.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        names = [group, "topic", "faq_id", "step", "turns"]
        for frame in frames:
            done = []
            for own, topic, faq_id, step in zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in (group, "topic", "faq_id", "step"))):
                if state is None or own != key:
                    if state is not None:
                        done.append((key, *state.row()))
                    key, state = own, Context()
                state.turn(topic, None if faq_id is None else int(faq_id), None if step is None else int(step))
            if done:
                yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(key, *state.row())], columns=names)

    kind = turns.schema[group].dataType.simpleString()
    sorted_ = turns.select(group, "turn_no", "topic", "faq_id", "step").repartition(group).sortWithinPartitions(group, "turn_no")
    return sorted_.mapInPandas(fold, f"{group} {kind}, {CONTEXT}")

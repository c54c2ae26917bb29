"""Pairs of texts whose Ratcliff-Obershelp ratio reaches a threshold, without comparing letter by letter what can't.

Distinct texts meet as blocks on a grid, as in ``operators.blocks``. In a cell,
pairs are dropped by bounds that no similar pair fails: twice the shorter length,
and twice the sum of the lesser counts of their characters, hashed into
``GROUPS`` groups, must reach the threshold times both lengths. The ratio is
computed for the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.fuzzy import ratio

GROUPS, BLOCK, PART = 64, 1024, 100_000


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, characters by group) of texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    table = np.bincount(row * GROUPS + (codes ^ codes >> 6) % GROUPS, minlength=len(texts) * GROUPS)
    return lengths, table.reshape(-1, GROUPS).astype(np.int32)


def possible(x: list[str], y: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs that the bounds let through."""
    (a, p), (b, q) = counts_of(x), counts_of(y)
    both = a[:, None] + b
    i, j = np.nonzero(2 * np.minimum(a[:, None], b) >= least * both - 1e-9)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), PART):
        u, v = i[at : at + PART], j[at : at + PART]
        keep[at : at + PART] = 2 * np.minimum(p[u], q[v]).sum(1) >= least * both[u, v] - 1e-9
    return i[keep], j[keep]


def _blocks(df: DataFrame, name: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([held[:BLOCK]], pa.list_(pa.string()))], names=[name])
                held = held[BLOCK:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=[name])

    return df.mapInArrow(pack, f"{name} array<string>")


def _met(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Blocks of distinct texts (texts, others), each two once."""
    q = _blocks(queries.select("text").where("text IS NOT NULL").distinct(), "texts")
    d = _blocks(corpus.select("other").where("other IS NOT NULL").distinct(), "others")
    side = math.isqrt(max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)) + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    q = q.withColumn("row", place("texts")).withColumn("column", every)
    d = d.withColumn("column", place("others")).withColumn("row", every)
    return d.join(q, ["row", "column"]).select("texts", "others")


def containing(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(text, other) of distinct texts of ``queries`` (text) that are part of one of ``corpus`` (other); null and empty texts are part of none.

    The texts of a block are found in one pass over each of the others.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = ahocorasick.Automaton()
                for text in x:
                    if text:
                        known.add_word(text, text)
                out: list[list[str]] = [[], []]
                if len(known):
                    known.make_automaton()
                    for other in y:
                        for text in {t for _, t in known.iter(other)}:
                            out[0].append(text)
                            out[1].append(other)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["text", "other"])

    return _met(queries, corpus).mapInArrow(search, "text string, other string")


def alike(queries: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """(text, other, score) of distinct texts of ``queries`` (text) and ``corpus`` (other), null left out, with a ratio of at least ``least``."""
    if not 0 < least <= 1:
        raise ValueError("the threshold lies above 0, at most at 1")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[list] = [[], [], []]
                for i, j in zip(*(c.tolist() for c in possible(x, y, least))):
                    score = ratio(x[i], y[j], least)
                    if score >= least:
                        for column, value in zip(out, (x[i], y[j], score)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["text", "other", "score"])

    return _met(queries, corpus).mapInArrow(compare, "text string, other string, score double")

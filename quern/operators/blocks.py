"""Top-k of all queries over a corpus as products of blocks.

Queries and corpus are packed into blocks of rows, and the blocks spread over a
grid with about as many cells as there are shuffle partitions. A query block
goes to all cells of its row, a corpus block to all of its column, so each two
meet once, by equality of the cell, as one matrix product that keeps the k best
of each query. What is shuffled is the blocks, the root of the number of
partitions times, and k rows a query and block; a task holds two blocks at a
time. How many queries a word or a vector is near to doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import DIGITS, ranked

#: Rows of a block; entries (numbers) above which a block is closed before; columns of a product that are dense at a time.
ROWS, ENTRIES, COLUMNS = 1024, 1_000_000, 4096


def best(score: np.ndarray, ids: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row: greater score first, rounded as in the ranking, then the smaller id; with ``positive`` only those above 0."""
    shown = np.round(score, DIGITS)
    if shown.shape[1] > k:
        least = np.partition(shown, shown.shape[1] - k, axis=1)[:, -k]
        keep = shown >= least[:, None]
    else:
        keep = np.ones(shown.shape, bool)
    if positive:
        keep &= score > 0
    row, column = np.nonzero(keep)
    order = np.lexsort((ids[column], -shown[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def packed(df: DataFrame, name: str) -> DataFrame:
    """From (key, <lists of numbers> ..) to blocks: ids, lengths and one binary a list, packed within partitions: no shuffle and no global order.

    All lists of a row have the same length.
    """
    lists = df.columns[1:]
    kinds = [np.int64 if df.schema[c].dataType.elementType.typeName() in ("long", "integer") else np.float64 for c in lists]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = entries = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy() for b in held]).astype(np.int64)
            sizes = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held]).astype(np.int32)
            data = [np.concatenate([b.column(1 + n).flatten().to_numpy() for b in held]).astype(kind) for n, kind in enumerate(kinds)]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, *data)]
            return pa.RecordBatch.from_arrays(columns, names=[f"{name}_{x}" for x in ("ids", "sizes", *lists)])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS // 4):
                part = batch.slice(at, ROWS // 4)
                held.append(part)
                count += part.num_rows
                entries += len(part.column(1).flatten())
                if count + ROWS // 4 > ROWS or entries >= ENTRIES:
                    yield out()
                    held, count, entries = [], 0, 0
        if count:
            yield out()

    return df.mapInArrow(pack, ", ".join(f"{name}_{x} binary" for x in ("ids", "sizes", *lists)))


def products(queries: DataFrame, corpus: DataFrame, k: int, score: Callable[[dict, dict], np.ndarray], positive: bool) -> DataFrame:
    """hits(query_id, doc_id, score, rank): ``queries`` and ``corpus`` are (key, lists ..); ``score`` gives the matrix of two blocks."""
    q_lists, d_lists = queries.columns[1:], corpus.columns[1:]
    q_kinds = [np.int64 if queries.schema[c].dataType.elementType.typeName() in ("long", "integer") else np.float64 for c in q_lists]
    d_kinds = [np.int64 if corpus.schema[c].dataType.elementType.typeName() in ("long", "integer") else np.float64 for c in d_lists]

    def block(row: dict, name: str, lists: list[str], kinds: list) -> dict:
        out = {"ids": np.frombuffer(row[f"{name}_ids"], np.int64), "sizes": np.frombuffer(row[f"{name}_sizes"], np.int32)}
        return out | {c: np.frombuffer(row[f"{name}_{c}"], kind) for c, kind in zip(lists, kinds)}

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, d = block(row, "q", q_lists, q_kinds), block(row, "d", d_lists, d_kinds)
                values = score(q, d)
                x, y = best(values, d["ids"], k, positive)
                if not positive:
                    x, y = x[values[x, y] > -np.inf], y[values[x, y] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(q["ids"][x]), pa.array(d["ids"][y]), pa.array(values[x, y])], names=["query_id", "doc_id", "score"])

    q, d = packed(queries, "q"), packed(corpus, "d")
    side = math.isqrt(max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)) + 1
    others = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    q = q.withColumn("row", place("q_ids")).withColumn("column", others)
    d = d.withColumn("column", place("d_ids")).withColumn("row", others)
    met = d.join(q, ["row", "column"]).select(*[f"q_{c}" for c in ("ids", "sizes", *q_lists)], *[f"d_{c}" for c in ("ids", "sizes", *d_lists)])
    return ranked(met.mapInArrow(product, "query_id long, doc_id long, score double"), k=k)


def sparse_product(q: dict, d: dict) -> np.ndarray:
    """Sum over common terms of weight x weight; blocks of (terms, weights)."""
    known, q_term = np.unique(q["terms"], return_inverse=True)
    q_row = np.repeat(np.arange(len(q["ids"])), q["sizes"])
    d_row = np.repeat(np.arange(len(d["ids"])), d["sizes"])
    at = np.searchsorted(known, d["terms"])
    meets = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == d["terms"]) if len(known) else np.zeros(len(at), bool)
    at, d_row, d_weight = at[meets], d_row[meets], d["weights"][meets]
    used, at = np.unique(at, return_inverse=True)  # terms that both blocks have
    place = np.full(len(known), -1)
    place[used] = np.arange(len(used))
    q_term = place[q_term]
    score = np.zeros((len(q["ids"]), len(d["ids"])))
    for low in range(0, len(used), COLUMNS):
        width = min(COLUMNS, len(used) - low)
        a, b = (q_term >= low) & (q_term < low + width), (at >= low) & (at < low + width)
        left = np.bincount(q_row[a] * width + q_term[a] - low, q["weights"][a], len(q["ids"]) * width).reshape(-1, width)
        right = np.bincount((at[b] - low) * len(d["ids"]) + d_row[b], d_weight[b], width * len(d["ids"])).reshape(width, -1)
        score += left @ right
    return score

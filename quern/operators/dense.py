"""Nearest vectors, exactly, by products of blocks (``operators.blocks``).

Null vectors and vectors of another length than the query's are left out; a zero
vector has cosine 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import products


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Vectors as doubles of length 1; null and zero vectors stay as they are."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("norm", norm).withColumn(vector, F.when(F.col("norm") > 0, F.transform(wide, lambda x: x / F.col("norm"))).otherwise(wide))


def _likeness(metric: str):
    def score(q: dict, d: dict) -> np.ndarray:
        out = np.full((len(q["ids"]), len(d["ids"])), -np.inf)
        for width in np.unique(q["sizes"]):
            pick, held = q["sizes"] == width, d["sizes"] == width
            if not held.any():
                continue
            x = q["vector"][np.repeat(pick, q["sizes"])].reshape(-1, width)
            y = d["vector"][np.repeat(held, d["sizes"])].reshape(-1, width)
            if metric == "cosine":
                lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
                value = np.divide(x @ y.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
            else:
                value = 1 / (1 + np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
            out[np.ix_(pick, held)] = value
        return out

    return score


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", query_key: str = "query_id") -> DataFrame:
    """hits(query_id, doc_id, method, score, rank): cosine, or 1 / (1 + squared distance) for ``l2``."""
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    wide = lambda df, key: df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    hits = products(wide(queries, query_key), wide(corpus, key), k, _likeness(metric), positive=False)
    return hits.withColumn("method", F.lit(metric)).select("query_id", "doc_id", "method", "score", "rank")


def relevance_gate(hits: DataFrame, threshold: float) -> DataFrame:
    """(query_id, score, relevant) from l2 hits: 1 / (1 + half the least squared distance) above the threshold."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    score = 1 / (1 + 0.5 * (1 / F.col("top") - 1))
    return best.select("query_id", score.alias("score"), (score > threshold).alias("relevant"))


def diverse(hits: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, trade: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: of each query's candidates, k by ``trade`` x score - (1 - trade) x likeness to those taken.

    A group is one query's candidates (fetch_k rows), whatever the corpus' size.
    """

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank"]).reset_index(drop=True)
        v = np.stack([np.asarray(x, float) for x in group["vector"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, score = v @ v.T, group["score"].to_numpy()
        taken: list[int] = []
        while len(taken) < min(k, len(group)):
            penalty = like[:, taken].max(axis=1) if taken else np.zeros(len(group))
            value = trade * score - (1 - trade) * penalty
            value[taken] = -np.inf
            taken.append(int(np.argmax(np.round(value, 9))))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "doc_id": group["doc_id"].to_numpy()[taken], "place": np.arange(1, len(taken) + 1)})

    rows = hits.join(corpus.select(F.col(key).cast("long").alias("doc_id"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["doc_id"]), "doc_id")
    return rows.groupBy("query_id").applyInPandas(greedy, "query_id long, doc_id long, place long")


def near_duplicates_dropped(hits: DataFrame, corpus: DataFrame, key: str, vector: str, most: float) -> DataFrame:
    """Hits without those that are closer than ``most`` to a better one of their query."""
    vectors = unit(corpus.select(F.col(key).cast("long").alias("doc_id"), F.col(vector).alias("vector")).dropDuplicates(["doc_id"]), "vector").drop("norm")
    rows = hits.join(vectors, "doc_id")
    a = rows.select("query_id", F.col("doc_id").alias("a_id"), F.col("rank").alias("a_rank"), F.col("vector").alias("a"))
    b = rows.select("query_id", "doc_id", F.col("rank").alias("b_rank"), F.col("vector").alias("b"))
    close = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    worse = a.join(b, "query_id").where((F.col("a_rank") < F.col("b_rank")) & (F.round(close, 9) > most)).select("query_id", "doc_id").distinct()
    return hits.join(worse, ["query_id", "doc_id"], "left_anti")

"""Scored hits and what is done with them.

The common form of all retrievers is hits(query_id, doc_id, method, score,
rank). Every order ends in doc_id, so ties have one result; null scores rank
last. Empty inputs give empty outputs; columns are selected by name, so other
columns of the inputs don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def _order(score: str) -> list[Column]:
    return [F.round(F.col(score), DIGITS).desc_nulls_last(), F.col("doc_id").asc()]


def ranked(hits: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """Add the rank within a query, and keep the first k."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(score))))
    return out.where(F.col("rank") <= k) if k else out


def reciprocal_rank_fusion(branches: list[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """Fuse ranked branches by sum of weight / (constant + rank); component ranks are kept as an array by branch."""
    parts = None
    for n, (hits, weight) in enumerate(branches):
        part = hits.select("query_id", "doc_id", (F.lit(float(weight)) / (F.lit(constant) + F.col("rank"))).alias("part"), F.lit(n).alias("branch"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("branches"))
    return ranked(fused.where("score > 0"), k=k)


def max_normalised(hits: DataFrame) -> DataFrame:
    """Scores by the greatest of their query; 0 where that isn't positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))


def weighted_merge(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight x score over sum of weights, over the methods present; unknown methods weigh nothing.

    Of several scores of one method the greatest counts.
    """
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    one = hits.groupBy("query_id", "doc_id", "method").agg(F.max("score").alias("score")).where(F.col("score").isNotNull())
    w = F.coalesce(table[F.col("method")], F.lit(0.0))
    merged = one.groupBy("query_id", "doc_id").agg(F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("score"), F.count(F.lit(1)).alias("methods"))
    return ranked(merged.where(F.col("score").isNotNull()))


def appended_if_absent(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` and those hits of ``second`` whose (query, doc) it hasn't."""
    return first.unionByName(second.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))


def first_branch(branches: list[DataFrame]) -> DataFrame:
    """For each query the hits of the first branch that has any, with the branch's number."""
    tagged = None
    for n, hits in enumerate(branches):
        part = hits.withColumn("branch", F.lit(n))
        tagged = part if tagged is None else tagged.unionByName(part)
    own = F.min("branch").over(Window.partitionBy("query_id"))
    return tagged.withColumn("own", own).where("branch = own").drop("own")


def every_query(queries: DataFrame, hits: DataFrame, status: str = "no_results") -> DataFrame:
    """One row a query with its best hit, or ``status`` where it has none; a query never vanishes."""
    best = ranked(hits.select("query_id", "doc_id", "score"), k=1).drop("rank")
    return queries.select("query_id").distinct().join(best, "query_id", "left").withColumn("status", F.when(F.col("doc_id").isNull(), status).otherwise("success"))

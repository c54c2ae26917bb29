"""The queries of this subpackage: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import forms, nearcopy, packing, pairs, privacy, spans, splitting, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of personal information in each text of memory."""
    found = privacy.personal(_table(spark, folder, "memory"), "memory_id", ["content", "memory"])
    return found.select("memory_id", "field", F.explode("found.kind").alias("kind")).distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of memory with placeholders for personal information."""
    return privacy.personal(_table(spark, folder, "memory"), "memory_id", ["content", "memory"]).select("memory_id", "field", "redacted").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """FAQs whose answer is cut into more than one piece."""
    pieces = splitting.pieces(_table(spark, folder, "faq"), "faq_id", "answer")
    return pieces.where("piece_no = 1").select("faq_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all answers."""
    return splitting.pieces(_table(spark, folder, "faq"), "faq_id", "answer").distinct()


def p2_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer put together again from its pieces without their repeats, by its digest; and whether no piece is too long and none but the first begins without a repeat or after the one before."""
    pieces = splitting.pieces(_table(spark, folder, "faq"), "faq_id", "answer").distinct()
    before = F.lag("end_char").over(Window.partitionBy("faq_id").orderBy("piece_no"))
    parts = pieces.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("part", F.substr("piece", F.col("before") - F.col("start_char") + 1))
    fits = (F.length("piece") <= 1000) & (F.col("start_char") <= F.col("before"))
    rows = parts.groupBy("faq_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "part"))).alias("parts"), F.bool_and(fits).alias("fits"))
    return rows.select("faq_id", F.md5(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("answer_id"), "fits").where(F.col("answer_id") != F.md5(F.lit("")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """FAQ pairs with a defect, and the first kind that applies."""
    flagged = pairs.flagged(_table(spark, folder, "faq"), "faq_id", "question", "answer")
    return flagged.where(F.col("defect").isNotNull()).select("faq_id", "defect").distinct()


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of defect of each FAQ pair that has any."""
    flagged = pairs.flagged(_table(spark, folder, "faq"), "faq_id", "question", "answer")
    return flagged.select("faq_id", F.explode("defects").alias("defect")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of FAQs with a similarity of at least 0.7."""
    return nearcopy.near_pairs(_table(spark, folder, "faq"), "faq_id", ["question", "answer"], 0.7)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each FAQ: all that are connected by links of at least 0.7."""
    return nearcopy.near_groups(_table(spark, folder, "faq"), "faq_id", ["question", "answer"], 0.7)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """FAQ texts that differ from their consistent form."""
    return forms.changed_fields(_table(spark, folder, "faq"), "faq_id", ["question", "answer"], "faq_id")


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of all FAQ texts."""
    return forms.consistent_forms(_table(spark, folder, "faq"), "faq_id", ["question", "answer"]).distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents."""
    return tokens.encoded(_table(spark, folder, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of each document or piece of one."""
    counts = tokens.token_counts(_table(spark, folder, "documents"), "doc_id", "text")
    return packing.packed(counts, "doc_id", "n_tokens")


def p7_use(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are, in steps of 128 tokens."""
    filled = p7_containers(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return filled.groupBy((F.ceil(F.col("used") / 128) * 128).alias("used_up_to")).agg(F.count(F.lit(1)).alias("containers"), F.sum(2048 - F.col("used")).alias("room_left"))


def p7_room(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, against the least that could hold all tokens; the places without overlap, overfull or cut items counted."""
    rows = p7_containers(spark, folder)
    filled = rows.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.max(F.col("at") + F.col("n_tokens")).alias("end"))
    total = filled.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum((F.greatest("used", "end") > 2048).cast("long") + (F.col("used") != F.col("end")).cast("long")), F.lit(0)).alias("faulty"))
    return total.withColumn("least", F.ceil(F.col("tokens") / 2048)).withColumn("excess", F.coalesce(F.try_divide(F.col("containers"), F.col("least")) - 1, F.lit(0.0)))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that share a run of at least 200 characters."""
    return spans.sharing_pairs(_table(spark, folder, "documents"), "doc_id", "text", 200)


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    """For each document how much of it is shared elsewhere."""
    return spans.shared_share(_table(spark, folder, "documents"), "doc_id", "text", 200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_defects, p4_found, p4_groups, p5_found, p5_forms, p6_ids, p7_containers, p7_use, p7_room, p8_found, p8_shared)
}

_WINDOWS = """w AS (SELECT DISTINCT doc_id, i, substr(text, i, 200) AS s FROM (SELECT DISTINCT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
  r AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), h AS (SELECT w.* FROM w JOIN r USING (s))"""

ORACLES: dict[str, str] = {
    "p2_found": "SELECT DISTINCT faq_id FROM faq WHERE length(answer) > 1000",
    "p2_rebuilt": "SELECT DISTINCT faq_id, md5(answer) AS answer_id, true AS fits FROM faq WHERE length(answer) > 0",
    "p8_found": f"WITH {_WINDOWS}, d AS (SELECT DISTINCT doc_id, s FROM h) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b USING (s) WHERE a.doc_id < b.doc_id",
    "p8_shared": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, CAST(sum(least(200, coalesce(next - i, 200))) AS BIGINT) AS shared FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM h) GROUP BY doc_id),
      t AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE length(text) >= 200), d AS (SELECT DISTINCT doc_id, s FROM h),
      l AS (SELECT a.doc_id, count(DISTINCT y.text) AS links FROM d a JOIN d b USING (s) JOIN t x ON x.doc_id = a.doc_id JOIN t y ON y.doc_id = b.doc_id WHERE x.text <> y.text GROUP BY a.doc_id)
      SELECT f.doc_id, coalesce(length(f.text), 0) AS n_chars, coalesce(c.shared, 0) AS shared_chars, coalesce(t.copies, 1) AS copies, coalesce(l.links, 0) AS links, CASE WHEN length(f.text) > 0 THEN coalesce(c.shared, 0) / length(f.text) ELSE 0.0 END AS share
      FROM documents f LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)""",
}

"""What the query modules share: tables, the query batches, fragments of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.sparse import STOP_WORDS

W = r"[\p{L}\p{N}_]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled questions as a query batch."""
    return table(spark, folder, "intent_query").select("query_id", "query")


def faq_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "faq").select("faq_id", "question", "answer", F.concat_ws(" ", "question", "answer").alias("text"))


FAQ_TEXT = "(SELECT faq_id, question, answer, concat_ws(' ', question, answer) AS text FROM faq)"


def sql_words(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '{W}')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join("contains(lower(coalesce(%s, '')), '%s')" % (column, t.replace("'", "''")) for t in terms) + ")"


def sql_hits(column: str, terms: list[str]) -> str:
    return "(" + " + ".join("CAST(contains(lower(coalesce(%s, '')), '%s') AS INT)" % (column, t.replace("'", "''")) for t in terms) + ")"


def sql_cosine(queries: str, k: int) -> str:
    """CTE body: cosine hits of a queries subquery over embeddings."""
    return f"""SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
      FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM {queries} q, embeddings d WHERE d.embedding IS NOT NULL AND q.embedding IS NOT NULL)) WHERE rank <= {k}"""


def sql_bm25(queries: str, docs: str, k: int) -> str:
    """CTEs from ``b_tok`` to ``b_hits`` for queries(query_id, query) and docs(doc_id, text): composed form, without stop words."""
    keep = f"list_filter(%s, lambda w: NOT list_contains({sql_list(STOP_WORDS)}, w))"
    return f"""b_tok AS (SELECT doc_id, {keep % sql_words("nfc_normalize(text)")} AS words FROM {docs}),
    b_len AS (SELECT doc_id, len(words) AS dl FROM b_tok),
    b_post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM b_tok) GROUP BY ALL),
    b_size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM b_len),
    b_raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM b_post, b_size GROUP BY term, n),
    b_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM b_raw) ELSE raw END AS idf FROM b_raw),
    b_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({keep % sql_words("nfc_normalize(query)")}) AS term FROM {queries}) GROUP BY ALL),
    b_score AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM b_q JOIN b_post USING (term) JOIN b_idf USING (term) JOIN b_len USING (doc_id), b_size GROUP BY ALL),
    b_hits AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b_score) WHERE rank <= {k} AND score > 0)"""


def sql_ranked(source: str, k: int | None = None) -> str:
    limit = f" WHERE rank <= {k}" if k else ""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, doc_id) AS rank FROM {source}){limit}"

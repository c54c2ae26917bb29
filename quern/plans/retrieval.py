"""Dense and lexical retrieval and score fusion (ops V1-V6, L1-L9, F1-F14, G9, R16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fuzzy
from quern.functions.text import first_topic, words
from quern.operators import dense, ranking, sparse
from quern.operators.alike import alike, containing
from quern.plans.common import FAQ_TEXT, asked, faq_text, sql_any, sql_bm25, sql_cosine, sql_list, sql_ranked, sql_words, table
from quern.session import staged

QUERIES, ORACLES = {}, {}
K = 10
# Words that keyword search leaves out, and those that the check of relevance does.
STOPS_KEYWORD = "tôi bạn là có thể được để và hoặc hay này đó như thế nào gì sao làm muốn cần của cho với từ đến trong ngoài trên dưới khi nếu thì mà vì do bởi nhưng còn vẫn đang sẽ đã rồi chưa không phải những".split()
STOPS_RELEVANCE = "tôi bạn là có thể được để và hoặc hay này đó như thế nào gì sao làm muốn cần của cho với từ đến trong bao nhiêu ở đâu mà khi nếu thì vì do bởi nhưng còn vẫn".split()
STOP = ["là", "và", "của", "cho", "có", "không", "thì", "the", "a", "to", "of", "is", "on", "if"]
TOPICS = [
    ("transfer", ["chuyển tiền", "chuyển khoản", "send money"]), ("top_up", ["nạp tiền", "top up"]), ("withdraw", ["rút tiền", "withdraw"]), ("card", ["khoá thẻ", "liên kết thẻ", "freeze the card", "link a card"]),
    ("bill", ["hoá đơn", "pay a bill"]), ("security", ["mật khẩu", "xác thực", "vân tay", "password", "fingerprint"]), ("statement", ["sao kê", "statement"]), ("points", ["điểm thưởng", "points"]),
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    all_ = table(spark, folder, "embeddings")
    return all_.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), all_


Q20 = "(SELECT * FROM embeddings WHERE vec_id % 20 = 0)"


def _cosine(spark, folder, k=K):
    q, d = _embeddings(spark, folder)
    return dense.nearest(q, d, "vec_id", "embedding", k)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({sql_cosine(Q20, K)})")
def dense_cosine_topk(spark, folder):
    """V1, V6: cosine top-k of every 20th vector over all."""
    return _shown(_cosine(spark, folder))


L2 = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
  1 / (1 + list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) ** 2) AS score FROM {Q20} q, embeddings d WHERE q.embedding IS NOT NULL AND d.embedding IS NOT NULL)) WHERE rank <= {K})"""


@query(f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {L2}")
def dense_l2_topk(spark, folder):
    """Squared-distance top-k with score 1 / (1 + distance)."""
    q, d = _embeddings(spark, folder)
    return _shown(dense.nearest(q, d, "vec_id", "embedding", K, "l2"))


@query(f"SELECT query_id, round(1 / (1 + 0.5 * (1 / max(score) - 1)), 6) AS score, 1 / (1 + 0.5 * (1 / max(score) - 1)) > 0.25 AS relevant, 1 / (1 + 0.5 * (1 / max(score) - 1)) > 0.3 AS relevant_by_default FROM {L2} WHERE rank BETWEEN 2 AND 6 GROUP BY query_id")
def relevance_gate(spark, folder):
    """V3: whether the best of five hits besides the query itself is near enough, by the caller's threshold and the default one."""
    q, d = _embeddings(spark, folder)
    hits = dense.nearest(q, d, "vec_id", "embedding", 6, "l2").where("rank > 1")
    strict = dense.relevance_gate(hits, 0.3).select("query_id", F.col("relevant").alias("relevant_by_default"))
    return dense.relevance_gate(hits, 0.25).withColumn("score", F.round("score", 6)).join(strict, "query_id")


@query()
def mmr_topk(spark, folder):
    """V4: three diverse of six candidates."""
    _, d = _embeddings(spark, folder)
    return dense.diverse(_cosine(spark, folder, 6), d, "vec_id", "embedding", 3)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings WHERE embedding IS NOT NULL")
def vector_norms(spark, folder):
    """V5: the length by which vectors are normalised."""
    return dense.unit(table(spark, folder, "embeddings").where("embedding IS NOT NULL"), "embedding").select("vec_id", F.round("norm", 6).alias("norm"))


@query(f"""WITH h AS ({sql_cosine(Q20, K)}), p AS (SELECT a.query_id, b.doc_id FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank JOIN embeddings x ON x.vec_id = a.doc_id JOIN embeddings y ON y.vec_id = b.doc_id
  WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) > 0.85)
  SELECT query_id, doc_id, rank FROM h WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM p)""")
def near_duplicate_drop(spark, folder):
    """hits too close to a better one are dropped."""
    _, d = _embeddings(spark, folder)
    return dense.near_duplicates_dropped(_cosine(spark, folder), d, "vec_id", "embedding", 0.85).select("query_id", "doc_id", "rank")


FAQ_DOCS = "(SELECT faq_id AS doc_id, text FROM " + FAQ_TEXT + ")"
ASKED = "(SELECT query_id, query FROM intent_query)"


@query(f"WITH {sql_bm25(ASKED, FAQ_DOCS, K)} SELECT term, df, round(idf, 6) AS idf FROM b_idf")
def bm25_terms(spark, folder):
    """L1: document frequency and weight of each term."""
    weights, _ = sparse.term_weights(*sparse.postings(faq_text(spark, folder), "faq_id", "text"))
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {sql_bm25(ASKED, FAQ_DOCS, K)} SELECT n, round(avgdl, 6) AS avgdl, round((SELECT avg(raw) FROM b_raw), 6) AS mean_idf FROM b_size")
def bm25_stats(spark, folder):
    """L1: size of the corpus."""
    _, corpus = sparse.term_weights(*sparse.postings(faq_text(spark, folder), "faq_id", "text"))
    return spark.createDataFrame([corpus], "n long, avgdl double, mean_idf double").select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {sql_bm25(ASKED, FAQ_DOCS, K)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b_hits")
def bm25_topk(spark, folder):
    """L2, L3: the labelled questions over all FAQs."""
    return _shown(sparse.bm25(asked(spark, folder), faq_text(spark, folder), "faq_id", "text", K))


@query(f"WITH {sql_bm25(ASKED, FAQ_DOCS, K)} SELECT query_id, doc_id, round(least(score / 10, 1), 6) AS score FROM b_hits")
def bm25_capped(spark, folder):
    """Scores a tenth, 1 at most."""
    hits = sparse.bm25(asked(spark, folder), faq_text(spark, folder), "faq_id", "text", K)
    return hits.select("query_id", "doc_id", F.round(F.least(F.col("score") / 10, F.lit(1.0)), 6).alias("score"))


@query(f"""WITH old AS (SELECT * FROM {FAQ_TEXT} WHERE faq_id % 2 = 0), t AS (SELECT faq_id AS doc_id, unnest(list_filter({sql_words('nfc_normalize(text)')}, lambda w: NOT list_contains({sql_list(sparse.STOP_WORDS)}, w))) AS term FROM {FAQ_TEXT})
  SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def bm25_incremental(spark, folder):
    """Document frequencies of an old index with those of new rows added; equal to a rebuild."""
    docs = faq_text(spark, folder)
    parts = [sparse.postings(docs.where(F.col("faq_id") % 2 == n), "faq_id", "text")[0].groupBy("term").agg(F.count(F.lit(1)).alias("df")) for n in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("term").agg(F.sum("df").alias("df"))


# Terms of several words that are searched for as a whole; terms that an intent is searched by.
COMPOUNDS = ["chuyển tiền", "nạp tiền", "rút tiền", "liên kết thẻ", "ngân hàng", "biểu phí", "hạn mức", "thời gian", "tổng đài", "sao kê", "mã otp", "mật khẩu", "hoá đơn", "tài khoản", "điểm thưởng", "vân tay", "mã qr", "send money"]
BY_INTENT = {
    "FEE": ["phí", "miễn phí", "chi phí", "mất phí", "biểu phí", "chính sách phí"], "LIMIT": ["hạn mức", "tối đa", "tối thiểu", "giới hạn", "số tiền tối đa", "vượt quá"],
    "TIME": ["bao lâu", "thời gian", "ngày làm việc", "hoàn tiền", "ngay lập tức", "khi nào"],
}
_compound = lambda c: "list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN '{t}' END" for t in COMPOUNDS) + "], lambda x: x IS NOT NULL)"
KEYWORD = f"""kw_q AS (SELECT DISTINCT query_id, unnest(list_distinct(list_filter({sql_words('query')}, lambda w: NOT list_contains({sql_list(STOPS_KEYWORD)}, w) AND length(w) >= 2) || {_compound('query')})) AS term FROM {ASKED}),
  kw_s AS (SELECT query_id, faq_id AS doc_id, sum(2 * CAST(contains(lower(coalesce(question, '')), term) AS INT) + CAST(contains(lower(coalesce(answer, '')), term) AS INT))::DOUBLE AS score FROM kw_q JOIN faq ON contains(lower(coalesce(question, '')), term) OR contains(lower(coalesce(answer, '')), term) GROUP BY ALL),
  kw_hits AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS score, rank FROM ({sql_ranked('kw_s', K)}))"""


@query(f"WITH {KEYWORD} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM kw_hits")
def keyword_topk(spark, folder):
    """Keywords and compound terms contained in question (twice) and answer, by the best of the query."""
    return _shown(_keyword_hits(spark, folder))


def _keyword_hits(spark, folder):
    return sparse.keyword_scores(asked(spark, folder), faq_text(spark, folder), "faq_id", "question", "answer", K, stop=STOPS_KEYWORD, compounds=COMPOUNDS)


@query()
def keyword_or_exact(spark, folder):
    """L4: questions nearly equal to the asked one (0.85) alone where there are any, else the keyword hits."""
    exact = ranking.ranked(_fuzzy_pairs(asked(spark, folder), table(spark, folder, "faq"), 0.85).where("score > 0.85"), k=K).select("query_id", "doc_id", "score", F.lit("exact_match").alias("method"))
    return ranking.first_branch([exact, _keyword_hits(spark, folder).select("query_id", "doc_id", "score", "method")]).select("query_id", "doc_id", "method", F.round("score", 6).alias("score"))


_listed = " UNION ALL ".join(f"SELECT '{i}' AS query_id, faq_id AS doc_id, ({' + '.join(f'2 * CAST(contains(lower(coalesce(question, {chr(39)*2})), {chr(39)}{t}{chr(39)}) AS INT) + CAST(contains(lower(coalesce(answer, {chr(39)*2})), {chr(39)}{t}{chr(39)}) AS INT)' for t in terms)})::DOUBLE AS score FROM faq" for i, terms in BY_INTENT.items())


@query(f"""WITH l AS ({_listed}), h AS (SELECT query_id AS intent, doc_id, score / max(score) OVER (PARTITION BY query_id) AS score FROM ({sql_ranked('(SELECT * FROM l WHERE score > 0)', K)}))
  SELECT q.query_id, h.doc_id, round(0.8 * h.score, 6) AS score FROM h JOIN intent_query q ON q.expected_intent = h.intent""")
def intent_keyword_topk(spark, folder):
    """Documents by the fixed terms of a question's intent, a fifth lower."""
    hits = sparse.listed_scores(faq_text(spark, folder), "faq_id", "question", "answer", BY_INTENT, K)
    wanted = table(spark, folder, "intent_query").select("query_id", F.col("expected_intent").alias("intent"))
    return wanted.join(hits, "intent").select("query_id", "doc_id", F.round(F.col("score") * 0.8, 6).alias("score"))


@query("""SELECT topic, faq_id AS doc_id FROM (SELECT topic, faq_id, row_number() OVER (PARTITION BY topic ORDER BY faq_id) AS r FROM (SELECT DISTINCT lower(trim(topic)) AS topic FROM chat_turn WHERE trim(topic) <> '') t
  JOIN faq f ON contains(lower(coalesce(f.question, '')), t.topic) OR contains(lower(coalesce(f.answer, '')), t.topic)) WHERE r <= 10""")
def keyword_fallback(spark, folder):
    """Where there's no keyword the whole query is searched for in questions and answers: the first ten of each topic of the conversations."""
    topics = table(spark, folder, "chat_turn").select(F.lower(F.trim("topic")).alias("text")).where("text <> ''").distinct()
    faq = table(spark, folder, "faq").select(F.col("faq_id").alias("doc_id"), F.explode(F.array(F.lower("question"), F.lower("answer"))).alias("other")).where("other IS NOT NULL")
    hits = containing(topics, faq).join(faq, "other").select(F.col("text").alias("query_id"), "doc_id", F.lit(1.0).alias("score")).distinct()
    return ranking.ranked(hits, k=10).select(F.col("query_id").alias("topic"), "doc_id")


def _fuzzy_pairs(asked, questions, least):
    """(query_id, doc_id, score) of all pairs whose ratio is at least ``least``; each distinct question is compared once a distinct query."""
    low = questions.where("question IS NOT NULL").select(F.col("faq_id").alias("doc_id"), F.lower("question").alias("other"))
    q = asked.select("query_id", F.lower("query").alias("text"))
    return q.join(alike(q, low, least), "text").join(low, "other").select("query_id", "doc_id", "score").distinct()


@query()
def fuzzy_match(spark, folder):
    """Questions with a Ratcliff-Obershelp ratio of 0.85 or more."""
    return ranking.ranked(_fuzzy_pairs(asked(spark, folder), table(spark, folder, "faq"), 0.85)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def exact_match_inject(spark, folder):
    """a near-equal question goes to the head of the lexical hits, unless it's among them."""
    hits = sparse.bm25(asked(spark, folder), faq_text(spark, folder), "faq_id", "text", K).select("query_id", "doc_id", "score")
    exact = fuzzy_match(spark, folder).where("rank = 1").select("query_id", "doc_id", F.lit(1e6).alias("score"))
    return ranking.ranked(ranking.appended_if_absent(hits, exact)).select("query_id", "doc_id", "rank")


@query()
def verify_relevance(spark, folder):
    """Hits kept where the question has a compound term of the query, 0.3 of its words, or is 0.4 alike; a query with under 0.3 of its hits kept loses all."""
    from pyspark.sql import Window

    hits = sparse.bm25(asked(spark, folder), faq_text(spark, folder), "faq_id", "text", K)
    rows = hits.join(asked(spark, folder), "query_id").join(table(spark, folder, "faq").select(F.col("faq_id").alias("doc_id"), "question"), "doc_id")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    terms = lambda c: F.filter(F.array_distinct(F.split(low(c), r"\s+")), lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*[F.lit(x) for x in STOPS_RELEVANCE]), w))
    compound = F.lit(False)
    for t in COMPOUNDS:
        compound = compound | (low("query").contains(t) & low("question").contains(t))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(terms("query"), terms("question"))), F.size(terms("query"))), F.lit(0.0))
    kept = compound | (share >= 0.3) | (fuzzy.similarity(low("query"), low("question"), 0.4) >= 0.4)
    rows = rows.withColumn("kept", kept).withColumn("part", F.avg(F.col("kept").cast("int")).over(Window.partitionBy("query_id")))
    return rows.where("kept AND part >= 0.3").select("query_id", "doc_id", "rank")


def _rrf_sql(alpha: float, k: int = K) -> str:
    texts = "(SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 20 = 0)"
    return f"""WITH {sql_bm25(texts, "(SELECT doc_id, text FROM documents)", 2 * k)}, d_hits AS ({sql_cosine(Q20, 2 * k)}),
    parts AS (SELECT query_id, doc_id, {alpha} / (60 + rank) AS part FROM d_hits UNION ALL SELECT query_id, doc_id, {1 - alpha} / (60 + rank) FROM b_hits),
    fused AS (SELECT query_id, doc_id, sum(part) AS score FROM parts GROUP BY ALL HAVING sum(part) > 0)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked('fused', k)})"""


def _rrf(spark, folder, alpha, k=K):
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    docs = table(spark, folder, "documents")
    texts = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    lexical = sparse.bm25(texts, docs.select("doc_id", "text"), "doc_id", "text", 2 * k)
    return _shown(ranking.reciprocal_rank_fusion([(_cosine(spark, folder, 2 * k), alpha), (lexical, 1 - alpha)], k))


@query(_rrf_sql(0.5))
def rrf_hybrid(spark, folder):
    """Vectors and titles of every 20th document, fused half and half (vec_id stands for doc_id)."""
    return _rrf(spark, folder, 0.5)


@query(_rrf_sql(0.0))
def rrf_alpha_zero(spark, folder):
    """only the lexical branch."""
    return _rrf(spark, folder, 0.0)


@query(_rrf_sql(1.0))
def rrf_alpha_one(spark, folder):
    """only the dense branch."""
    return _rrf(spark, folder, 1.0)


ENTITY = "(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC NULLS LAST, doc_id) AS rank FROM (SELECT result_id AS query_id, CAST(substr(r.node_id, 5) AS BIGINT) AS doc_id, max(r.score) AS score FROM (SELECT result_id, unnest(all_results) AS r FROM rag_result) WHERE r.node_id IS NOT NULL AND r.method = '%s' GROUP BY ALL))"
ALL_HITS = "(SELECT result_id AS query_id, CAST(substr(r.node_id, 5) AS BIGINT) AS doc_id, r.method AS method, r.score AS score FROM (SELECT result_id, unnest(all_results) AS r FROM rag_result) WHERE r.node_id IS NOT NULL)"


def _stored_hits(spark, folder) -> DataFrame:
    """Hits that are stored with the answer results."""
    rows = table(spark, folder, "rag_result").select(F.col("result_id").alias("query_id"), F.explode("all_results").alias("r")).where("r.node_id IS NOT NULL")
    return rows.select("query_id", F.substr("r.node_id", F.lit(5)).cast("long").alias("doc_id"), "r.method", "r.score")


def _method(hits: DataFrame, method: str) -> DataFrame:
    return ranking.ranked(hits.where(F.col("method") == method).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))


@query(f"""WITH parts AS (SELECT query_id, doc_id, 0.6 / (60 + rank) AS part FROM {ENTITY % 'entity'} UNION ALL SELECT query_id, doc_id, 0.4 / (60 + rank) FROM {ENTITY % 'keyword'}),
  fused AS (SELECT query_id, doc_id, sum(part) AS score FROM parts GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked('fused', 5)})""")
def rrf_ensemble(spark, folder):
    """Two stored branches fused 0.6 to 0.4; a missing branch leaves the other."""
    hits = _stored_hits(spark, folder)
    return _shown(ranking.reciprocal_rank_fusion([(_method(hits, "entity"), 0.6), (_method(hits, "keyword"), 0.4)], 5))


INTENT_WEIGHTS = {"HOW_TO": 0.7, "FEE": 0.4, "LIMIT": 0.4, "TIME": 0.4}


@query(f"""WITH w AS (SELECT result_id AS query_id, CASE intent {' '.join(f"WHEN '{k}' THEN {v}" for k, v in INTENT_WEIGHTS.items())} ELSE 0.6 END AS w FROM rag_result),
  parts AS (SELECT query_id, doc_id, w / (60 + rank) AS part FROM {ENTITY % 'entity'} JOIN w USING (query_id) UNION ALL SELECT query_id, doc_id, (1 - w) / (60 + rank) FROM {ENTITY % 'keyword'} JOIN w USING (query_id)),
  fused AS (SELECT query_id, doc_id, sum(part) AS score FROM parts GROUP BY ALL) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked('fused', 5)})""")
def rrf_by_intent(spark, folder):
    """the branches' weights by intent."""
    hits = _stored_hits(spark, folder)
    weight = F.lit(0.6)
    for intent, w in INTENT_WEIGHTS.items():
        weight = F.when(F.col("intent") == intent, w).otherwise(weight)
    weights = table(spark, folder, "rag_result").select(F.col("result_id").alias("query_id"), weight.alias("w"))
    parts = _method(hits, "entity").join(weights, "query_id").select("query_id", "doc_id", (F.col("w") / (60 + F.col("rank"))).alias("part")).unionByName(
        _method(hits, "keyword").join(weights, "query_id").select("query_id", "doc_id", ((1 - F.col("w")) / (60 + F.col("rank"))).alias("part"))
    )
    return _shown(ranking.ranked(parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k=5))


@query(f"""WITH one AS (SELECT query_id, doc_id, method, max(score) AS score FROM {ALL_HITS} GROUP BY ALL HAVING max(score) IS NOT NULL),
  m AS (SELECT query_id, doc_id, sum(CASE method WHEN 'entity' THEN 0.8 WHEN 'semantic' THEN 0.2 ELSE 0 END * score) / nullif(sum(CASE method WHEN 'entity' THEN 0.8 WHEN 'semantic' THEN 0.2 ELSE 0 END), 0) AS score FROM one GROUP BY ALL)
  SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({sql_ranked('(SELECT * FROM m WHERE score IS NOT NULL)')})""")
def weighted_merge(spark, folder):
    """weighted mean over the methods present."""
    return _shown(ranking.weighted_merge(_stored_hits(spark, folder), {"entity": 0.8, "semantic": 0.2, "keyword": 0.0}))


@query(f"""SELECT query_id, doc_id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM {ENTITY % 'entity'}""")
def max_normalize(spark, folder):
    """Scores by the best of their query."""
    return ranking.max_normalised(_method(_stored_hits(spark, folder), "entity")).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, doc_id, 'entity' AS method FROM {ENTITY % 'entity'} UNION ALL SELECT query_id, doc_id, 'keyword' FROM {ENTITY % 'keyword'} k WHERE NOT EXISTS (SELECT 1 FROM {ENTITY % 'entity'} e WHERE e.query_id = k.query_id AND e.doc_id = k.doc_id)")
def append_if_absent(spark, folder):
    """keyword hits appended where the entity branch hasn't them."""
    hits = _stored_hits(spark, folder)
    first, second = (_method(hits, m).select("query_id", "doc_id", F.lit(m).alias("method")) for m in ("entity", "keyword"))
    return ranking.appended_if_absent(first, second)


@query(f"""WITH t AS (SELECT query_id, doc_id, 0 AS branch FROM {ENTITY % 'entity'} UNION ALL SELECT query_id, doc_id, 1 FROM {ENTITY % 'semantic'} UNION ALL SELECT query_id, doc_id, 2 FROM {ENTITY % 'keyword'})
  SELECT query_id, doc_id, branch FROM t QUALIFY branch = min(branch) OVER (PARTITION BY query_id)""")
def branch_priority(spark, folder):
    """The first branch that found anything, query by query."""
    hits = _stored_hits(spark, folder)
    return ranking.first_branch([_method(hits, m).select("query_id", "doc_id") for m in ("entity", "semantic", "keyword")]).select("query_id", "doc_id", "branch")


@query(f"""WITH best AS (SELECT * FROM {ENTITY % 'entity'} WHERE rank = 1) SELECT q.result_id AS query_id, doc_id, round(score, 6) AS score, CASE WHEN doc_id IS NULL THEN 'no_results' ELSE 'success' END AS status
  FROM rag_result q LEFT JOIN best ON best.query_id = q.result_id""")
def no_result_rows(spark, folder):
    """One row for each query, found or not."""
    queries = table(spark, folder, "rag_result").select(F.col("result_id").alias("query_id"))
    return ranking.every_query(queries, _method(_stored_hits(spark, folder), "entity")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "status")


_MEM_Q = "(SELECT DISTINCT memory_id AS query_id, user_id, content AS query FROM memory WHERE memory_id % 20 = 0 AND role = 'user')"
_MEM_D = "(SELECT DISTINCT memory_id AS doc_id, user_id, memory AS text FROM memory WHERE memory IS NOT NULL)"
MEMORY = f"""m_q AS (SELECT query_id, user_id, list_distinct({sql_words('query')}) AS words FROM {_MEM_Q}), m_qt AS (SELECT query_id, user_id, len(words) AS n, unnest(words) AS term FROM m_q),
  m_d AS (SELECT doc_id, user_id, unnest(list_distinct({sql_words('text')})) AS term FROM {_MEM_D}), m_s AS (SELECT query_id, doc_id, count(*) / max(n) AS score FROM m_qt JOIN m_d USING (user_id, term) GROUP BY ALL), m_hits AS ({sql_ranked('m_s', 5)})"""


def memory_hits(spark, folder, k=5):
    rows = table(spark, folder, "memory")
    q = rows.where("memory_id % 20 = 0 AND role = 'user'").select(F.col("memory_id").alias("query_id"), "user_id", F.col("content").alias("query")).distinct()
    d = rows.where("memory IS NOT NULL").select(F.col("memory_id").alias("doc_id"), "user_id", F.col("memory").alias("text")).distinct()
    return sparse.memory_search(q, d, k)


@query(f"WITH {MEMORY} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM m_hits")
def memory_topk(spark, folder):
    """Every 20th message over the facts of its user."""
    return _shown(memory_hits(spark, folder))


@query(f"WITH {MEMORY}, t AS (SELECT query_id, doc_id, score, rank FROM m_hits WHERE score >= 0.2) SELECT query_id, count(*) AS relevant, round(max(score), 6) AS top_score, max(CASE WHEN rank = 1 THEN doc_id END) AS best FROM t GROUP BY query_id")
def memory_context(spark, folder):
    """C11: how many facts are relevant, the best score and fact."""
    hits = memory_hits(spark, folder).where("score >= 0.2")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.round(F.max("score"), 6).alias("top_score"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("best"))


def topic_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(column, terms)} THEN '{topic}'" for topic, terms in TOPICS) + " END"


@query(f"SELECT faq_id, {topic_sql('question')} AS topic FROM faq")
def topic_lookup(spark, folder):
    """The first topic of the table whose terms the question holds."""
    return table(spark, folder, "faq").select("faq_id", first_topic(F.col("question"), TOPICS).alias("topic"))


@query(f"""SELECT query_id, doc_id, common, rank FROM ({sql_ranked(f'''(SELECT q.query_id, d.faq_id AS doc_id, count(*) AS common, count(*)::DOUBLE AS score FROM (SELECT DISTINCT query_id, unnest({sql_words('query')}) AS term FROM intent_query) q
  JOIN (SELECT DISTINCT faq_id, unnest({sql_words('question')}) AS term FROM faq) d USING (term) GROUP BY ALL)''', 3)})""")
def word_overlap_topk(spark, folder):
    """T4: questions by the number of words in common."""
    q = asked(spark, folder).select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    d = table(spark, folder, "faq").select(F.col("faq_id").alias("doc_id"), F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
    common = q.join(d, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("common")).withColumn("score", F.col("common").cast("double"))
    return ranking.ranked(common, k=3).select("query_id", "doc_id", "common", "rank")


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def vector_index(spark, folder):
    """Unit vectors written as a table and read back."""
    index = staged(dense.unit(table(spark, folder, "embeddings").where("embedding IS NOT NULL"), "embedding").select("vec_id", "embedding"), "vectors")
    return index.select("vec_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))

"""Ingest, focused answers and explainable re-ranking (ops S1-S10, A1-A11, R2-R15, P10, P11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import dialogue as D
from quern.operators import procedures as P
from quern.operators import ranking, rerank, sparse
from quern.plans.common import FAQ_TEXT, asked, faq_text, sql_any, sql_bm25, sql_hits, sql_ranked, sql_words, table
from quern.plans.language import CLASSIFIED, ENTITIES, INTENTS, STOPS
from quern.plans.retrieval import TOPICS, topic_sql
from quern.session import scratch
from quern.sources import documents as S
from quern.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT faq_id, 'Question: ' || trim(question, ' ') || chr(10) || chr(10) || 'Answer: ' || trim(answer, ' ') || chr(10) || 'Keywords: ' || trim(question, ' ') AS page_content, string_split(source, '/')[-1] AS source, row_id + 2 AS row_id FROM faq
  WHERE regexp_matches(question, '[\\p{L}\\p{N}]') AND lower(trim(question, ' ')) <> 'nan' AND regexp_matches(answer, '[\\p{L}\\p{N}]') AND lower(trim(answer, ' ')) <> 'nan'""")
def ingest_documents(spark, folder):
    """Rows with both texts, as documents with their provenance."""
    return S.built(table(spark, folder, "faq"), "faq_id", first_row=2)


@query("SELECT source, sheet_name, row_id, max(faq_id) AS faq_id, count(*) AS loads FROM faq WHERE source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL GROUP BY ALL")
def ingest_reloads(spark, folder):
    """Rows loaded again under a new id: the last id and the number of loads."""
    rows = table(spark, folder, "faq").where("source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL")
    return rows.groupBy("source", "sheet_name", "row_id").agg(F.max("faq_id").alias("faq_id"), F.count(F.lit(1)).alias("loads"))


@query("SELECT coalesce(sheet_name, '') AS sheet_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(sheet_name, '')) AS place FROM faq GROUP BY coalesce(sheet_name, '')")
def per_sheet_counts(spark, folder):
    """Rows by sheet, most first; as many rows as sheets reach the one ordered task."""
    n = table(spark, folder, "faq").groupBy(F.coalesce("sheet_name", F.lit("")).alias("sheet_name")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "sheet_name")))


@query("""SELECT faq_id, coalesce(last_value(CASE WHEN regexp_matches(section, '^([IVX]+|\\d+)\\. ') THEN section END IGNORE NULLS) OVER (PARTITION BY source, sheet_name ORDER BY row_id, faq_id ROWS UNBOUNDED PRECEDING), 'Tổng quan') AS held FROM faq""")
def section_carry_forward(spark, folder):
    """The last numbered section so far, sheet by sheet."""
    rows = table(spark, folder, "faq").withColumn("mark", F.when(F.col("section").rlike(r"^([IVX]+|\d+)\. "), F.col("section")))
    w = Window.partitionBy("source", "sheet_name").orderBy("row_id", "faq_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("faq_id", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("Tổng quan")).alias("held"))


CELLS = [("a", 1, ["Danh mục", None]), ("a", 2, [None, None]), ("a", 3, ["STT", "Câu hỏi", "Trả lời"]), ("a", 4, ["I. Thẻ", None, None]), ("b", 1, ["Question", "Answer"]), ("b", 2, ["How?", "So."]), ("c", 1, ["x"]), ("c", 2, ["y"])]
_cells = ", ".join(f"('{s}', {n}, [{', '.join('NULL' if c is None else repr(c) for c in cells)}])" for s, n, cells in CELLS)


@query(f"""SELECT sheet, min(row_no) AS header_row FROM (VALUES {_cells}) t(sheet, row_no, cells) WHERE row_no <= 5 AND len(list_filter(cells, lambda c: regexp_matches(lower(c), '^(câu hỏi|question)$'))) > 0
  AND (len(list_filter(cells, lambda c: c IS NOT NULL)) >= 2) GROUP BY sheet""")
def header_detect(spark, folder):
    """The row, of the first five, that heads the columns."""
    cells = spark.createDataFrame(CELLS, "sheet string, row_no int, cells array<string>")
    return S.header_rows(cells)


# In order: the first pattern that the answer has counts; its first group, or what it stands for.
VALUE = {
    "fee": [
        (r"(?:miễn phí|không mất phí|không tính phí|không thu phí|free of charge|no fee)", "free"), (r"phí[: ]*(?:là )?(?:0 đồng|0 vnd)", "free"), (r"(?:phí|fee)[^\d\n]{0,60}?(\d[\d.,]*\d) (?:đồng|vnd|credits)", None),
        (r"(?:mất phí|tốn|costs?|charged)[^\d\n]{0,20}?(\d[\d.,]*\d)", None), (r"(\d[\d.,]*\d) ?(?:đồng|vnd|credits) ?(?:/|mỗi|per|a) ?(?:giao dịch|lần|lệnh|transaction|time|order)", None), (r"(?:tham khảo|xem thêm|xem tại|see)[^\n]{0,80}?(https?://[^ \n]+)", None),
    ],
    "limit": [
        (r"hạn mức[^\d\n]{0,60}?(\d[\d.,]*\d) (?:đồng|vnd|credits|triệu)", None), (r"tối đa[^\d\n]{0,60}?(\d[\d.,]*\d) (?:đồng|vnd|credits|triệu)", None), (r"tối thiểu[^\d\n]{0,60}?(\d[\d.,]*\d) (?:đồng|vnd|credits|triệu)", None),
        (r"(\d[\d.,]*\d) ?(?:đồng|vnd|credits|triệu) ?(?:/|mỗi|per|a) ?(?:ngày|tháng|lần|day|month)", None), (r"(?:giới hạn|limit|at most|up to)[^\d\n]{0,60}?(\d[\d.,]*\d)", None),
    ],
    "time": [
        (r"(?:ngay lập tức|tức thì|real-?time|at once|immediately)", "at once"), (r"(t\+\d{1,2})", None), (r"(?:trong vòng|within)[^\d\n]{0,20}?(\d{1,3} (?:phút|giờ|ngày|minutes|hours|days))", None), (r"(\d{1,3} (?:ngày làm việc|working days))", None),
        (r"(?:thời gian|mất|takes?)[^\d\n]{0,40}?(\d{1,3} (?:phút|giờ|ngày|minutes|hours|days))", None), (r"(\d{1,3} (?:phút|giờ|ngày|minutes|hours|days))", None),
    ],
}


def _value_sql(patterns: list[tuple[str, str | None]], rule: bool) -> str:
    low = "lower(coalesce(answer, ''))"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{p}') THEN " + (str(n) if rule else f"'{fixed}'" if fixed else f"regexp_extract({low}, '{p}', 1)") for n, (p, fixed) in enumerate(patterns, 1)) + " END"


_value = ", ".join(f"{_value_sql(p, False)} AS {k}, {_value_sql(p, True)} AS {k}_rule" for k, p in VALUE.items())


@query(f"SELECT faq_id, {_value} FROM faq")
def value_extract(spark, folder):
    """Fee, limit and time of each answer by ordered patterns, with the number of the pattern."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    columns = []
    for k, patterns in VALUE.items():
        value = rule = F
        for n, (p, fixed) in enumerate(patterns, 1):
            value = value.when(low.rlike(p), F.lit(fixed) if fixed else F.regexp_extract(low, p, 1))
            rule = rule.when(low.rlike(p), n)
        columns += [value.alias(k), rule.alias(f"{k}_rule")]
    return table(spark, folder, "faq").select("faq_id", *columns)


SECTION = r"^(Cách \d+:|Bước \d+:|B\d+ -|Step \d+:|Option \d+:|Way \d+:)"
_sections = f"""(SELECT faq_id, section, min(line) FILTER (place = first) AS title, string_agg(line, chr(10) ORDER BY place) FILTER (place > first) AS body FROM (SELECT *, min(place) OVER (PARTITION BY faq_id, section) AS first FROM
  (SELECT *, CAST(sum(CAST(regexp_matches(line, '{SECTION}') AS INT)) OVER (PARTITION BY faq_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS INT) AS section FROM (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line,
  generate_subscripts(string_split(answer, chr(10)), 1) AS place FROM faq WHERE answer IS NOT NULL) WHERE trim(line) <> '') WHERE section > 0) GROUP BY ALL)"""


@query(f"SELECT faq_id, section, title, coalesce(body, '') AS body FROM {_sections}")
def section_split(spark, folder):
    """Sections of an answer."""
    return P.sections(table(spark, folder, "faq"), "faq_id", "answer", SECTION)


_asked_words = "list_filter(string_split_regex(lower(coalesce(question, '')), '\\s+'), lambda w: length(w) > 2)"
_found_faq = ENTITIES.sql("SELECT faq_id AS id, question AS text FROM faq")
_of_types = lambda types: f"(SELECT id, flatten(list(string_split(value, ' '))) AS ws FROM ({_found_faq}) WHERE etype IN ({', '.join(repr(t) for t in types)}) GROUP BY id)"
_in = lambda l, points: f"{points} * coalesce(len(list_filter({l}, lambda w: contains(text, w))), 0)"


@query(f"""WITH s AS (SELECT x.faq_id, x.section, lower(concat_ws(' ', title, coalesce(body, ''))) AS text, count(*) OVER (PARTITION BY x.faq_id) AS n, {_asked_words} AS asked, list_filter(e.ws, lambda w: length(w) > 2) AS ws FROM {_sections} x JOIN faq ON faq.faq_id = x.faq_id LEFT JOIN {_of_types(['Action', 'Service', 'Topic', 'Feature'])} e ON e.id = x.faq_id),
  p AS (SELECT faq_id, section, n, CAST({_in('ws', 3)} + {_in('asked', 1)} AS BIGINT) AS score FROM s) SELECT faq_id, section, score FROM p WHERE n > 1 AND score >= 3 QUALIFY row_number() OVER (PARTITION BY faq_id ORDER BY score DESC, section) = 1""")
def section_relevant(spark, folder):
    """The section with most of the question's words, those of its entities three times."""
    return P.weighed_section(_with_words(spark, folder), "faq_id", [("filters", 3), ("asked", 1)])


@query(f"""WITH s AS (SELECT x.faq_id, x.section, lower(concat_ws(' ', title, coalesce(body, ''))) AS text, count(*) OVER (PARTITION BY x.faq_id) AS n, {_asked_words} AS asked, f.ws AS fw, t.ws AS tw FROM {_sections} x JOIN faq ON faq.faq_id = x.faq_id LEFT JOIN {_of_types(['Feature', 'Action'])} f ON f.id = x.faq_id LEFT JOIN {_of_types(['Topic'])} t ON t.id = x.faq_id),
  p AS (SELECT faq_id, section, n, CAST({_in('fw', 3)} + {_in('tw', 2)} + {_in('asked', 1)} AS BIGINT) AS score FROM s) SELECT faq_id, section, score FROM p WHERE n > 1 AND score >= 3 QUALIFY row_number() OVER (PARTITION BY faq_id ORDER BY score DESC, section) = 1""")
def section_by_case(spark, folder):
    """The section with most words: three points a word of a feature or action, two of a topic, one of the question."""
    return P.weighed_section(_with_words(spark, folder), "faq_id", [("features", 3), ("topics", 2), ("asked", 1)])


def _with_words(spark, folder):
    """Sections with the words of their question and of its entities."""
    faq = table(spark, folder, "faq").select("faq_id", "question", ENTITIES.column(F.col("question")).alias("found"))
    of = lambda types: F.flatten(F.transform(F.filter("found", lambda x: x["etype"].isin(types)), lambda x: F.split(x["value"], " ")))
    long = lambda c: F.filter(c, lambda w: F.length(w) > 2)
    words = faq.select(
        "faq_id", long(F.split(F.lower(F.coalesce("question", F.lit(""))), r"\s+")).alias("asked"), long(of(["Action", "Service", "Topic", "Feature"])).alias("filters"), of(["Feature", "Action"]).alias("features"), of(["Topic"]).alias("topics")
    )
    return section_split(spark, folder).join(words, "faq_id")


@query(f"""SELECT faq_id, intent, CASE WHEN intent = 'FEE' AND fee IS NOT NULL THEN 'value' WHEN intent = 'LIMIT' AND "limit" IS NOT NULL THEN 'value' WHEN intent = 'TIME' AND "time" IS NOT NULL THEN 'value' WHEN EXISTS (SELECT 1 FROM {_sections} s WHERE s.faq_id = v.faq_id) THEN 'section' ELSE 'full' END AS layer
  FROM (SELECT faq_id, {_value} FROM faq) v JOIN (SELECT id, intent FROM ({INTENTS.sql('SELECT faq_id AS id, question AS text FROM faq')})) i ON i.id = v.faq_id""")
def answer_layers(spark, folder):
    """Which layer gives the answer: a value, a section, or all of it."""
    values = value_extract(spark, folder).join(table(spark, folder, "faq").withColumns(INTENTS.columns(F.col("question"))).select("faq_id", "intent"), "faq_id")
    cut = section_split(spark, folder).select("faq_id", F.lit(1).alias("s")).distinct()
    i = F.col("intent")
    layer = F.when(((i == "FEE") & F.col("fee").isNotNull()) | ((i == "LIMIT") & F.col("limit").isNotNull()) | ((i == "TIME") & F.col("time").isNotNull()), "value").when(F.col("s") == 1, "section").otherwise("full")
    return values.join(cut, "faq_id", "left").select("faq_id", "intent", layer.alias("layer"))


CASES = ["cách 1", "cách 2", "trường hợp", "nếu ", "option", "in case", "if the"]


@query(f"SELECT faq_id, {sql_hits('answer', CASES)} >= 2 AS several FROM faq")
def multi_case_flag(spark, folder):
    """Answers that distinguish cases."""
    return table(spark, folder, "faq").select("faq_id", (X.hits(F.col("answer"), CASES) >= 2).alias("several"))


@query("""SELECT result_id, concat_ws(chr(10), CASE WHEN lower(status) = 'success' THEN coalesce(answer, '') ELSE 'No answer was found.' END, CASE WHEN len(related_questions) > 0 THEN 'See also: ' || array_to_string(list_filter(related_questions[1:2], lambda x: x IS NOT NULL), '; ') END,
  CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence < 0.4 THEN 'This may not be exact.' END) AS response FROM rag_result""")
def template_answer(spark, folder):
    """A response from the parts that there are."""
    c = F.col("confidence")
    parts = [
        F.when(F.lower("status") == "success", F.coalesce("answer", F.lit(""))).otherwise("No answer was found."),
        F.when(F.size("related_questions") > 0, F.concat(F.lit("See also: "), F.array_join(F.array_compact(F.slice("related_questions", 1, 2)), "; "))),
        F.when(c.isNotNull() & ~F.isnan(c) & (c < 0.4), "This may not be exact."),
    ]
    return table(spark, folder, "rag_result").select("result_id", F.concat_ws("\n", *parts).alias("response"))


@query("""WITH l AS (SELECT result_id, list_filter(list_transform(all_results, lambda r: r.node_id), lambda x: x IS NOT NULL) AS l FROM rag_result)
  SELECT result_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources FROM l""")
def source_list(spark, folder):
    """sources of an answer in order, once each."""
    return table(spark, folder, "rag_result").select("result_id", F.array_join(F.array_distinct(F.array_compact(F.transform("all_results", lambda r: r["node_id"]))), ",").alias("sources"))


PACK = rerank.Pack(
    critical=[("otp", ["otp"]), ("hoàn", ["hoàn"]), ("huỷ", ["huỷ", "hủy"]), ("vân tay", ["vân tay"]), ("sao kê", ["sao kê"]), ("fingerprint", ["fingerprint"]), ("cashback", ["cashback"])],
    topics=TOPICS, contradictions=[("nạp tiền", "rút tiền"), ("rút tiền", "nạp tiền"), ("mở sổ", "tất toán"), ("top up", "withdraw"), ("withdraw", "top up")], errors=["err-", "bị từ chối", "tự thoát", "declined", "closes by itself"],
    intents={"FEE": ["phí", "miễn phí", "biểu phí", "fee", "charge"], "LIMIT": ["hạn mức", "tối đa", "tối thiểu", "giới hạn", "limit"], "TIME": ["bao lâu", "thời gian", "trong vòng", "phút", "giờ", "minutes", "hours"]},
    trouble=["kiểm tra", "trạng thái", "chưa nhận", "phải làm", "làm theo", "sao kê", "liên hệ", "hỗ trợ", "khắc phục"], problems=["chưa", "không", "lỗi", "thất bại", "bị từ chối", "fails", "error", "declined"],
    procedure=r"(bước|step) [0-9]+[:.)]|(^|\n)\(?[0-9]+[.)] |(^|\n)b[0-9]+ -", signals=["làm thế nào", "cách", "hướng dẫn", "bước", "step", "how"],
)
_HITS = f"b_hits"
_RANK = f"""WITH {sql_bm25("(SELECT query_id, query FROM intent_query)", "(SELECT faq_id AS doc_id, text FROM " + FAQ_TEXT + ")", 10)}, base AS (SELECT h.query_id, h.doc_id, h.score / max(h.score) OVER (PARTITION BY h.query_id) AS base, h.rank AS input, q.query, f.question, f.answer, c.intent FROM b_hits h
  JOIN intent_query q USING (query_id) JOIN faq f ON f.faq_id = h.doc_id JOIN ({CLASSIFIED}) c ON c.id = h.query_id), parts AS (SELECT *, {PACK.sql(topic_sql)} FROM base), total AS (SELECT *, base + keyword + topic + contradiction + intent_points + error + overlap AS score FROM parts),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, input, doc_id) AS place FROM total)"""


def _reranked(spark, folder):
    hits = ranking.max_normalised(sparse.bm25(asked(spark, folder), faq_text(spark, folder), "faq_id", "text", 10))
    questions = table(spark, folder, "intent_query").withColumns(INTENTS.columns(F.col("query"))).select("query_id", "query", "intent")
    faq = table(spark, folder, "faq").select(F.col("faq_id").alias("doc_id"), "question", "answer")
    return rerank.reranked(hits.join(questions, "query_id").join(faq, "doc_id"), PACK)


_parts = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("base", "keyword", "topic", "contradiction", "intent_points", "error", "overlap", "score"))


@query(f"{_RANK} SELECT query_id, doc_id, {_parts}, place FROM ordered WHERE place <= 5")
def rerank_breakdown(spark, folder):
    """The first five of each question with every part of their score."""
    parts = ["base", "keyword", "topic", "contradiction", "intent_points", "error", "overlap", "score"]
    return _reranked(spark, folder).where("place <= 5").select("query_id", "doc_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in parts], "place")


@query(f"""{_RANK} SELECT query_id, doc_id, CASE WHEN intent IN ('FEE', 'LIMIT', 'TIME') THEN 'extract' WHEN score >= 2 THEN 'full' WHEN length(answer) > 300 THEN 'extract' WHEN answer IS NULL THEN 'none' ELSE 'full' END AS gate FROM ordered WHERE place = 1""")
def extraction_gate(spark, folder):
    """Whether the best answer is cut down or given whole."""
    i = F.col("intent")
    gate = F.when(i.isin("FEE", "LIMIT", "TIME"), "extract").when(F.col("score") >= 2, "full").when(F.length("answer") > 300, "extract").when(F.col("answer").isNull(), "none").otherwise("full")
    return _reranked(spark, folder).where("place = 1").select("query_id", "doc_id", gate.alias("gate"))


_BANK = r"(?:[Nn]gân hàng) (\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)|(\p{Lu}\p{L}+) Bank"
#: Other names of a bank, as a document may have them.
ALIASES = {"hải đăng xanh": ["hải đăng xanh", "hdx"], "saltgate": ["saltgate", "salt gate"]}


def _guarded(spark, folder):
    q = F.col("query")
    bank = F.coalesce(F.nullif(F.regexp_extract(q, _BANK, 1), F.lit("")), F.nullif(F.regexp_extract(q, _BANK, 2), F.lit("")))
    return rerank.guarded(_reranked(spark, folder).where("place <= 5"), bank, ALIASES, STOPS["guard"])


@query()
def similarity_boost(spark, folder):
    """Boosts by likeness of the questions, and the guard against answers about something else or another bank."""
    return _guarded(spark, folder).select("query_id", "doc_id", F.round("ratio", 6).alias("ratio"), F.round("coverage", 6).alias("coverage"), "bank", F.round("boosted", 6).alias("boosted"), "status")


@query()
def ranked_answer(spark, folder):
    """The best document of each question after all boosts, its status, and whether its answer is cut down to a value."""
    from quern.operators.ranking import every_query

    rows = _guarded(spark, folder)
    w = Window.partitionBy("query_id").orderBy(F.round("boosted", 9).desc(), "place", "doc_id")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(value_extract(spark, folder).withColumnRenamed("faq_id", "doc_id"), "doc_id")
    i = F.col("intent")
    value = F.when(i == "FEE", F.col("fee")).when(i == "LIMIT", F.col("limit")).when(i == "TIME", F.col("time"))
    gate = rerank.extraction(i, F.col("answer"), F.col("ratio"), value, F.when(value.isNotNull(), 0.9).otherwise(0.0))
    best = first.withColumns(gate).select(
        "query_id", "doc_id", F.round("boosted", 6).alias("score"), F.col("status").alias("found"), "intent", "wanted", "used", F.when(F.col("used"), value).otherwise(F.col("answer")).alias("answer")
    )
    all_ = every_query(asked(spark, folder), best.select("query_id", "doc_id", "score"))
    return all_.join(best.drop("doc_id", "score"), "query_id", "left").select("query_id", "doc_id", "score", F.coalesce("found", "status").alias("status"), "intent", F.coalesce("wanted", F.lit(False)).alias("wanted"), F.coalesce("used", F.lit(False)).alias("used"), "answer")


CASES_OF_A_DOC = [  # case_id, name, method, features, statuses, keywords, description
    (1, "lệnh bị trả lại", "ngân hàng", ["chuyển tiền"], ["bị trả lại"], ["lệnh"], "tiền chưa tới ngân hàng nhận và lệnh bị trả lại"),
    (2, "mã chưa nhận", "otp", ["nạp tiền"], ["không nhận được mã"], ["ví", "mã"], "không nhận được mã otp khi nạp tiền vào ví"),
    (3, "biểu phí", "tra cứu", [], [], ["phí", "hạn mức"], "phí và hạn mức của thẻ là bao nhiêu"),
]
_case_type = "case_id int, name string, method string, features array<string>, statuses array<string>, keywords array<string>, description string"
_list = lambda terms: "CAST([" + ", ".join(f"'{t}'" for t in terms) + "] AS VARCHAR[])"
_case_values = "(VALUES " + ", ".join(f"({n}, '{a}', '{m}', {_list(f)}, {_list(t)}, {_list(k)}, '{d}')" for n, a, m, f, t, k, d in CASES_OF_A_DOC) + ") c(case_id, name, method, f, s, k, description)"
_n = lambda l: f"len(list_filter({l}, lambda x: contains(text, x)))"


def _cases(faq):
    """Three cases for each document, a fixture."""
    texts = lambda terms: F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    names = [c.split()[0] for c in _case_type.split(", ")]
    own = F.array(*[F.struct(*[(texts(v) if isinstance(v, list) else F.lit(v)).alias(c) for c, v in zip(names, row)]) for row in CASES_OF_A_DOC])
    return faq.select(F.col("faq_id").alias("doc_id"), F.explode(own).alias("c")).select("doc_id", "c.*")


@query(f"""WITH h AS (SELECT faq_id AS query_id, faq_id AS doc_id, lower(coalesce(question, '')) AS text FROM faq), b AS (SELECT *, 20 * {_n('f')} + 25 * {_n('s')} + 3 * {_n('k')} AS found FROM h, {_case_values}),
  s AS (SELECT query_id, doc_id, case_id, found + CASE WHEN found = 0 THEN 10 * CAST(contains(text, name) AS INT) + 10 * CAST(contains(text, method) AS INT) ELSE 0 END + CASE WHEN case_id = 1 THEN 1 ELSE 0 END AS score FROM b)
  SELECT query_id, doc_id, case_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) = 1""")
def case_select(spark, folder):
    """The best case of each document for its question (the fixture gives every document three)."""
    faq = table(spark, folder, "faq")
    hits = faq.select(F.col("faq_id").alias("query_id"), F.col("faq_id").alias("doc_id"), F.coalesce("question", F.lit("")).alias("text"))
    return P.best_case(hits, _cases(faq), "text")


_set = lambda c: f"list_filter(list_distinct(string_split_regex({c}, '\\s+')), lambda w: w <> '')"


@query(f"""WITH h AS (SELECT conv_id * 1000 + turn_no AS query_id, faq_id AS doc_id, lower(user_query) AS text FROM (SELECT DISTINCT conv_id, turn_no, faq_id, user_query FROM chat_turn WHERE faq_id IS NOT NULL AND user_query IS NOT NULL)),
  s AS (SELECT query_id, doc_id, case_id, 10 * {_n('s')} + 2 * len(list_intersect({_set('text')}, {_set('description')})) AS score FROM h, {_case_values})
  SELECT query_id, doc_id, case_id, score, least(score / 20, 1) AS confidence FROM s WHERE score > 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, case_id) = 1""")
def case_search(spark, folder):
    """P10: for a follow-up turn, the best case of the document it was answered by, where it scores above 5."""
    turns = table(spark, folder, "chat_turn").where("faq_id IS NOT NULL AND user_query IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn_no")).alias("query_id"), F.col("faq_id").alias("doc_id"), F.col("user_query").alias("text")).distinct()
    return P.cases_found(turns, _cases(table(spark, folder, "faq")), "text")


@query("""WITH a AS (SELECT case_id AS query_id, f.faq_id AS doc_id, 0 AS branch FROM followup_case c JOIN faq f ON f.faq_id = c.case_id WHERE c.expected), b AS (SELECT case_id AS query_id, min(faq_id) AS doc_id, 1 AS branch FROM followup_case c JOIN faq f ON contains(lower(f.question), lower(c.memories[1].metadata['topic'])) GROUP BY case_id)
  SELECT case_id AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.branch, b.branch, 2) AS branch FROM followup_case c LEFT JOIN a ON a.query_id = c.case_id LEFT JOIN b ON b.query_id = c.case_id""")
def followup_branch(spark, folder):
    """A follow-up stays with its document, else goes by the remembered topic, else is a plain search."""
    cases = table(spark, folder, "followup_case")
    faq = table(spark, folder, "faq").select(F.col("faq_id").alias("doc_id"), "question")
    first = cases.where("expected").select(F.col("case_id").alias("query_id")).join(faq.select("doc_id"), F.col("query_id") == F.col("doc_id")).select("query_id", "doc_id")
    topics = cases.select(F.col("case_id").alias("query_id"), F.lower(F.try_element_at(F.try_element_at("memories", F.lit(1))["metadata"], F.lit("topic"))).alias("topic")).where("topic IS NOT NULL")
    named = topics.select("topic").distinct()  # topics of the fixture: fewer than its forty rows
    by_topic = faq.join(F.broadcast(named), F.contains(F.lower("question"), F.col("topic"))).groupBy("topic").agg(F.min("doc_id").alias("doc_id"))
    second = topics.join(by_topic, "topic").select("query_id", "doc_id")
    plain = cases.select(F.col("case_id").alias("query_id"), F.lit(None).cast("long").alias("doc_id"))
    return ranking.first_branch([first, second, plain]).select("query_id", "doc_id", "branch")


@query("""SELECT lower(trim(status)) AS status, count(*) AS n, count(DISTINCT lower(trim(question))) AS questions, round(avg(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 6) AS mean FROM rag_result GROUP BY lower(trim(status))""")
def result_stats(spark, folder):
    """Answers by status, however it's spelled."""
    known = F.when(~F.isnan("confidence"), F.col("confidence"))
    return table(spark, folder, "rag_result").groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower(F.trim("question"))).alias("questions"), F.round(F.avg(known), 6).alias("mean"))


@query(f"""SELECT faq_id, concat_ws('; ', 'fee ' || fee, 'limit ' || "limit", 'time ' || "time") AS text FROM (SELECT faq_id, {_value} FROM faq) WHERE coalesce(fee, "limit", "time") IS NOT NULL""")
def answer_from_fields(spark, folder):
    """An answer put together from the values that were found."""
    values = value_extract(spark, folder).where(F.coalesce("fee", "limit", "time").isNotNull())
    return values.select("faq_id", F.concat_ws("; ", *[F.concat(F.lit(f"{k} "), F.col(k)) for k in ("fee", "limit", "time")]).alias("text"))


@query("""WITH q AS (SELECT DISTINCT conv_id, turn_no, faq_id, user_query FROM chat_turn WHERE faq_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY ingested_at DESC) = 1),
  s AS (SELECT faq_id, CAST(regexp_extract(line, '^\\s*(?:Bước |B|Step |\\(?)(\\d+)', 1) AS INT) AS number FROM (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line FROM faq WHERE answer IS NOT NULL) WHERE regexp_matches(line, '^\\s*(Bước \\d{1,3}:|B\\d{1,3} -|Step \\d{1,3}:|\\(?\\d{1,3}[.)]) ')),
  n AS (SELECT faq_id, max(number) AS last FROM s GROUP BY faq_id)
  SELECT conv_id, turn_no, CASE WHEN last IS NULL THEN 'search' WHEN wanted > last THEN 'completed' ELSE 'steps' END AS branch, CASE WHEN last IS NOT NULL AND wanted <= last THEN wanted END AS step
  FROM (SELECT *, coalesce(CAST(nullif(regexp_extract(lower(coalesce(user_query, '')), '(?:bước|step) (\\d{1,4})', 1), '') AS INT), 1) AS wanted FROM q) LEFT JOIN n USING (faq_id)""")
def continuation_resolve(spark, folder):
    """Whether a turn goes on with steps, is past the last, or has to be searched."""
    turns = D.latest(table(spark, folder, "chat_turn").drop("entities").where("faq_id IS NOT NULL"), ["conv_id", "turn_no"], "ingested_at")
    named = F.nullif(F.regexp_extract(F.lower(F.coalesce("user_query", F.lit(""))), r"(?:bước|step) (\d{1,4})", 1), F.lit("")).cast("int")
    last = P.parsed_steps(table(spark, folder, "faq"), "faq_id", "answer").groupBy("faq_id").agg(F.max("number").alias("last"))
    rows = turns.select("conv_id", "turn_no", "faq_id", F.coalesce(named, F.lit(1)).alias("wanted")).join(last, "faq_id", "left")
    branch = F.when(F.col("last").isNull(), "search").when(F.col("wanted") > F.col("last"), "completed").otherwise("steps")
    return rows.select("conv_id", "turn_no", branch.alias("branch"), F.when(branch == "steps", F.col("wanted")).alias("step"))


@query("SELECT string_split(source, '/')[-1] AS source, count(*) AS n FROM faq WHERE regexp_matches(question, '[\\p{L}\\p{N}]') AND lower(trim(question, ' ')) <> 'nan' AND regexp_matches(answer, '[\\p{L}\\p{N}]') AND lower(trim(answer, ' ')) <> 'nan' GROUP BY ALL")
def json_documents(spark, folder):
    """Documents written as JSON arrays and read back, by source."""
    path = scratch(spark, "json")
    built = S.built(table(spark, folder, "faq"), "faq_id")
    tables.write_json_arrays(built.select("page_content", F.create_map(F.lit("source"), "source").alias("metadata")), path)
    return S.from_json(spark, path).groupBy(F.col("metadata")["source"].alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT faq_id, row_id FROM faq WHERE intent = 'HOW_TO' AND row_id >= 10")
def sql_parameters(spark, folder):
    """SQL text with bound parameters."""
    return tables.run(spark, "SELECT faq_id, row_id FROM {faq} WHERE intent = :intent AND row_id >= :least", {"faq": table(spark, folder, "faq")}, intent="HOW_TO", least=10)

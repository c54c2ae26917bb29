"""Text functions, rule packs and query understanding (ops T1-T22, Q1-Q17, C3, C6, C13, C14).

The packs are this project's own, small, and data: patterns are terms, an intent
has a weight and a priority. ``operators.rules`` compiles a pack into one column
expression, so a question is read once and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import rules
from quern.plans.common import sql_any, sql_hits, sql_list, sql_words, table
from quern.operators.sparse import STOP_WORDS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, coalesce(len({sql_words('text')}), 0) AS n_words, coalesce(len(list_distinct({sql_words('text')})), 0) AS n_distinct FROM documents")
def tokenize_counts(spark, folder):
    """Words of each document."""
    w = X.words(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


# The words that each of four uses leaves out.
STOPS = {
    "bm25": STOP_WORDS,
    "relevance": "tôi bạn là có thể được để và hoặc hay này đó như thế nào gì sao làm muốn cần của cho với từ đến trong bao nhiêu ở đâu mà khi nếu thì vì do bởi nhưng còn vẫn".split(),
    "keyword": "tôi bạn là có thể được để và hoặc hay này đó như thế nào gì sao làm muốn cần của cho với từ đến trong ngoài trên dưới khi nếu thì mà vì do bởi nhưng còn vẫn đang sẽ đã rồi chưa không phải những".split(),
    "guard": "tôi bạn là có thể được để và hoặc hay này đó như thế nào gì sao làm muốn cần của cho với từ đến trong bao nhiêu ở đâu".split(),
}
SHORTEST = {"bm25": 1, "relevance": 2, "keyword": 2, "guard": 3}
_kept = ", ".join(f"array_to_string(list_filter({sql_words('question')}, lambda w: NOT list_contains({sql_list(STOPS[n])}, w) AND length(w) >= {SHORTEST[n]}), ' ') AS {n}" for n in STOPS)


@query(f"SELECT faq_id, {_kept} FROM faq")
def stopword_filter(spark, folder):
    """What each use keeps of a question: without its stop words, and words of its least length."""
    kept = [F.array_join(X.content_words(F.col("question"), STOPS[n], SHORTEST[n]), " ").alias(n) for n in STOPS]
    return table(spark, folder, "faq").select("faq_id", *kept)


@query(f"SELECT faq_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS distinct_words FROM (SELECT faq_id, {sql_words('question')} AS l FROM faq)")
def ordered_dedup(spark, folder):
    """Distinct words in the order of their first occurrence."""
    return table(spark, folder, "faq").select("faq_id", F.array_join(F.array_distinct(X.words(F.col("question"))), " ").alias("distinct_words"))


RESTORE = {"ngan": "ngân", "hang": "hàng", "khong": "không", "duoc": "được", "tien": "tiền", "the": "thẻ", "phi": "phí", "chuyen": "chuyển", "tai": "tài", "khoan": "khoản", "bao": "bao", "nhieu": "nhiêu", "toi": "tôi", "may": "máy", "loi": "lỗi"}
MARKED = "[àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]"
_case = "(CASE " + " ".join(f"WHEN b = '{a}' THEN '{b}'" for a, b in RESTORE.items()) + " ELSE b END)"


@query(f"""WITH w AS (SELECT query_id, query, unnest(string_split_regex(trim(lower(query)), '\\s+')) AS w, generate_subscripts(string_split_regex(trim(lower(query)), '\\s+'), 1) AS n FROM intent_query),
  p AS (SELECT query_id, query, w, n, regexp_replace(w, '[?.!,;:]$', '') AS b FROM w)
  SELECT query_id, CASE WHEN regexp_matches(lower(query), '{MARKED}') THEN query ELSE string_agg({_case} || substr(w, length(b) + 1), ' ' ORDER BY n) END AS restored FROM p GROUP BY query_id, query""")
def restore_diacritics(spark, folder):
    """Accents put back by a table where a question has none."""
    return table(spark, folder, "intent_query").select("query_id", X.restored(F.col("query"), RESTORE, MARKED).alias("restored"))


_learned = f"""(SELECT bare, arg_max(word, (n, word)) AS word FROM (SELECT word, translate(word, '{X.ACCENTED}', '{X.BARE}') AS bare, count(*) AS n FROM (SELECT unnest({sql_words('question')}) AS word FROM faq WHERE regexp_matches(lower(question), '{MARKED}')) GROUP BY word) GROUP BY bare)"""


@query(f"""WITH t AS {_learned}, w AS (SELECT conv_id, turn_no, ingested_at, user_query, n, w FROM (SELECT conv_id, turn_no, ingested_at, user_query, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS w FROM (SELECT *, {sql_words('user_query')} AS l FROM chat_turn WHERE user_query IS NOT NULL AND NOT regexp_matches(lower(user_query), '{MARKED}'))))
  SELECT DISTINCT conv_id, turn_no, restored FROM (SELECT conv_id, turn_no, ingested_at, string_agg(coalesce(t.word, w), ' ' ORDER BY n) AS restored FROM w LEFT JOIN t ON t.bare = w.w GROUP BY ALL)""")
def restore_from_corpus(spark, folder):
    """Accents put back by a table of the corpus' own words: for each word without accents the most frequent one that it may stand for; texts with accents are left out."""
    faq = table(spark, folder, "faq").where(F.lower("question").rlike(MARKED))
    learned = X.restoration(faq, "question")
    turns = table(spark, folder, "chat_turn").where(F.col("user_query").isNotNull() & ~F.lower("user_query").rlike(MARKED)).select("conv_id", "turn_no", "user_query").distinct()
    words = turns.select("conv_id", "turn_no", "user_query", F.posexplode(X.words(F.col("user_query"))).alias("n", "bare")).join(learned, "bare", "left")
    rows = words.groupBy("conv_id", "turn_no", "user_query").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("word", "bare").alias("w")))).alias("l"))
    return rows.select("conv_id", "turn_no", F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("restored")).distinct()


@query("SELECT DISTINCT memory_id, sha256(coalesce(content, '')) AS content_id, left(content, 100) AS short, length(content) AS n FROM memory")
def content_hash(spark, folder):
    """A stable id of the content and its first hundred characters."""
    c = F.col("content")
    return table(spark, folder, "memory").select("memory_id", F.sha2(F.coalesce(c, F.lit("")), 256).alias("content_id"), F.left(c, F.lit(100)).alias("short"), F.length(c).cast("long").alias("n")).distinct()


@query("SELECT result_id, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'low' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM rag_result")
def confidence_label(spark, folder):
    """T20."""
    return table(spark, folder, "rag_result").select("result_id", X.confidence_label(F.col("confidence")).alias("label"))


NO_INFO = ["không tìm thấy", "chưa có thông tin", "không thể trả lời", "no answer", "can't help", "not able to"]


@query(f"""SELECT result_id, CASE WHEN answer IS NULL OR {sql_any('answer', NO_INFO)} THEN 'low' WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence >= 0.7 THEN 'high' ELSE 'medium' END AS class FROM rag_result""")
def confidence_class(spark, folder):
    """Low for an answer that gives nothing, else by the score."""
    c = F.col("confidence")
    known = F.when(F.col("answer").isNull() | X.has_any(F.col("answer"), NO_INFO), "low").when(c.isNotNull() & ~F.isnan(c) & (c >= 0.7), "high").otherwise("medium")
    return table(spark, folder, "rag_result").select("result_id", known.alias("class"))


@query("""SELECT result_id, round(avg(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END) OVER (PARTITION BY coalesce(intent, '') ORDER BY asked_at, result_id ROWS UNBOUNDED PRECEDING), 4) AS mean FROM rag_result""")
def running_confidence(spark, folder):
    """The mean so far, by intent, to four decimals: one sequential sum a group, whose last bit decides ties as it does in the SQL."""
    c = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(0.0)).otherwise(F.col("confidence"))
    w = Window.partitionBy(F.coalesce("intent", F.lit(""))).orderBy("asked_at", "result_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "rag_result").select("result_id", F.round(F.avg(c).over(w), 4).alias("mean"))


@query("""SELECT result_id, round(avg(CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END) OVER (PARTITION BY coalesce(intent, '') ORDER BY asked_at NULLS FIRST, result_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM rag_result""")
def running_confidence_by_unit(spark, folder):
    """T22 for groups of any size: the mean so far, to nine decimals, from sums by day and within a day."""
    c = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(0.0)).otherwise(F.col("confidence"))
    rows = table(spark, folder, "rag_result").select("result_id", F.coalesce("intent", F.lit("")).alias("intent"), "asked_at", c.alias("c"))
    return X.running_mean(rows, "intent", "asked_at", "result_id", "c").select("result_id", F.round("mean", 9).alias("mean"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fact_parse(spark, folder):
    """A fixed shape from a JSON payload; a malformed one gives null."""
    payload = F.from_json(X.without_fences(F.col("props")), "k long")
    return table(spark, folder, "events").select("event_id", payload["k"].alias("k"))


_fenced = "'```json' || chr(10) || 'note ' || props || chr(10) || '```'"


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_object_span(spark, folder):
    """The same from a fenced text with words before the object."""
    wrapped = F.concat(F.lit("```json\nnote "), "props", F.lit("\n```"))
    payload = F.from_json(X.object_span(X.without_fences(wrapped)), "k long")
    return table(spark, folder, "events").select("event_id", payload["k"].alias("k"))


@query("""SELECT faq_id, CAST(sum(CASE WHEN step AND (commas >= 2 OR commas >= 1 AND length(line) > 80) THEN commas_split + 1 ELSE 1 END) AS BIGINT) AS lines FROM (SELECT faq_id, line,
  length(line) - length(replace(line, ',', '')) AS commas, (length(line) - length(replace(line, ', ', ''))) // 2 AS commas_split, regexp_matches(line, '^\\s*(Bước \\d+|B\\d+|Step \\d+|\\(?\\d+[.)])') AS step
  FROM (SELECT faq_id, unnest(string_split(coalesce(answer, ''), chr(10))) AS line FROM faq)) GROUP BY faq_id""")
def answer_reflow(spark, folder):
    """The number of lines after step lines are split by clause."""
    return table(spark, folder, "faq").select("faq_id", F.size(F.split(X.reflowed(F.col("answer")), "\n")).cast("long").alias("lines"))


@query("""SELECT faq_id, (length(trim(answer)) < 60 AND NOT regexp_matches(trim(answer), '[.!?]$')) OR (length(answer) < 0.3 * length(question)) OR (NOT contains(trim(answer), ' ')) OR regexp_matches(trim(answer), '^[^.]{0,80}:$') AS is_title FROM faq WHERE answer IS NOT NULL AND question IS NOT NULL""")
def title_or_summary_flag(spark, folder):
    """Answers that are a heading rather than an answer."""
    a, q = F.trim("answer"), F.col("question")
    flag = ((F.length(a) < 60) & ~a.rlike("[.!?]$")) | (F.length("answer") < 0.3 * F.length(q)) | ~a.contains(" ") | a.rlike("^[^.]{0,80}:$")
    return table(spark, folder, "faq").where("answer IS NOT NULL AND question IS NOT NULL").select("faq_id", flag.alias("is_title"))


DONE = ["thành công", "hoàn tất", "xác nhận", "completed", "confirm"]
#: How a step that ends a process begins, what is done in one, and what is only a hint where a step is short.
ENDS, ENDING, HINTS = ["cuối cùng", "bước cuối", "finally"], ["xác nhận", "hoàn tất", "bấm đồng ý", "confirm", "submit"], ["thành công", "xong", "done", "completed"]


_done = f"""CASE WHEN {' OR '.join(f"starts_with(trim(regexp_replace(lower(line), '^(bước [0-9]+:|b[0-9]+ -|step [0-9]+:)', '')), '{t}')" for t in ENDS)} THEN 'strong' WHEN {sql_any('line', ENDING)} THEN 'action' WHEN {sql_any('line', HINTS)} AND length(line) < 120 THEN 'weak' END"""


@query(f"SELECT faq_id, no, {_done} AS rule, {_done} IS NOT NULL AS completes FROM (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS no FROM faq WHERE answer IS NOT NULL) WHERE regexp_matches(line, '^(Bước \\d+:|B\\d+ -|Step \\d+:)')")
def completion_step_flag(spark, folder):
    """Step lines that end a process: by how they begin, what is done, or, where short, a hint."""
    lines = table(spark, folder, "faq").where("answer IS NOT NULL").select("faq_id", F.posexplode(F.split("answer", "\n")).alias("no", "line")).where(F.col("line").rlike(r"^(Bước \d+:|B\d+ -|Step \d+:)"))
    said = F.trim(F.regexp_replace(F.lower("line"), r"^(bước [0-9]+:|b[0-9]+ -|step [0-9]+:)", ""))
    strong = F.lit(False)
    for t in ENDS:
        strong = strong | said.startswith(t)
    rule = F.when(strong, "strong").when(X.has_any(F.col("line"), ENDING), "action").when(X.has_any(F.col("line"), HINTS) & (F.length("line") < 120), "weak")
    return lines.select("faq_id", (F.col("no") + 1).cast("long").alias("no"), rule.alias("rule"), rule.isNotNull().alias("completes"))


@query("SELECT result_id, round(1 / (1 + confidence), 6) AS inverse, round(least(confidence / 10, 1), 6) AS tenth, round(1 / (1 + 0.5 * confidence), 6) AS half FROM rag_result WHERE confidence IS NOT NULL AND NOT isnan(confidence)")
def score_arithmetic(spark, folder):
    """T15."""
    c = F.col("confidence")
    return table(spark, folder, "rag_result").where(c.isNotNull() & ~F.isnan(c)).select("result_id", F.round(1 / (1 + c), 6).alias("inverse"), F.round(F.least(c / 10, F.lit(1.0)), 6).alias("tenth"), F.round(1 / (1 + 0.5 * c), 6).alias("half"))


INTENTS = rules.IntentPack(
    [
        rules.Intent("FEE", 1, 1.2, ["phí", "bao nhiêu tiền", "~(mất|tốn|chịu|thu) phí", "~(fee|charge|cost)s? (is|for|of|to)", "~phí .{0,80}(là )?bao nhiêu", "~what is the fee"], ["mức phí", "biểu phí", "miễn phí", "fee", "cost", "charge"]),
        rules.Intent("LIMIT", 2, 1.2, ["hạn mức", "tối đa", "~(quá|trên|dưới) [0-9.,]+ ?(đồng|vnd)", "~(at most|more than|up to) [0-9.,]+", "~hạn mức .{0,80}bao nhiêu"], ["quá", "mỗi ngày", "mỗi lần", "tối thiểu", "giới hạn", "limit", "at most"]),
        rules.Intent("TIME", 3, 1.1, ["mất bao lâu", "bao giờ", "how long", "~(bao lâu|khi nào) (thì|mới|nữa)?", "~[0-9]+ ngày nữa"], ["thời gian", "khi nào", "when", "ngày nữa", "trong vòng"]),
        rules.Intent("TROUBLESHOOT", 4, 1.0, ["phải làm sao", "what now", "bị lỗi", "không được", "~nhưng .{0,80}(lỗi|không|chưa|treo)", "~but .{0,80}(error|fails|pending|taken)", "~(err|lx|s|e)-?[0-9]{3,5}"], ["lỗi", "error", "tự thoát", "fails", "bị từ chối", "declined", "treo"]),
        rules.Intent("STATUS_CHECK", 5, 1.0, ["trạng thái", "status", "~(xem|tra cứu|kiểm tra) .{0,40}(lệnh|giao dịch)", "~where (do|can) i see"], ["ở đâu", "tra cứu", "đã nhận", "has arrived"]),
        rules.Intent("REQUIREMENT", 6, 1.0, ["cần gì", "giấy tờ gì", "which papers", "cần căn cước", "cần hộ chiếu", "~cần .{0,40} gì để", "~(do|does) .{0,40} need"], ["điều kiện", "yêu cầu", "papers", "giấy", "đơn đề nghị"]),
        rules.Intent("WHY", 7, 1.0, ["vì sao", "tại sao", "why", "~^(vì|tại) sao", "~why (does|do|is|was)"], ["lý do", "nguyên nhân", "reason"]),
        rules.Intent("HOW_TO", 8, 0.9, ["làm thế nào", "how can i", "how do i", "~làm (thế nào|sao|cách nào) để", "~có thể .{0,80} không"], ["cách", "hướng dẫn", "các bước", "steps"]),
        rules.Intent("COMPARISON", 9, 0.8, ["so sánh", "khác nhau", "~khác (gì|thế nào) (với|so)", "~(compare|difference between)"], ["hơn", "so với", "versus", "better"]),
        rules.Intent("INFO_REQUEST", 10, 0.5, ["là gì", "nghĩa là gì", "what does", "~what (is|are|does)"], ["thông tin", "information", "có cần"]),
    ],
    fallback="INFO_REQUEST", fallback_confidence=0.3, override=("TROUBLESHOOT", "TIME", ["bao lâu", "how long", "~khi nào .{0,40}nhận"]), floors={"FEE": 0.6, "LIMIT": 0.6, "TIME": 0.6},
)
CLASSIFIED = INTENTS.sql("SELECT query_id AS id, query AS text FROM intent_query")


@query(f"SELECT id AS query_id, intent, round(confidence, 6) AS confidence FROM ({CLASSIFIED})")
def intent_classify(spark, folder):
    """Q1-Q3: intent and confidence of each labelled question."""
    rows = table(spark, folder, "intent_query").withColumns(INTENTS.columns(F.col("query")))
    return rows.select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT expected_intent, intent, count(*) AS n FROM ({CLASSIFIED}) c JOIN intent_query q ON q.query_id = c.id GROUP BY ALL")
def intent_confusion(spark, folder):
    """Q1: given and found intents of the labelled questions."""
    rows = table(spark, folder, "intent_query").withColumns(INTENTS.columns(F.col("query")))
    return rows.groupBy("expected_intent", "intent").agg(F.count(F.lit(1)).alias("n"))


FAQ_CLASSIFIED = INTENTS.sql("SELECT faq_id AS id, question AS text FROM faq")


@query(f"SELECT intent, count(*) AS n FROM ({FAQ_CLASSIFIED}) GROUP BY intent")
def intent_distribution(spark, folder):
    """Q1: intents over all FAQ questions."""
    return table(spark, folder, "faq").withColumns(INTENTS.columns(F.col("question"))).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id AS query_id, intent, intent IN ('FEE', 'LIMIT', 'TIME') AS specific, CASE intent WHEN 'FEE' THEN 'value' WHEN 'LIMIT' THEN 'value' WHEN 'TIME' THEN 'value' WHEN 'HOW_TO' THEN 'steps' ELSE 'full' END AS extraction, 5 * CASE intent WHEN 'HOW_TO' THEN 3 ELSE 2 END AS candidates, 15 * CASE intent WHEN 'HOW_TO' THEN 3 ELSE 2 END AS searched FROM ({CLASSIFIED})")
def intent_kinds(spark, folder):
    """Q5, Q16: what an intent's answer is cut to, how many candidates are fetched, and three times as many searched by entities and vectors."""
    rows = table(spark, folder, "intent_query").withColumns(INTENTS.columns(F.col("query")))
    i = F.col("intent")
    return rows.select("query_id", "intent", i.isin("FEE", "LIMIT", "TIME").alias("specific"), F.when(i.isin("FEE", "LIMIT", "TIME"), "value").when(i == "HOW_TO", "steps").otherwise("full").alias("extraction"), (5 * F.when(i == "HOW_TO", 3).otherwise(2)).alias("candidates"), (15 * F.when(i == "HOW_TO", 3).otherwise(2)).alias("searched"))


ENTITIES = rules.EntityPack({
    "Error": [("số dư không đủ", ["số dư không đủ", "balance was too low"]), ("tự thoát", ["tự thoát", "closes by itself"]), ("bị từ chối", ["bị từ chối", "declined"]), ("mã lỗi", ["err-", "mã lỗi", "error", "~(^|[^a-z0-9])(err|lx|s|e)-?[0-9]{3,5}($|[^0-9])"]), ("treo", ["đang xử lý", "hangs in pending"]),
              ("không nhận được", ["~(không|chưa) (nhận|thấy) (được )?(mã|tiền|biên lai)", "has not arrived"]), ("hiển thị sai", ["hiển thị sai", "wrong balance"]), ("đã bị trừ", ["đã bị trừ", "money was taken"])],
    "Topic": [("liên ngân hàng", ["~chuyển .{0,60}ngân hàng", "~send .{0,60} bank"]), ("thanh toán", ["thanh toán", "pay a bill", "payment"]), ("vay", ["khoản vay", "loan"]), ("tiết kiệm", ["tiết kiệm", "savings"]), ("điểm thưởng", ["điểm thưởng", "points"]), ("định danh", ["định danh", "xác thực", "verify my papers"])],
    "Action": [("chuyển tiền", ["chuyển tiền", "send money"]), ("nạp tiền", ["nạp tiền", "top up"]), ("rút tiền", ["rút tiền", "withdraw"]), ("in sao kê", ["in sao kê", "print a statement"]), ("đổi mật khẩu", ["đổi mật khẩu", "~(reset|change) (the |my )?password"]), ("khoá thẻ", ["~kho[áa] thẻ|khóa thẻ", "freeze the card"]),
               ("liên kết thẻ", ["liên kết thẻ", "link a card"]), ("huỷ lệnh", ["~hu[ỷy] lệnh|hủy lệnh", "cancel"]), ("tra soát", ["tra soát", "trace"]), ("đăng ký vân tay", ["đăng ký vân tay", "enrol a fingerprint"])],
    "Status": [("thành công", ["thành công", "completed"]), ("đang xử lý", ["đang xử lý", "pending"]), ("thất bại", ["thất bại", "failed", "fails"]), ("bị trả lại", ["bị trả lại", "was returned"]), ("hết hạn", ["hết hạn", "expired"])],
    "Fee": [("phí", ["~(^|[^a-zà-ỹđ])phí($|[^a-zà-ỹđ])", "~(^|[^a-z])fees?($|[^a-z])"]), ("miễn phí", ["miễn phí", "free of charge"])],
    "Limit": [("hạn mức", ["hạn mức", "limit", "tối đa", "at most"]), ("số tiền", ["~quá [0-9.,]+ ?(đồng|vnd)", "~more than [0-9.,]+ credits"])],
    "Requirement": [("điều kiện", ["điều kiện", "~cần .{0,40} gì", "which papers"]), ("độ tuổi", ["dưới 18 tuổi", "~under [0-9]+"]), ("chưa nộp", ["~(khi|nếu) chưa nộp", "without handing in"])],
    "Feature": [("quét mã", ["quét mã", "scan a qr"]), ("hoàn tiền", ["hoàn tiền", "cashback"]), ("trả góp", ["trả góp", "installments"]), ("chia tiền", ["chia tiền", "split a bill"]), ("quà tặng", ["quà tặng", "gift"])],
    "UIElement": [("lịch sử giao dịch", ["lịch sử giao dịch", "history"]), ("cài đặt", ["cài đặt", "settings"]), ("thông báo", ["thông báo", "notifications"]), ("thẻ của tôi", ["thẻ của tôi", "my cards"])],
    "TimeFrame": [("thời gian", ["bao lâu", "how long", "thời gian"]), ("ngày", ["~[0-9]{1,3} ngày nữa", "~in [0-9]{1,3} days"]), ("giờ", ["~lúc [0-9]{1,2}:[0-9]{2}", "~at [0-9]{1,2}:[0-9]{2}"])],
    "Document": [("hộ chiếu", ["hộ chiếu", "passport"]), ("căn cước", ["căn cước", "citizen card"]), ("hợp đồng", ["hợp đồng", "contract"]), ("biên lai", ["biên lai", "receipt"]), ("hoá đơn mua hàng", ["hoá đơn mua hàng", "invoice"]), ("uỷ quyền", ["~(giấy|đơn) (u[ỷy]|ủy) quyền", "authorisation"]), ("sao kê", ["~sao kê (ba|sáu|[0-9]+) tháng", "bank statement"])],
    "AccountType": [("doanh nghiệp", ["doanh nghiệp", "business customers"]), ("sinh viên", ["sinh viên", "students"]), ("hội viên", ["~hội viên hạng [a-zà-ỹđ]+", "members"]), ("chủ cửa hàng", ["chủ cửa hàng", "shop owners"]), ("phổ thông", ["phổ thông", "basic customers"])],
    "ContactChannel": [("tổng đài", ["tổng đài", "hotline"]), ("chi nhánh", ["chi nhánh", "branch"]), ("giao dịch viên", ["giao dịch viên", "quầy giao dịch", "counter"]), ("trợ lý", ["trợ lý ảo", "in-app chat"]), ("bộ phận", ["~bộ phận (tra soát|chăm sóc)", "support team"])],
    "Service": [("ví", ["~(^|[^a-zà-ỹđ])ví ", "wallet"]), ("thẻ", ["~(^|[^a-zà-ỹđ])thẻ ", "card"]), ("gói", ["gói ", "plan"]), ("quỹ", ["quỹ ", "fund"]), ("sổ", ["sổ ", "savings"]), ("ứng dụng", ["ứng dụng", "~(^|[^a-z])app($|[^a-z])"]), ("tài khoản", ["tài khoản", "account"]), ("bảo hiểm", ["bảo hiểm", "insurance"])],
    "Bank": [("ngân hàng", ["~ngân hàng [a-zà-ỹđ]+ [a-zà-ỹđ]+", "~[a-z]+ bank"])],
})
FOUND = ENTITIES.sql("SELECT query_id AS id, query AS text FROM intent_query")


def _entities(spark, folder):
    rows = table(spark, folder, "intent_query")
    return rows.select("query_id", "query", F.explode(ENTITIES.column(F.col("query"))).alias("e")).select("query_id", "query", "e.etype", "e.value")


@query(f"SELECT id AS query_id, etype, value FROM ({FOUND})")
def entity_extract(spark, folder):
    """Typed entities of each question, in one pass."""
    return _entities(spark, folder).drop("query")


CONTEXT = [("chuyển", "ngân hàng", "Topic", "liên ngân hàng"), ("quét", "qr", "Topic", "thanh toán qr"), ("khoá", "thẻ", "Topic", "an toàn thẻ"), ("xác thực", "giấy tờ", "Topic", "định danh")]
_ctx = " UNION ALL ".join(f"SELECT query_id, '{e}' AS etype, '{v}' AS value FROM intent_query WHERE contains(lower(query), '{a}') AND contains(lower(query), '{b}')" for a, b, e, v in CONTEXT)


@query(_ctx)
def entity_context_rules(spark, folder):
    """Q7: entities that two words together stand for."""
    low = F.lower("query")
    cases = [F.when(low.contains(a) & low.contains(b), F.struct(F.lit(e).alias("etype"), F.lit(v).alias("value"))) for a, b, e, v in CONTEXT]
    rows = table(spark, folder, "intent_query").select("query_id", F.explode(F.array_compact(F.array(*cases))).alias("e"))
    return rows.select("query_id", "e.etype", "e.value")


GIVEN = "(SELECT conv_id, turn_no, user_query AS query, unnest(map_entries(entities)) AS m FROM (SELECT DISTINCT conv_id, turn_no, user_query, entities FROM chat_turn WHERE entities IS NOT NULL AND user_query IS NOT NULL))"


def given_entities(spark, folder):
    """Entities that came with the turns: (conv_id, turn_no, query, etype, value)."""
    rows = table(spark, folder, "chat_turn").where("entities IS NOT NULL AND user_query IS NOT NULL").select("conv_id", "turn_no", F.col("user_query").alias("query"), F.explode(F.map_entries("entities")).alias("m"))
    return rows.select("conv_id", "turn_no", "query", F.col("m.key").alias("etype"), F.explode("m.value").alias("value")).where("value IS NOT NULL").distinct()


@query(f"SELECT DISTINCT conv_id, turn_no, m.key AS etype, value, contains(lower(query), lower(value)) OR len(list_intersect({sql_words('query')}, {sql_words('value')})) > 0 AND m.key NOT IN ('bank', 'error') AS valid FROM (SELECT *, unnest(m.value) AS value FROM {GIVEN}) WHERE value IS NOT NULL")
def entity_validate(spark, folder):
    """Q8, Q12: whether an entity from outside is borne out by the text; banks and errors only literally."""
    rows = given_entities(spark, folder)
    literal = F.lower("query").contains(F.lower("value"))
    return rows.select("conv_id", "turn_no", "etype", "value", (literal | ((X.overlap(F.col("query"), F.col("value")) > 0) & ~F.col("etype").isin("bank", "error"))).alias("valid")).distinct()


CORRECTIONS = [("Error", "bị từ chối", "Status", "thất bại", "thất bại"), ("Status", "thành công", "Error", "treo", "đang xử lý"), ("Topic", "vay", "Action", "rút tiền", None)]
_corrected = "CASE " + " ".join(f"WHEN etype = '{t}' AND value = '{v}' AND EXISTS (SELECT 1 FROM f g WHERE g.id = f.id AND g.etype = '{u}' AND g.value = '{w}') THEN " + (f"'{n}'" if n else "NULL") for t, v, u, w, n in CORRECTIONS) + " ELSE value END"


@query(f"WITH f AS ({FOUND}) SELECT DISTINCT * FROM (SELECT id AS query_id, etype, {_corrected} AS value FROM f) WHERE value IS NOT NULL")
def entity_correct(spark, folder):
    """Q8: entities corrected by the others of their question: one value put for another, or left out."""
    rows = table(spark, folder, "intent_query").withColumn("found", ENTITIES.column(F.col("query")))
    return rows.select("query_id", F.explode(rules.corrected(F.col("found"), CORRECTIONS)).alias("e")).select("query_id", "e.etype", "e.value").distinct()


@query(f"""WITH f AS ({FOUND}), g AS (SELECT id, count(*) AS n, max(CAST(etype = 'Error' AS INT)) AS e, max(CAST(etype = 'Topic' AS INT)) AS t, max(CAST(etype = 'Service' AS INT)) AS s, count(DISTINCT etype) AS kinds FROM f GROUP BY id),
  c AS (SELECT query_id, query, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, coalesce(0.4 * e + 0.3 * t + 0.2 * s, 0) + CASE WHEN coalesce(n, 0) >= 3 THEN 0.1 ELSE 0 END AS confidence FROM intent_query LEFT JOIN g ON g.id = query_id)
  SELECT query_id, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN n = 0 THEN 'no_entities' WHEN confidence < 0.2999 THEN 'low_confidence' WHEN len({sql_words('query')}) > 25 AND kinds < 3 THEN 'long_query' WHEN n > 8 THEN 'ambiguous' ELSE 'rules' END AS route FROM c""")
def entity_confidence(spark, folder):
    """Q9, Q10: how much the entities tell (error, topic, service, three or more), and the first of four reasons not to rely on rules."""
    has = lambda e: F.exists(F.col("found"), lambda x: x["etype"] == e).cast("double")
    rows = table(spark, folder, "intent_query").withColumn("found", ENTITIES.column(F.col("query"))).withColumn("n", F.size("found"))
    rows = rows.withColumn("confidence", 0.4 * has("Error") + 0.3 * has("Topic") + 0.2 * has("Service") + F.when(F.col("n") >= 3, 0.1).otherwise(0.0))
    kinds = F.size(F.array_distinct(F.transform("found", lambda x: x["etype"])))
    route = F.when(F.col("n") == 0, "no_entities").when(F.col("confidence") < 0.2999, "low_confidence").when((F.size(X.words(F.col("query"))) > 25) & (kinds < 3), "long_query").when(F.col("n") > 8, "ambiguous").otherwise("rules")
    return rows.select("query_id", F.round("confidence", 6).alias("confidence"), route.alias("route"))


@query(f"""WITH c AS ({CLASSIFIED}), f AS (SELECT id, max(CAST(etype = 'Fee' AS INT)) AS fee, max(CAST(etype = 'Limit' AS INT)) AS lim, max(CAST(etype = 'Error' AS INT)) AS err FROM ({FOUND}) GROUP BY id)
  SELECT c.id AS query_id, CASE WHEN confidence >= 0.4 THEN intent WHEN fee = 1 THEN 'FEE' WHEN lim = 1 THEN 'LIMIT' WHEN err = 1 THEN 'TROUBLESHOOT' ELSE intent END AS intent FROM c LEFT JOIN f USING (id)""")
def intent_fallback(spark, folder):
    """Q4: where the confidence is low, the intent that the entities stand for."""
    rows = table(spark, folder, "intent_query").withColumns(INTENTS.columns(F.col("query"))).withColumn("found", ENTITIES.column(F.col("query")))
    has = lambda e: F.exists(F.col("found"), lambda x: x["etype"] == e)
    i = F.col("intent")
    return rows.select("query_id", F.when(F.col("confidence") >= 0.4, i).when(has("Fee"), "FEE").when(has("Limit"), "LIMIT").when(has("Error"), "TROUBLESHOOT").otherwise(i).alias("intent"))


OTHER = "(SELECT id AS query_id, etype, value FROM (%s))" % ENTITIES.sql("SELECT query_id AS id, query AS text FROM intent_query")


@query(f"""WITH p AS {OTHER}, l AS (SELECT query_id, 'Action' AS etype, 'chuyển tiền nhanh' AS value FROM intent_query WHERE contains(lower(query), 'chuyển')),
  u AS (SELECT query_id, etype, value, 'pattern' AS source FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.query_id = p.query_id AND l.etype = p.etype AND contains(l.value, p.value)) UNION ALL SELECT query_id, etype, value, 'given' FROM l) SELECT * FROM u""")
def entity_merge(spark, folder):
    """Pattern entities without those that a longer given one of the type contains."""
    p = _entities(spark, folder).select("query_id", "etype", "value")
    given = table(spark, folder, "intent_query").where(F.lower("query").contains("chuyển")).select("query_id", F.lit("Action").alias("etype"), F.lit("chuyển tiền nhanh").alias("value"))
    return rules.merged_entities(given, p)


_turn_found = ENTITIES.sql("SELECT DISTINCT conv_id * 1000 + turn_no AS id, user_query AS text FROM chat_turn WHERE user_query IS NOT NULL AND entities IS NOT NULL")


@query(f"""WITH p AS (SELECT DISTINCT id AS query_id, etype, value FROM ({_turn_found})), g AS (SELECT DISTINCT conv_id * 1000 + turn_no AS query_id, upper(left(m.key, 1)) || substr(m.key, 2) AS etype, lower(value) AS value FROM (SELECT *, unnest(m.value) AS value FROM {GIVEN}) WHERE value IS NOT NULL),
  u AS (SELECT * FROM p UNION SELECT * FROM g), s AS (SELECT * FROM g UNION SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = p.query_id AND g.etype = p.etype AND contains(g.value, p.value))),
  r AS (SELECT * FROM g UNION SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = p.query_id AND g.etype = p.etype)), a AS (SELECT * FROM g UNION SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = p.query_id))
  SELECT 'union' AS way, etype, count(*) AS n FROM u GROUP BY etype UNION ALL SELECT 'longer', etype, count(*) FROM s GROUP BY etype UNION ALL SELECT 'by_type', etype, count(*) FROM r GROUP BY etype UNION ALL SELECT 'if_none', etype, count(*) FROM a GROUP BY etype""")
def entity_merge_ways(spark, folder):
    """entities that came with the turns merged with those of the rules, in four ways: all; without what a longer one contains; rules for types that weren't given; rules for turns without any."""
    turns = table(spark, folder, "chat_turn").where("entities IS NOT NULL AND user_query IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn_no")).alias("query_id"), "user_query").distinct()
    pattern = turns.select("query_id", F.explode(ENTITIES.column(F.col("user_query"))).alias("e")).select("query_id", "e.etype", "e.value").distinct()
    given = given_entities(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn_no")).alias("query_id"), F.concat(F.upper(F.left("etype", F.lit(1))), F.substr("etype", F.lit(2))).alias("etype"), F.lower("value").alias("value")).distinct()
    ways = {
        "union": given.unionByName(pattern), "longer": rules.merged_entities(given, pattern).drop("source"), "by_type": given.unionByName(pattern.join(given.select("query_id", "etype").distinct(), ["query_id", "etype"], "left_anti")),
        "if_none": given.unionByName(pattern.join(given.select("query_id").distinct(), "query_id", "left_anti")),
    }
    all_ = None
    for way, rows in ways.items():
        part = rows.distinct().groupBy("etype").agg(F.count(F.lit(1)).alias("n")).withColumn("way", F.lit(way))
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.select("way", "etype", "n")


SMALL = {"greeting": ["xin chào", "chào bạn", "hello", "hi", "alo"], "thanks": ["cảm ơn", "cám ơn", "thanks", "thank you"], "bye": ["tạm biệt", "bye", "goodbye"]}
BUSINESS = ["thẻ", "tiền", "ngân hàng", "lỗi", "card", "bank", "money", "phí"]
_small = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(user_query, '')), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(t)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}'" for k, t in SMALL.items()) + " END"


#: The most words of a turn, by kind, and what is said to it.
MOST_WORDS, REPLIES = {"greeting": 15, "thanks": 10, "bye": 10}, {"greeting": "Xin chào! Bạn cần hỗ trợ gì?", "thanks": "Rất vui được hỗ trợ bạn.", "bye": "Hẹn gặp lại bạn."}
_limits = " ".join(f"WHEN kind = '{k}' AND n <= {n} THEN '{REPLIES[k]}'" for k, n in MOST_WORDS.items())


@query(f"""SELECT DISTINCT conv_id, turn_no, CASE WHEN reply IS NOT NULL THEN kind END AS kind, reply FROM (SELECT *, CASE {_limits} END AS reply FROM
  (SELECT conv_id, turn_no, len({sql_words('user_query')}) AS n, CASE WHEN NOT {sql_any('user_query', BUSINESS)} THEN {_small} END AS kind FROM chat_turn))""")
def smalltalk_detect(spark, folder):
    """Q14, Q15: greetings, thanks and farewells in short turns about nothing else, by whole words, and the reply."""
    q = F.col("user_query")
    kind = F.when(~X.has_any(q, BUSINESS), F.coalesce(*[F.when(X.whole_word(q, t), F.lit(k)) for k, t in SMALL.items()]))
    rows = table(spark, folder, "chat_turn").select("conv_id", "turn_no", kind.alias("kind"), F.size(X.words(q)).alias("n"))
    reply = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("n") <= n), F.lit(REPLIES[k])) for k, n in MOST_WORDS.items()])
    return rows.select("conv_id", "turn_no", F.when(reply.isNotNull(), F.col("kind")).alias("kind"), reply.alias("reply")).distinct()


DOMAIN = ["ngân hàng", "thẻ", "tiền", "ví ", "tài khoản", "sao kê", "hoá đơn", "otp", "bank", "card", "account", "payment", "money", "bill"]


@query(f"SELECT query_id, CASE WHEN {sql_any('query', DOMAIN)} THEN 'in_scope' ELSE 'out_of_scope' END AS scope FROM intent_query")
def out_of_scope(spark, folder):
    """Questions without a word of the domain."""
    return table(spark, folder, "intent_query").select("query_id", F.when(X.has_any(F.col("query"), DOMAIN), "in_scope").otherwise("out_of_scope").alias("scope"))


STRONG = ["vẫn không", "vẫn chưa", "bước tiếp", "tiếp theo", "còn gì nữa", "thế còn", "vậy còn", "still", "next step", "what about", "and then"]
FRESH = ["làm thế nào", "vì sao", "mã ", "how can i", "why does", "nếu "]
_fu = f"""CASE WHEN {sql_any('query', STRONG)} THEN 1 WHEN {sql_any('query', FRESH)} THEN 0 WHEN top >= 0.7 AND n_words <= 12 THEN 1 ELSE 0 END"""


@query(f"""SELECT case_id, {_fu} = 1 AS found, expected, CASE WHEN {_fu} = 0 THEN 'none' WHEN contains(lower(query), 'bước') OR contains(lower(query), 'step') THEN 'steps' WHEN n_words <= 4 THEN 'last_answer' ELSE 'topic' END AS context
  FROM (SELECT case_id, query, expected, len({sql_words('query')}) AS n_words, coalesce(list_max(list_transform(memories, lambda m: m.score)), 0) AS top FROM followup_case)""")
def followup_detect(spark, folder):
    """Follow-ups by strong words, then new-topic words, then the best memory; and what context they need."""
    q = F.col("query")
    rows = table(spark, folder, "followup_case").withColumn("n", F.size(X.words(q))).withColumn("top", F.coalesce(F.array_max(F.transform("memories", lambda m: m["score"])), F.lit(0.0)))
    found = F.when(X.has_any(q, STRONG), True).when(X.has_any(q, FRESH), False).otherwise((F.col("top") >= 0.7) & (F.col("n") <= 12))
    context = F.when(~F.col("found"), "none").when(X.has_any(q, ["bước", "step"]), "steps").when(F.col("n") <= 4, "last_answer").otherwise("topic")
    return rows.withColumn("found", found).select("case_id", "found", "expected", context.alias("context"))


# In order: what a turn refers back to, by eighteen patterns of steps, two of clarification and three of more.
REFER = [
    ("step", ["~bước (tiếp|sau|kế)", "~bước [0-9]{1,4}", "~(tiếp theo|kế tiếp)", "~sau đó (thì|làm|là)", "~(rồi|xong) (sao|làm gì|thì sao)", "~làm (tiếp|gì tiếp)", "~còn bước", "~(đến|tới) bước", "~(các|những) bước còn lại", "~tiếp tục", "~(xong|hoàn thành) bước", "~bước (cuối|đầu)", "next step", "~step [0-9]{1,4}", "~what (next|then)", "~(and|then) what", "~(remaining|other) steps", "~after (that|this)"]),
    ("clarify", ["~(nghĩa là|là sao|ý là|tức là)", "~what does (it|that|this)"]), ("more", ["~(còn|thêm) (gì|nữa)", "~(thế|vậy) còn", "~(what about|anything else|how about)"]),
]
STATUS = [("failed", ["bị trả lại", "bị từ chối", "chưa thấy", "thất bại", "was returned", "declined", "failed"]), ("pending", ["đang xử lý", "đang chờ", "hangs", "pending"]), ("done", ["thành công", "đã nhận", "arrived", "completed"])]
AFRESH = ["~(làm sao|làm thế nào|như thế nào|cách nào) để", "~hướng dẫn (tôi|mình|em)", "~tôi muốn (biết|hỏi)", "~^(nhưng|nhưng mà) ", "~^(how (do|can) i|why|where do i) "]
STILL = "(thành công|xong|hoàn thành) (nhưng|nhưng mà|mà)"


def _sql_terms(column: str, terms: list[str]) -> str:
    low = f"lower(coalesce({column}, ''))"
    return "(" + " OR ".join(f"regexp_matches({low}, '{t[1:]}')" if t.startswith("~") else f"contains({low}, '{t}')" for t in terms) + ")"


@query(f"""SELECT DISTINCT conv_id, turn_no, CASE {' '.join(f"WHEN {_sql_terms('user_query', t)} THEN '{k}'" for k, t in REFER)} END AS reference, CAST(nullif(regexp_extract(lower(coalesce(user_query, '')), '(?:bước|step) (\\d{{1,4}})', 1), '') AS INT) AS step,
  CASE {' '.join(f"WHEN {sql_any('user_query', t)} THEN '{k}'" for k, t in STATUS)} END AS status FROM chat_turn""")
def reference_detect(spark, folder):
    """What a turn refers back to, the step it names and the status it reports."""
    q = F.col("user_query")
    step = F.nullif(F.regexp_extract(F.lower(F.coalesce(q, F.lit(""))), r"(?:bước|step) (\d{1,4})", 1), F.lit("")).cast("int")
    return table(spark, folder, "chat_turn").select("conv_id", "turn_no", F.coalesce(*[F.when(X.terms_in(q, t, any_=True), F.lit(k)) for k, t in REFER]).alias("reference"), step.alias("step"), X.first_topic(q, STATUS).alias("status")).distinct()


_STEPS = "(SELECT faq_id, min(number) FILTER (hit = 'failed') AS failed, min(number) FILTER (hit = 'pending') AS pending, min(number) FILTER (hit = 'done') AS done FROM (SELECT faq_id, CAST(regexp_extract(line, '^\\s*(?:Bước |B|Step |\\(?)(\\d+)', 1) AS INT) AS number, unnest([" + ", ".join(f"CASE WHEN {_sql_terms('line', t)} THEN '{k}' END" for k, t in STATUS) + "]) AS hit FROM (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line FROM faq WHERE answer IS NOT NULL) WHERE regexp_matches(line, '^\\s*(Bước \\d{1,3}:|B\\d{1,3} -|Step \\d{1,3}:|\\(?\\d{1,3}[.)]) ')) GROUP BY faq_id)"
_status = "CASE " + " ".join("WHEN " + _sql_terms("user_query", t) + f" THEN '{k}'" for k, t in STATUS) + " END"
_named = "CAST(nullif(regexp_extract(lower(coalesce(user_query, '')), '(?:bước|step) (\\d{1,4})', 1), '') AS INT)"


@query(f"""WITH q AS (SELECT conv_id, turn_no, user_query, faq_id, topic, lag(topic) OVER (PARTITION BY conv_id ORDER BY turn_no) AS before FROM (SELECT * FROM chat_turn QUALIFY row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY ingested_at DESC) = 1)),
  t AS (SELECT *, {_status} AS status, {_named} AS named, coalesce(topic <> before AND NOT contains(topic, before) AND NOT contains(before, topic), false) OR regexp_matches(lower(coalesce(user_query, '')), '{STILL}') AS moved, {_sql_terms('user_query', AFRESH)} AS fresh,
    CASE {' '.join(f"WHEN {_sql_terms('user_query', t)} THEN '{k}'" for k, t in REFER)} END AS reference FROM q),
  s AS (SELECT t.*, NOT moved AND NOT fresh AND (reference IS NOT NULL OR status IS NOT NULL) AS goes_on, coalesce(named, CASE status WHEN 'failed' THEN coalesce(failed, 2) WHEN 'pending' THEN coalesce(pending, 2) WHEN 'done' THEN coalesce(done, 2) END, 1) AS step FROM t LEFT JOIN {_STEPS} p ON p.faq_id = t.faq_id)
  SELECT conv_id, turn_no, moved OR fresh AS reset, CASE WHEN goes_on THEN step END AS step, CASE WHEN goes_on THEN concat_ws(' ', before, 'trạng thái ' || status, 'Bước ' || step, user_query) ELSE user_query END AS enhanced FROM s""")
def query_enhance(spark, folder):
    """A turn that goes on is searched for with its topic, status and step; a new topic, a new question or trouble after success starts afresh."""
    from quern.operators import dialogue as D
    from quern.operators import procedures as P

    q = F.col("user_query")
    turns = D.latest(table(spark, folder, "chat_turn").drop("entities"), ["conv_id", "turn_no"], "ingested_at")
    turns = turns.withColumn("before", F.lag("topic").over(Window.partitionBy("conv_id").orderBy("turn_no")))
    lines = table(spark, folder, "faq").where("answer IS NOT NULL").select("faq_id", F.explode(F.split("answer", "\n")).alias("line")).where(F.col("line").rlike(P.STEP)).withColumn("number", F.regexp_extract("line", r"^\s*(?:Bước |B|Step |\(?)(\d+)", 1).cast("int"))
    steps = lines.groupBy("faq_id").agg(*[F.min(F.when(X.terms_in(F.col("line"), t, any_=True), F.col("number"))).alias(k) for k, t in STATUS])
    return D.enhanced(turns.join(steps, "faq_id", "left"), q, STATUS, REFER, AFRESH, STILL)

"""Conversation state and memory (ops C1-C15), activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import first_topic
from quern.operators import dialogue as D
from quern.plans.common import table
from quern.plans.retrieval import TOPICS, topic_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TURNS = "(SELECT * FROM chat_turn QUALIFY row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY ingested_at DESC) = 1)"
STEP_NO = "CAST(nullif(regexp_extract(lower(coalesce(user_query, '')), '(?:bước|step) (\\d{1,4})', 1), '') AS INT)"


def turns(spark, folder):
    return D.latest(table(spark, folder, "chat_turn").drop("entities"), ["conv_id", "turn_no"], "ingested_at")


def memories(spark, folder):
    return D.latest(table(spark, folder, "memory").drop("metadata"), ["memory_id"], "ingested_at")


@query(f"SELECT count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(CAST(user_query IS NULL AS INT)) AS silent FROM {TURNS}")
def latest_turns(spark, folder):
    """Ingest: one row a turn after redelivery."""
    t = turns(spark, folder)
    return t.agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.col("user_query").isNull().cast("int")).alias("silent"))


@query(f"SELECT conv_id, turn_no, user_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, conv_id DESC, turn_no DESC) AS place FROM {TURNS}) WHERE place <= 5")
def history_last_n(spark, folder):
    """The last five turns of each user."""
    order = [F.col("ts").desc(), F.col("conv_id").desc(), F.col("turn_no").desc()]
    return D.last_n(turns(spark, folder), "user_id", order, 5).select("conv_id", "turn_no", "user_id", "place")


@query(f"SELECT conv_id, turn_no, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS topic FROM {TURNS}")
def topic_carry_forward(spark, folder):
    """The topic holds until the next one."""
    return D.carried(turns(spark, folder), "conv_id", ["turn_no"], "topic", "held").select("conv_id", "turn_no", F.col("held").alias("topic"))


@query(f"""WITH s AS (SELECT conv_id, turn_no, coalesce(last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING), '') AS sticky FROM {TURNS}),
  c AS (SELECT *, CAST(coalesce(lag(sticky) OVER (PARTITION BY conv_id ORDER BY turn_no), '') <> sticky AS INT) AS changed FROM s)
  SELECT conv_id, turn_no, CAST(sum(changed) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM c""")
def topic_sessions(spark, folder):
    """A change of topic begins a session."""
    return D.topic_sessions(turns(spark, folder), "conv_id", ["turn_no"], "topic").select("conv_id", "turn_no", "session")


def _stepped(spark, folder):
    step = F.nullif(F.regexp_extract(F.lower(F.coalesce("user_query", F.lit(""))), r"(?:bước|step) (\d{1,4})", 1), F.lit("")).cast("int")
    return turns(spark, folder).select("conv_id", "turn_no", "topic", "faq_id", step.alias("step"))


@query(f"""WITH t AS (SELECT conv_id, turn_no, nullif(topic, '') AS topic, faq_id, {STEP_NO} AS step FROM {TURNS}), h AS (SELECT *, coalesce(last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING), '') AS sticky FROM t),
  c AS (SELECT *, CAST(coalesce(lag(sticky) OVER (PARTITION BY conv_id ORDER BY turn_no), '') <> sticky AS INT) AS changed FROM h), n AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS session FROM c),
  m AS (SELECT *, max(session) OVER (PARTITION BY conv_id) AS top FROM n)
  SELECT conv_id, nullif(max_by(sticky, turn_no), '') AS topic, last(faq_id ORDER BY turn_no) FILTER (faq_id IS NOT NULL) AS faq_id, CAST(coalesce(last(step ORDER BY turn_no) FILTER (step IS NOT NULL AND session = top), 0) AS INT) AS step, CAST(count(*) AS INT) AS turns FROM m GROUP BY conv_id""")
def context_fold(spark, folder):
    """The context after the last turn of each conversation, by the reducer that streams use."""
    return D.folded_context(_stepped(spark, folder), "conv_id")


@query(f"""SELECT conv_id, turn_no, coalesce({STEP_NO}, CASE WHEN lower(coalesce(user_query, '')) LIKE '%tiếp%' THEN 2 END, 1) AS step FROM {TURNS}""")
def continuation_step(spark, folder):
    """C4: the step that a turn goes on from: named, next, else the first."""
    rows = turns(spark, folder)
    named = F.nullif(F.regexp_extract(F.lower(F.coalesce("user_query", F.lit(""))), r"(?:bước|step) (\d{1,4})", 1), F.lit("")).cast("int")
    return rows.select("conv_id", "turn_no", F.coalesce(named, F.when(F.contains(F.lower(F.coalesce("user_query", F.lit(""))), F.lit("tiếp")), 2), F.lit(1)).alias("step"))


@query(f"""WITH s AS (SELECT conv_id, turn_no, CAST(ceil((length(coalesce(user_query, '')) + length(coalesce(bot_response, ''))) / 4) AS BIGINT) AS n FROM {TURNS}), t AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS used,
  sum(n) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) AS back FROM s) SELECT conv_id, turn_no, CAST(used AS BIGINT) AS used, total > 300 AND back > 4 AS summarised FROM t""")
def summary_trigger(spark, folder):
    """Tokens so far, and the turns that a summary would take in."""
    marked = D.summary_marks(turns(spark, folder), "conv_id", ["turn_no"], ["user_query", "bot_response"], 300, 4)
    return marked.select("conv_id", "turn_no", F.col("used").cast("long").alias("used"), "summarised")


@query(f"SELECT conv_id, string_agg('U: ' || coalesce(user_query, '') || chr(10) || 'B: ' || coalesce(bot_response, ''), chr(10) ORDER BY turn_no) AS history FROM {TURNS} GROUP BY conv_id")
def conversation_text(spark, folder):
    """The history of each conversation as text."""
    line = F.concat(F.lit("U: "), F.coalesce("user_query", F.lit("")), F.lit("\nB: "), F.coalesce("bot_response", F.lit("")))
    rows = turns(spark, folder).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


@query(f"""SELECT coalesce(user_id, '') AS user_id, count(*) AS turns, count(DISTINCT conv_id) AS conversations, count(DISTINCT faq_id) AS faqs, round(avg(length(user_query)), 4) AS mean_length, count(*) FILTER (bot_response IS NULL) AS unanswered FROM {TURNS} GROUP BY coalesce(user_id, '')""")
def chat_stats(spark, folder):
    """Counts by user."""
    rows = turns(spark, folder).withColumn("user_id", F.coalesce("user_id", F.lit("")))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.count_distinct("faq_id").alias("faqs"), F.round(F.avg(F.length("user_query")), 4).alias("mean_length"),
        F.sum(F.col("bot_response").isNull().cast("int")).alias("unanswered"),
    )


MEM = "(SELECT * FROM memory QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC) = 1)"


@query(f"SELECT memory_id, user_id, left(coalesce(memory, content), 500) AS kept, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id DESC) AS place FROM {MEM}) WHERE place <= 50")
def memory_last_n(spark, folder):
    """The last fifty items of each user, 500 characters each."""
    rows = D.last_n(memories(spark, folder), "user_id", [F.col("created_at").desc(), F.col("memory_id").desc()], 50)
    return rows.select("memory_id", "user_id", F.left(F.coalesce("memory", "content"), F.lit(500)).alias("kept"), "place")


@query(f"SELECT coalesce(user_id, '') AS user_id, count(*) AS items, count(*) FILTER (source = 'fallback') AS fallback, count(DISTINCT session_id) AS sessions, round(coalesce(max(score), 0), 6) AS best FROM {MEM} WHERE NOT (memory IS NULL AND (content IS NULL OR trim(content) = '')) GROUP BY coalesce(user_id, '')")
def memory_stats(spark, folder):
    """Statistics by user after items without any text are deleted."""
    gone = memories(spark, folder).where("memory IS NULL AND (content IS NULL OR trim(content) = '')").select("memory_id")
    rows = memories(spark, folder).join(gone, "memory_id", "left_anti").withColumn("user_id", F.coalesce("user_id", F.lit("")))
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.coalesce((F.col("source") == "fallback").cast("int"), F.lit(0))).alias("fallback"), F.count_distinct("session_id").alias("sessions"), F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("best")
    )


@query(f"SELECT memory_id, {topic_sql('coalesce(memory, content)')} AS topic FROM {MEM}")
def memory_topic(spark, folder):
    """The topic a memory suggests."""
    return memories(spark, folder).select("memory_id", first_topic(F.coalesce("memory", "content"), TOPICS).alias("topic"))


@query("SELECT user_id, date_diff('second', TIMESTAMP '1970-01-01', time_bucket(INTERVAL 1 day, ts)) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, folder):
    """Tumbling windows of a day (the stream form is in ``streaming``)."""
    w = table(spark, folder, "events").groupBy("user_id", F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("day"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 hour THEN 0 ELSE 1 END AS starts, event_id FROM events),
  s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL""")
def session_activity(spark, folder):
    """Sessions of activity with gaps of six hours, numbered by user."""
    from pyspark.sql import Window

    s = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("long").alias("session"), "n")

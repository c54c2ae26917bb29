"""Steps, processes and cases of procedural texts.

steps(parent_id, number, text). Null texts have no steps; a step number that
occurs twice in a text stays twice, in order of its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = r"^\s*(Bước \d{1,3}:|B\d{1,3} -|Step \d{1,3}:|\(?\d{1,3}[.)]) "


def steps_from(steps: DataFrame, first: int, only: bool) -> DataFrame:
    """Step ``first`` or all from it on, each with the number of all steps of its process."""
    counted = steps.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("parent_id")))
    return counted.where(F.col("number") == first if only else F.col("number") >= first)


def next_steps(steps: DataFrame, after: int, count: int) -> DataFrame:
    """The ``count`` steps after one."""
    w = Window.partitionBy("parent_id").orderBy("number", "text")
    return steps.where(F.col("number") > after).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")


def rendered(steps: DataFrame) -> DataFrame:
    """(parent_id, text): the steps as lines, in order, with their own numbers."""
    line = F.concat(F.lit("Step "), F.col("number"), F.lit(": "), F.col("text"))
    return steps.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def parsed_steps(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, number, text) of lines that begin with a step mark."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("place", "line")).where(F.col("line").rlike(STEP))
    number = F.regexp_extract("line", r"^\s*(?:Bước |B|Step |\(?)(\d+)", 1).cast("int")
    return lines.select(key, "place", number.alias("number"), F.regexp_replace("line", STEP, "").alias("text"))


#: In order: ways to mark steps; the first that a text uses is its own.
MARKS = [r"^\s*(?:Bước |Step |B)(\d{1,3}) ?[:.\-]", r"^\s*\*\*(\d{1,3})[.)]", r"^\s*\(?(\d{1,3})[.)] "]


def first_marked_steps(df: DataFrame, key: str, text: str, marks: list[str] = MARKS) -> DataFrame:
    """(key, mark, place, number, text) of the lines that begin with a step mark, of the first of ``marks`` that occurs in the text."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("place", "line"))
    mark = number = rest = F
    for n, pattern in enumerate(marks, 1):
        mark, number, rest = (w.when(F.col("line").rlike(pattern), v) for w, v in ((mark, F.lit(n)), (number, F.regexp_extract("line", pattern, 1).cast("int")), (rest, F.trim(F.regexp_replace("line", pattern, "")))))
    found = lines.select(key, "place", mark.alias("mark"), number.alias("number"), rest.alias("text")).where("mark IS NOT NULL")
    own = F.min("mark").over(Window.partitionBy(key))
    return found.withColumn("_own", own).where("mark = _own").select(key, "mark", "place", "number", "text")


def sections(df: DataFrame, key: str, text: str, start: str) -> DataFrame:
    """(key, section, title, body): lines from one that matches ``start`` to the next; blank lines and what precedes the first are dropped.

    The window of running counts is one text's lines.
    """
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("place", "line")).where(F.trim("line") != "")
    begins = F.col("line").rlike(start)
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("section", F.sum(begins.cast("int")).over(w)).where("section > 0")
    joined = numbered.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    return joined.select(key, F.col("section").cast("int").alias("section"), F.element_at("lines", 1).alias("title"), F.array_join(F.slice("lines", 2, 1 << 30), "\n").alias("body"))


def best_process(rows: DataFrame, required: dict[str, list[str]], optional: dict[str, list[str]]) -> DataFrame:
    """(topic, process_id, steps): of processes with all required terms, the one with most optional terms, then most steps, then the least id.

    ``rows`` has a step a row with (topic, process_id) and text columns.
    """
    need = [F.max(F.contains(F.lower(c), F.lit(t))).alias(f"need_{c}_{n}") for c, terms in required.items() for n, t in enumerate(terms)]
    points = F.lit(0)
    for c, terms in optional.items():
        for t in terms:
            points = points + F.contains(F.lower(c), F.lit(t)).cast("int")
    counted = rows.groupBy("topic", "process_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(points).alias("optional"), *need)
    for c, terms in required.items():
        for n, _ in enumerate(terms):
            counted = counted.where(F.col(f"need_{c}_{n}"))
    w = Window.partitionBy("topic").orderBy(F.desc("optional"), F.desc("steps"), "process_id")
    return counted.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("topic", "process_id", "steps")


def best_case(hits: DataFrame, cases: DataFrame, text: str) -> DataFrame:
    """The best case of each (query, doc): 20 a feature, 25 a status value, 3 a keyword in the query; where that is nothing, 10 for its name and 10 for its method; a point for the first case; ties to the first.

    ``hits`` (query_id, doc_id, text), ``cases`` (doc_id, case_id, name, method, features, statuses, keywords).
    """
    low = F.lower(F.col(text))
    count = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t))))
    there = lambda c: F.coalesce(F.contains(low, F.lower(F.col(c))), F.lit(False)).cast("int")
    first = F.min("case_id").over(Window.partitionBy("query_id", "doc_id"))
    found = 20 * count("features") + 25 * count("statuses") + 3 * count("keywords")
    scored = hits.join(cases, "doc_id").withColumn("found", found)
    fallback = F.when(F.col("found") == 0, 10 * there("name") + 10 * there("method")).otherwise(0)
    scored = scored.withColumn("score", F.col("found") + fallback + (F.col("case_id") == first).cast("int"))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "case_id")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "doc_id", "case_id", "score")


def cases_found(hits: DataFrame, cases: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(query_id, doc_id, case_id, score, confidence): the best case of a query's own document, 10 a status value in the query and 2 a word in common with its description; above ``least``, with a confidence of score / 20, 1 at most."""
    low = F.lower(F.col(text))
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")), lambda w: w != "")
    statuses = F.size(F.filter(F.coalesce("statuses", F.array().cast("array<string>")), lambda t: F.contains(low, F.lower(t))))
    scored = hits.join(cases, "doc_id").withColumn("score", 10 * statuses + 2 * F.size(F.array_intersect(words(F.col(text)), words(F.col("description")))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "case_id")
    best = scored.where(F.col("score") > least).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select("query_id", "doc_id", "case_id", "score", F.least(F.col("score") / 20, F.lit(1.0)).alias("confidence"))


def weighed_section(sections: DataFrame, key: str, words: list[tuple[str, int]], least: int = 3) -> DataFrame:
    """(key, section, score): the section whose text has most of the words, for texts of several sections; at least ``least`` points, ties to the first.

    ``sections`` (key, section, title, body, and arrays of words), ``words``: which array, and what each of its words counts.
    """
    text = F.lower(F.concat_ws(" ", "title", "body"))
    score = F.lit(0)
    for column, points in words:
        score = score + points * F.size(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda w: F.contains(text, w)))
    rows = sections.withColumn("score", score).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_all") > 1).where(F.col("score") >= least)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "section"))).where("_n = 1").select(key, "section", F.col("score").cast("long").alias("score"))

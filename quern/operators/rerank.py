"""Explainable re-ranking: every part of a score is a column, compiled from a pack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fuzzy
from quern.functions.text import first_topic, has_any, overlap


def _sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{t}')" for t in terms) + ")"


@dataclass(frozen=True)
class Pack:
    """Words that re-rank: critical words, topics, contradictions, error words and words by intent."""

    critical: list[tuple[str, list[str]]]
    topics: list[tuple[str, list[str]]]
    contradictions: list[tuple[str, str]]
    errors: list[str]
    intents: dict[str, list[str]]  # in order: the first that the question or the answer has counts, 0.5 or 0.25
    trouble: list[str] = ()  # 0.15 each for a troubleshooting question
    problems: list[str] = ()  # one of them in the document's question: 0.3 more, and no how-to
    procedure: str = ""  # a regular expression of numbered steps: 2.5 for a how-to
    signals: list[str] = ()  # 0.3 for a how-to

    def columns(self) -> dict[str, Column]:
        q, d, a = F.col("query"), F.col("question"), F.col("answer")
        missed = F.lit(False)
        for word, others in self.critical:
            missed = missed | (has_any(q, [word]) & ~has_any(d, others))
        asked, about = first_topic(q, self.topics), first_topic(d, self.topics)
        wrong = F.lit(0)
        for one, other in self.contradictions:
            wrong = wrong + (has_any(q, [one]) & has_any(d, [other])).cast("int")
        intent = F.lit(0.0)
        for name, terms in self.intents.items():
            case = None
            for t in terms:
                case = (F if case is None else case).when(has_any(d, [t]), 0.5).when(has_any(a, [t]), 0.25)
            intent = F.when(F.col("intent") == name, case.otherwise(0.0)).otherwise(intent)
        if self.trouble:
            held = F.lit(0)
            for t in self.trouble:
                held = held + (has_any(d, [t]) | has_any(a, [t])).cast("int")
            intent = F.when(F.col("intent") == "TROUBLESHOOT", 0.15 * held + F.when(has_any(d, list(self.problems)), 0.3).otherwise(0.0)).otherwise(intent)
        if self.procedure:
            steps = F.when(F.lower(F.coalesce(a, F.lit(""))).rlike(self.procedure), 2.5).otherwise(0.0)
            guided = steps + F.when(has_any(d, list(self.signals)) | has_any(a, list(self.signals)), 0.3).otherwise(0.0)
            intent = F.when(F.col("intent") == "HOW_TO", F.when(has_any(d, list(self.problems)), -1.5).otherwise(guided)).otherwise(intent)
        errors = F.lit(0)
        for term in self.errors:
            errors = errors + (has_any(q, [term]) & has_any(d, [term])).cast("int")
        return {
            "keyword": F.when(missed, -3.0).otherwise(0.0), "topic": F.when(asked == about, 0.5).when(asked.isNotNull() & has_any(a, [t for _, terms in self.topics for t in terms]), 0.3).otherwise(0.0),
            "contradiction": -0.8 * wrong, "intent_points": intent, "error": 0.25 * errors, "overlap": F.least(0.02 * overlap(q, d), F.lit(0.2)),
        }

    def sql(self, topic_sql: Callable[[str], str]) -> str:
        words = "regexp_extract_all(lower(coalesce(%s, '')), '[\\p{L}\\p{N}_]+')"
        missed = " OR ".join(f"{_sql_any('query', [w])} AND NOT {_sql_any('question', o)}" for w, o in self.critical)
        wrong = " + ".join(f"CAST({_sql_any('query', [x])} AND {_sql_any('question', [y])} AS INT)" for x, y in self.contradictions)
        errors = " + ".join(f"CAST({_sql_any('query', [t])} AND {_sql_any('question', [t])} AS INT)" for t in self.errors)
        chains = {n: " ".join(f"WHEN {_sql_any('question', [t])} THEN 0.5 WHEN {_sql_any('answer', [t])} THEN 0.25" for t in terms) for n, terms in self.intents.items()}
        intents = " ".join(f"WHEN '{n}' THEN CASE {c} ELSE 0 END" for n, c in chains.items())
        if self.trouble:
            held = " + ".join(f"CAST({_sql_any('question', [t])} OR {_sql_any('answer', [t])} AS INT)" for t in self.trouble)
            intents += f" WHEN 'TROUBLESHOOT' THEN 0.15 * ({held}) + CASE WHEN {_sql_any('question', list(self.problems))} THEN 0.3 ELSE 0 END"
        if self.procedure:
            guided = f"CASE WHEN regexp_matches(lower(coalesce(answer, '')), '{self.procedure}') THEN 2.5 ELSE 0 END + CASE WHEN {_sql_any('question', list(self.signals))} OR {_sql_any('answer', list(self.signals))} THEN 0.3 ELSE 0 END"
            intents += f" WHEN 'HOW_TO' THEN CASE WHEN {_sql_any('question', list(self.problems))} THEN -1.5 ELSE {guided} END"
        all_terms = [t for _, terms in self.topics for t in terms]
        return (
            f"CASE WHEN {missed} THEN -3.0 ELSE 0 END AS keyword, CASE WHEN {topic_sql('query')} = {topic_sql('question')} THEN 0.5 WHEN {topic_sql('query')} IS NOT NULL AND {_sql_any('answer', all_terms)} THEN 0.3 ELSE 0 END AS topic, "
            f"-0.8 * ({wrong}) AS contradiction, CASE intent {intents} ELSE 0 END AS intent_points, 0.25 * ({errors}) AS error, least(0.02 * len(list_intersect({words % 'query'}, {words % 'question'})), 0.2) AS overlap"
        )


def reranked(hits: DataFrame, pack: Pack) -> DataFrame:
    """Hits (query_id, doc_id, score, rank, query, intent, question, answer) with their parts, the sum and the new place; equal sums keep their order."""
    rows = hits.withColumn("base", F.col("score")).withColumns(pack.columns())
    total = F.col("base") + F.col("keyword") + F.col("topic") + F.col("contradiction") + F.col("intent_points") + F.col("error") + F.col("overlap")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank", "doc_id")
    return rows.withColumn("score", total).withColumn("place", F.row_number().over(w))


def guarded(rows: DataFrame, bank: Column, aliases: dict[str, list[str]], stop: list[str]) -> DataFrame:
    """Boosts by likeness of question and query, and ``status``, which tells where a document isn't about what was asked.

    x 2.5 above a ratio of 0.9, x 1.5 above 0.75, 1 at most, on the base; then
    +5, +2, +0.5 above 0.95, 0.9, 0.75 on the sum. ``no_specific_answer``: the
    query names a bank (``bank``, null without) that the document has under none
    of its ``aliases``; or the ratio is below 0.25 and less than 0.3 of the
    query's words (three letters and more, without ``stop``) are in the document.
    """
    ratio = fuzzy.similarity(F.lower("query"), F.lower(F.coalesce("question", F.lit(""))))
    text = F.lower(F.concat_ws(" ", "question", "answer"))
    rows = rows.withColumn("ratio", ratio).withColumn("bank", F.lower(bank))
    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*[F.lit(x) for x in stop]), w))
    coverage = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.contains(text, w))), F.size(words)), F.lit(1.0))
    named = F.contains(text, F.col("bank"))
    for name, others in aliases.items():
        named = named | ((F.col("bank") == name) & has_any(text, others))
    r = F.col("ratio")
    early = F.least(F.col("base") * F.when(r > 0.9, 2.5).when(r > 0.75, 1.5).otherwise(1.0), F.lit(1.0))
    late = F.when(r > 0.95, 5.0).when(r > 0.9, 2.0).when(r > 0.75, 0.5).otherwise(0.0)
    status = F.when(F.col("bank").isNotNull() & ~named, "no_specific_answer").when((r < 0.25) & (coverage < 0.3), "no_specific_answer").otherwise("success")
    return rows.withColumn("boosted", F.col("score") - F.col("base") + early + late).withColumn("coverage", coverage).withColumn("status", status)


def extraction(intent: Column, answer: Column, ratio: Column, focused: Column, confidence: Column) -> dict[str, Column]:
    """``wanted``: whether an answer is cut down, and ``used``: whether the cut one is taken.

    Never for a question that is nearly the asked one (0.9); always for fee,
    limit and time; for troubleshooting, how-to and comparison above 300
    characters. Taken with a confidence of 0.6 where it has less than 0.8 of the
    length, or for troubleshooting and how-to at any length.
    """
    wanted = (ratio < 0.9) & (intent.isin("FEE", "LIMIT", "TIME") | (intent.isin("TROUBLESHOOT", "HOW_TO", "COMPARISON") & (F.length(answer) > 300)))
    wanted = F.coalesce(wanted, F.lit(False))
    shorter = (F.length(focused) < 0.8 * F.length(answer)) | intent.isin("TROUBLESHOOT", "HOW_TO")
    return {"wanted": wanted, "used": F.coalesce(wanted & focused.isNotNull() & (confidence >= 0.6) & shorter, F.lit(False))}

"""Rule packs: data that is compiled into column expressions, and into SQL for comparison.

A pack is read in one projection whatever its size; texts are never joined with
rules. A term is looked for as it is in the lower-case text; one that begins with
``~`` is a regular expression, of the part that Java's and RE2's have in common.
Null texts match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import terms_in


def _quoted(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def has_any(text: Column, terms: list[str]) -> Column:
    return terms_in(text, terms, any_=True)


def hits(text: Column, terms: list[str]) -> Column:
    return terms_in(text, terms, any_=False)


def _sql_hits(terms: list[str]) -> str:
    low = "lower(coalesce(text, ''))"
    return "(" + " + ".join(f"CAST(regexp_matches({low}, {_quoted(t[1:])}) AS INT)" if t.startswith("~") else f"CAST(contains({low}, {_quoted(t)}) AS INT)" for t in terms) + ")"


@dataclass(frozen=True)
class Intent:
    name: str
    priority: int
    weight: float
    patterns: list[str]
    keywords: list[str]


@dataclass(frozen=True)
class IntentPack:
    """Intents with a point a pattern and half a point a keyword, times the weight, plus a tenth a rank of priority where any matched."""

    intents: list[Intent]
    fallback: str
    fallback_confidence: float
    override: tuple[str, str, list[str]] | None = None
    floors: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [i.name for i in self.intents]
        if len(set(names)) != len(names):
            raise ValueError("an intent occurs twice")

    def columns(self, text: Column) -> dict[str, Column]:
        """``intent`` and ``confidence`` of a text; of equal scores the first intent of the pack wins."""
        scores = []
        for i in self.intents:
            raw = (hits(text, i.patterns) + 0.5 * hits(text, i.keywords)) * i.weight
            scores.append(F.when(raw > 0, raw + (11 - i.priority) * 0.1).otherwise(0.0))
        named = [F.lit(i.name) for i in self.intents]
        if self.override:
            at = [i.name for i in self.intents].index(self.override[0])
            named[at] = F.when(has_any(text, self.override[2]), self.override[1]).otherwise(self.override[0])
        most = [(len(i.patterns) + 0.5 * len(i.keywords)) * i.weight + (11 - i.priority) * 0.1 for i in self.intents]
        floor = [self.floors.get(i.name, 0.0) for i in self.intents]

        def chosen(s: Column) -> Column:
            """The first of the greatest; scores are a lambda's variable, so each is computed once."""
            best = F.array_max(s)
            at = F.array_position(s, best).cast("int")
            of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
            share = F.greatest(F.least(best / of(most), F.lit(1.0)), of(floor))
            return F.struct(
                F.when(best <= 0, F.lit(self.fallback)).otherwise(F.element_at(F.array(*named), at)).alias("intent"), F.when(best <= 0, F.lit(self.fallback_confidence)).otherwise(share).alias("confidence")
            )

        one = F.transform(F.array(F.array(*scores)), chosen)[0]
        return {"intent": one["intent"], "confidence": one["confidence"]}

    def sql(self, source: str) -> str:
        """The same over a subquery with (id, text)."""
        scored = []
        for n, i in enumerate(self.intents):
            raw = f"({_sql_hits(i.patterns)} + 0.5 * {_sql_hits(i.keywords)}) * {i.weight}"
            scored.append(f"CASE WHEN {raw} > 0 THEN {raw} + {11 - i.priority} * 0.1 ELSE 0 END AS s{n}")
        best = "greatest(" + ", ".join(f"s{n}" for n in range(len(self.intents))) + ")"
        names, shares = [], []
        for n, i in enumerate(self.intents):
            most = (len(i.patterns) + 0.5 * len(i.keywords)) * i.weight + (11 - i.priority) * 0.1
            named = f"'{i.name}'"
            if self.override and self.override[0] == i.name:
                named = f"CASE WHEN {_sql_hits(self.override[2])} > 0 THEN '{self.override[1]}' ELSE '{i.name}' END"
            names.append(f"WHEN s{n} = best THEN {named}")
            shares.append(f"WHEN s{n} = best THEN greatest(least(best / {most}, 1), {self.floors.get(i.name, 0.0)})")
        return (
            f"SELECT id, CASE WHEN best <= 0 THEN '{self.fallback}' {' '.join(names)} END AS intent, CASE WHEN best <= 0 THEN {self.fallback_confidence} {' '.join(shares)} END AS confidence "
            f"FROM (SELECT *, {best} AS best FROM (SELECT id, text, {', '.join(scored)} FROM ({source})))"
        )


@dataclass(frozen=True)
class EntityPack:
    """Entity types with (value, terms); a value is found once however many of its terms match."""

    types: dict[str, list[tuple[str, list[str]]]]

    def column(self, text: Column) -> Column:
        """An array of (etype, value), in the order of the pack; empty without a match."""
        cases = [
            F.when(has_any(text, terms), F.struct(F.lit(etype).alias("etype"), F.lit(value).alias("value"))) for etype, values in self.types.items() for value, terms in values
        ]
        return F.array_compact(F.array(*cases))

    def sql(self, source: str) -> str:
        parts = [f"SELECT id, '{etype}' AS etype, '{value}' AS value FROM ({source}) WHERE {_sql_hits(terms)} > 0" for etype, values in self.types.items() for value, terms in values]
        return " UNION ALL ".join(parts)


def corrected(found: Column, rules: list[tuple[str, str, str, str, str | None]]) -> Column:
    """Entities (etype, value) of a text with some put right: (type, value, other type, other value, new value) puts the new value where the text has the other, and leaves the entity out for None."""

    def has(etype: str, value: str) -> Column:
        return F.exists(found, lambda y: (y["etype"] == etype) & (y["value"] == value))

    def put(x: Column) -> Column:
        value = x["value"]
        case = None
        for t, v, u, w, new in rules:
            there = (x["etype"] == t) & (value == v) & has(u, w)
            case = F.when(there, F.lit(new)) if case is None else case.when(there, F.lit(new))
        return F.struct(x["etype"].alias("etype"), (value if case is None else case.otherwise(value)).alias("value"))

    return F.filter(F.transform(found, put), lambda x: x["value"].isNotNull())


def merged_entities(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entities (query_id, etype, value) of both; of ``second`` those that no value of the type in ``first`` contains."""
    held = first.select("query_id", "etype", F.col("value").alias("longer")).distinct()
    kept = second.join(held, (second["query_id"] == held["query_id"]) & (second["etype"] == held["etype"]) & F.contains(held["longer"], second["value"]), "left_anti")
    return kept.withColumn("source", F.lit("pattern")).unionByName(first.withColumn("source", F.lit("given")))

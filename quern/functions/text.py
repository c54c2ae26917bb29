"""Text as column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-case words in order, repeats kept; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def composed(text: Column) -> Column:
    """Unicode's composed form. Only texts with combining marks reach Python; others have no letter to compose."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(nfc(F.when(text.rlike(r"\p{M}"), text)), text)


def content_words(text: Column, stop: list[str], shortest: int = 1) -> Column:
    """Words without stop words and words shorter than ``shortest``."""
    stops = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(words(text), lambda w: ~F.array_contains(stops, w) & (F.length(w) >= shortest))


def overlap(a: Column, b: Column) -> Column:
    """Distinct words in both texts."""
    return F.size(F.array_intersect(words(a), words(b)))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether the lower-case text contains one of the terms; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for term in terms:
        out = out | low.contains(term)
    return out


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-case text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for term in terms:
        out = out + low.contains(term).cast("int")
    return out


def terms_in(text: Column, terms: list[str], any_: bool) -> Column:
    """Whether one of the terms is in the lower-case text, or how many are; a term that begins with ~ is a regular expression."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [low.rlike(t[1:]) if t.startswith("~") else low.contains(t) for t in terms]
    if any_:
        out = F.lit(False)
        for f in found:
            out = out | f
        return out
    out = F.lit(0)
    for f in found:
        out = out + f.cast("int")
    return out


def whole_word(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text between characters that aren't letters or digits."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(terms) + r")($|[^\p{L}\p{N}_])")


def first_topic(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first topic of an ordered table with a term in the text; null without."""
    return F.coalesce(*[F.when(has_any(text, terms), F.lit(topic)) for topic, terms in table])


def without_fences(text: Column) -> Column:
    """A JSON payload without a Markdown fence around it."""
    return F.trim(F.regexp_replace(text, r"(?i)^\s*```(json)?|```\s*$", ""))


def object_span(text: Column) -> Column:
    """From the first to the last brace; null without an object."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


# The letters of Vietnamese with accents, and without.
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
BARE = "aaaaaaaaaaaaaaaaadeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"


def restoration(df: DataFrame, text: str) -> DataFrame:
    """(bare, word): for each word without accents the most frequent word of the corpus that it may stand for, of equals the greater."""
    words = df.select(F.explode(words_of(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy(F.translate("word", ACCENTED, BARE).alias("bare")).agg(F.max_by("word", F.struct("n", "word")).alias("word"))


def words_of(column: str) -> Column:
    return words(F.col(column))


def restored(text: Column, table: dict[str, str], marked: str) -> Column:
    """Words typed without accents put back by a table, only where the text has no marked letter.

    Lower case, one space between words, one closing mark of a word is kept out
    of the lookup. Keys must be unique (a dict is). Null stays null.
    """
    if not table:
        return text
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.split(F.trim(F.lower(text)), r"\s+")

    def put(word: Column) -> Column:
        bare = F.regexp_replace(word, r"[?.!,;:]$", "")
        return F.concat(F.coalesce(lookup[bare], bare), F.substr(word, F.length(bare) + 1))

    return F.when(F.lower(text).rlike(marked), text).otherwise(F.array_join(F.transform(parts, put), " "))


def confidence_label(score: Column) -> Column:
    """high, medium or low; null and NaN are low."""
    known = F.when(score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(score)
    return F.when(known >= 0.7, "high").when(known >= 0.4, "medium").otherwise("low")


def reflowed(answer: Column) -> Column:
    """Step lines with several clauses, one clause a line.

    A numbered line with at least two commas, or one comma and more than 80
    characters, is split at ``, ``; later clauses begin with a capital.
    """
    lines = F.split(F.coalesce(answer, F.lit("")), "\n")

    def flow(line: Column) -> Column:
        commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
        step = line.rlike(r"^\s*(Bước \d+|B\d+|Step \d+|\(?\d+[.)])")
        parts = F.split(line, ", ")
        raised = F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))))
        return F.when(step & ((commas >= 2) | ((commas >= 1) & (F.length(line) > 80))), raised).otherwise(F.array(line))

    return F.array_join(F.flatten(F.transform(lines, flow)), "\n")


def running_mean(rows: DataFrame, by: str, at: str, key: str, value: str, unit: str = "day") -> DataFrame:
    """``rows`` with the mean of ``value`` so far by ``by``, in order of ``at`` and ``key``; null times come first.

    Sums by unit of time are added up first, and rows within their unit, so a
    group of any size is never one task's window. Sums are of nine decimals, so
    their order doesn't matter.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("_unit", F.date_trunc(unit, at)).withColumn("_value", F.col(value).cast("decimal(28,9)"))
    value = "_value"
    units = rows.groupBy(by, "_unit").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(F.col(by).alias("_by"), F.col("_unit").alias("_u"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = Window.partitionBy(by, "_unit").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_own", F.sum(value).over(within)).withColumn("_place", F.count(F.lit(1)).over(within))
    joined = joined.join(units, F.col(by).eqNullSafe(F.col("_by")) & F.col("_unit").eqNullSafe(F.col("_u")))
    return joined.withColumn("mean", (F.col("_own") + F.col("_sum")).cast("double") / (F.col("_place") + F.col("_n"))).drop("_value", "_unit", "_by", "_u", "_own", "_place", "_sum", "_n")

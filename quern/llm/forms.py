"""One consistent form for texts that look the same (queries p5_).

A letter's script set is the script it is written in and, where it has a double
there, Latin. A token is resolved by the intersection of its letters' sets and
the scripts it is written in:

* written in one script: the spelling is consistent and stays. Where Latin is in
  the intersection too, the token is a ``whole`` confusable, which is reported;
* written in several, Latin among them, and Latin in the intersection: Latin is
  selected and every letter spelled in it (``mixed``);
* written in several, Latin among them, but the intersection is empty: the
  letters whose set holds Latin are spelled in it, the others have no double and
  stay (``partial``);
* written in several without Latin: the spelling stays (``foreign``).

All other differences of form (width, ligatures, combining accents, spaces,
characters that show nothing) are removed by normalisation.

Defined results: null stays null, an empty or blank text keeps its line breaks,
tabs and ordinary spaces, very long texts are handled whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Cyrillic and Greek and the Latin letter each looks like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ь": "b", "Һ": "h", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "г": "r",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϳ": "j", "ϲ": "c",
}
DOUBLES = {"CYRILLIC": CYRILLIC, "GREEK": GREEK}
LATIN_OF = {ord(a): b for double in DOUBLES.values() for a, b in double.items()}

# Characters that show nothing (zero-width, joiners, marks of direction, byte-order marks, soft hyphens).
INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿"
_invisible = re.compile(f"[{INVISIBLE}]+")
_foreign = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_token = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
_spaces = re.compile("[   -   　]")
_odd = re.compile("|".join(x.pattern for x in (_invisible, _foreign, _spaces)).replace("]+|[", "").replace("]|[", ""))


@functools.lru_cache(4096)
def scripts(letter: str) -> frozenset[str] | None:
    """The scripts a letter can belong to, its double's included; None for a character of every script."""
    if not letter.isalpha():
        return None
    own = unicodedata.name(letter, "").split(" ")[0]
    return frozenset([own, "LATIN"] if letter in DOUBLES.get(own, ()) else [own])


def script_of(token: str) -> tuple[frozenset[str], frozenset[str]]:
    """The scripts that the letters are written in, and those that all of them could be read in."""
    written = {unicodedata.name(x, "").split(" ")[0] for x in token if x.isalpha()}
    sets = [s for x in token if (s := scripts(x)) is not None]
    return frozenset(written), frozenset.intersection(*sets) if sets else frozenset()


@functools.lru_cache(1 << 16)
def resolved(token: str) -> tuple[str, str | None]:
    """The consistent spelling of a token and what its script sets tell: None, or one of the kinds above."""
    if not _foreign.search(token):
        return token, None
    parts = unicodedata.normalize("NFD", token)
    written, shared = script_of(parts)
    if len(written) < 2:
        return token, "whole" if "LATIN" in shared and "LATIN" not in written else None
    if "LATIN" not in written:
        return token, "foreign"
    spelled = "".join(LATIN_OF.get(ord(c), c) if "LATIN" in (scripts(c) or ()) else c for c in parts)
    return unicodedata.normalize("NFC", spelled), "mixed" if "LATIN" in shared else "partial"


def whole_script_confusable(token: str) -> bool:
    """Whether a token wholly in one other script could be read as Latin."""
    return resolved(token)[1] == "whole"


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; the same text where it already has it."""
    if text is None or text.isascii():
        return text
    odd = _odd.search(text)
    if not odd and unicodedata.is_normalized("NFKC", text):
        return text
    text = unicodedata.normalize("NFKC", _invisible.sub("", text))
    text = _spaces.sub(" ", text)
    if _foreign.search(text):
        text = unicodedata.normalize("NFKC", _token.sub(lambda m: resolved(m[0])[0], text))
    return text


def lookalikes(text: str | None) -> list[str]:
    """What the tokens of a text in normal form are (kinds of ``resolved``), once each, in order of the alphabet."""
    if text is None or text.isascii() or not _foreign.search(text):
        return []
    text = _spaces.sub(" ", unicodedata.normalize("NFKC", _invisible.sub("", text)))
    return sorted({kind for t in _token.findall(text) if (kind := resolved(t)[1])})


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            columns = list(part.columns)
            out = list(columns)
            for k, column in enumerate(columns[1:], 1):
                texts = column.to_pylist()
                forms = [consistent(x) for x in texts]
                kinds = [lookalikes(x) for x in texts]
                out += [pa.array(forms, pa.string()), pa.array([a != b for a, b in zip(texts, forms)], pa.bool_()), pa.array(kinds, pa.list_(pa.string()))]
                out[k] = None
            yield pa.RecordBatch.from_arrays([x for x in out if x is not None], names=[f"c{i}" for i in range(1 + 3 * (len(columns) - 1))])


def consistent_forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and, for each field, its consistent form, ``<field>_changed`` and ``<field>_lookalikes`` (kinds of words of look-alike letters).

    One narrow pass without a shuffle; repeated rows stay repeated.
    """
    schema = T.StructType([T.StructField("c0", df.schema[key].dataType)])
    for k, _ in enumerate(fields):
        schema.add(f"c{1 + 3 * k}", T.StringType()).add(f"c{2 + 3 * k}", T.BooleanType()).add(f"c{3 + 3 * k}", T.ArrayType(T.StringType()))
    done = df.select(key, *fields).mapInArrow(_forms, schema)
    names = [key] + [x for f in fields for x in (f, f"{f}_changed", f"{f}_lookalikes")]
    return done.toDF(*names)


def changed_fields(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Distinct (``name``, field) of texts that differ from their consistent form."""
    done = consistent_forms(df, key, fields)
    which: Column = F.filter(F.array(*[F.when(F.col(f"{f}_changed"), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return done.select(F.col(key).alias(name), F.explode(which).alias("field")).distinct()

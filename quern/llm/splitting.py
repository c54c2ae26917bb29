"""Cutting long texts at natural boundaries (queries p2_).

Each position of a text has one legal successor: the farthest cut within the
limit that lies between paragraphs, else between lines or steps, else between
sentences, else between words, and from there back by the overlap to the next
natural boundary. The table of successors is joined with itself: squaring it
gives the places reached by 2, 4, 8 ... cuts, and the set of places reached from
the start doubles with each square, so all cuts of a text are derived in a
logarithmic number of array operations and not one after the other.

Defined results: null gives no piece, an empty text one empty piece, a text
within the limit one piece; a run without any boundary is cut at the limit;
very long texts are worked through in bounded sections with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text whose tables are held at a time.
SECTION_CHARS = 1_000_000

_paragraph = re.compile(r"\n[^\S\n]*\n\s*")
_line = re.compile(r"\n[^\S\n]*")
_sentence = re.compile(r"(?<![\d.!?…。！？])[.!?…。！？]+[\"'”’»)\]]*\s+")
_word = re.compile(r"\s+")


def _ends(pattern: re.Pattern, text: str, n: int) -> np.ndarray:
    """For each position, the last place at or before it where a match ends (0: none)."""
    flags = np.zeros(n + 1, np.int32)
    at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int32)
    flags[at] = at
    return np.maximum.accumulate(flags)


def successors(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position as a start, the end of its piece and the start of the next piece (the text's length: none)."""
    n = len(text)
    start = np.arange(n + 1, dtype=np.int32)
    reach = np.minimum(start + limit, n)
    end = np.full(n + 1, -1, np.int32)
    half = start + max(limit // 2, overlap)
    for pattern in (_paragraph, _line, _sentence):
        last = _ends(pattern, text, n)[reach]
        end = np.where((end < 0) & (last > half), last, end)
    words = _ends(_word, text, n)
    end = np.where((end < 0) & (words[reach] > start + overlap), words[reach], end)
    end = np.where(end < 0, reach, end)
    end[reach == n] = n
    natural = np.full(n + 2, n + 1, np.int32)
    own = np.unique(words)
    natural[own] = own
    natural = np.minimum.accumulate(natural[::-1])[::-1]
    back = np.maximum(end - overlap, 0)
    following = np.where(natural[back] < end, natural[back], back)
    following[end == n] = n
    return end, np.maximum(following, np.minimum(start + 1, n)).astype(np.int32)


def reached(following: np.ndarray) -> np.ndarray:
    """Places reached from 0, by squaring the successor table."""
    n = len(following) - 1
    mark = np.zeros(n + 1, bool)
    mark[0] = True
    jump = following
    while True:
        mark[jump[mark]] = True
        if mark[n] and (jump[mark] == n).all():
            return np.flatnonzero(mark[:n])
        jump = jump[jump]


def cuts(text: str, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    if limit <= overlap:
        raise ValueError("the overlap must be smaller than the limit")
    out, base = [], 0
    while True:
        section = text[base : base + max(SECTION_CHARS, 4 * limit)]
        n = len(section)
        if n <= limit:
            return [*out, (base, base + n)]
        end, following = successors(section, limit, overlap)
        starts = reached(following)
        whole = base + n == len(text)
        if whole:
            return out + [(base + int(s), base + int(end[s])) for s in starts]
        sure = starts[starts + limit < n]  # the rest of the text can't change these
        out += [(base + int(s), base + int(end[s])) for s in sure]
        base += int(following[sure[-1]])


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, numbers, starts, ends, pieces = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    if text is None:
                        continue
                    for number, (a, b) in enumerate(cuts(text, limit, overlap)):
                        rows.append(row)
                        numbers.append(number)
                        starts.append(a)
                        ends.append(b)
                        pieces.append(text[a:b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.string())],
                    names=["key", "piece_no", "start_char", "end_char", "piece"],
                )

    return run


def pieces(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """(``key``, piece_no, start_char, end_char, piece): a narrow pass without a shuffle."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType)])
    schema.add("piece_no", T.IntegerType()).add("start_char", T.IntegerType()).add("end_char", T.IntegerType()).add("piece", T.StringType())
    done = df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(_pieces(limit, overlap), schema)
    return done.withColumnRenamed("key", key)

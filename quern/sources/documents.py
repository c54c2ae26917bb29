"""Documents from JSON files, workbook sheets and rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSON = "page_content string, metadata map<string,string>"
QUESTION, ANSWER = r"^(câu hỏi|question|hỏi)$", r"^(trả lời|câu trả lời|answer|đáp)$"
DEFAULT_SECTION = "Tổng quan"


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """(page_content, metadata) of JSON arrays of such objects; items without content and malformed files give no row."""
    rows = spark.read.schema(JSON).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.length(F.trim("page_content")) > 0)


def built(df: DataFrame, key: str, first_row: int = 2) -> DataFrame:
    """One document a row with both a question and an answer (blank texts and "nan" are none), with source and row of the sheet."""
    full = lambda c: F.col(c).rlike(r"[\p{L}\p{N}]") & (F.lower(F.trim(c)) != "nan")
    content = F.concat(F.lit("Question: "), F.trim("question"), F.lit("\n\nAnswer: "), F.trim("answer"), F.lit("\nKeywords: "), F.trim("question"))
    return df.where(full("question") & full("answer")).select(key, content.alias("page_content"), F.element_at(F.split("source", "/"), -1).alias("source"), (F.col("row_id") + first_row).alias("row_id"))


def header_rows(cells: DataFrame, scanned: int = 5) -> DataFrame:
    """(sheet, header_row) of the first rows that name a question column and have two cells or more."""
    asks = F.exists("cells", lambda c: F.coalesce(F.lower(c).rlike(QUESTION), F.lit(False)))
    return cells.where((F.col("row_no") <= scanned) & asks & (F.size(F.array_compact("cells")) >= 2)).groupBy("sheet").agg(F.min("row_no").alias("header_row"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook in the Open XML format, read with the standard library."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            path = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            for n, row in enumerate(tree.iter(f"{{{_NS['m']}}}row"), 1):
                cells: list[str | None] = []
                for i, cell in enumerate(row.findall("m:c", _NS)):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    cells += [None] * (at + 1 - len(cells))
                    value = cell.find("m:v", _NS)
                    if cell.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None:
                        cells[at] = value.text
                yield sheet.get("name"), int(row.get("r") or n), [c if c is None or c.strip() else None for c in cells]


def from_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(source, sheet_name, row_id, section, question, answer) of all workbooks under a folder.

    A row with a question, a numeral before it and no answer begins a section. A
    file that can't be read gives one row with its error and no texts. One file
    is one task's work; sheets are small.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "sheet_name", "row_id", "section", "question", "answer", "error"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                source = path.rpartition("/")[2]
                try:
                    rows = list(_sheet_rows(source, content))
                except Exception as e:  # isolated: other files go on
                    rows = [(source, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=columns).astype({"row_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!~]*.xlsx").load(folder)
    return files.select("path", "content").mapInPandas(read, "source string, sheet_name string, row_id long, section string, question string, answer string, error string")


def _sheet_rows(source: str, content: bytes) -> Iterator[tuple]:
    sheets: dict[str, list[tuple[int, list[str | None]]]] = {}
    for sheet, n, cells in sheet_cells(content):
        sheets.setdefault(sheet, []).append((n, cells))
    for sheet, rows in sheets.items():
        head = next(((n, cells) for n, cells in rows[:5] if sum(c is not None for c in cells) >= 2 and any(re.match(QUESTION, (c or "").strip().lower()) for c in cells)), None)
        if head is None:
            continue
        at = [next((i for i, c in enumerate(head[1]) if re.match(p, (c or "").strip().lower())), None) for p in (QUESTION, ANSWER)]
        if at[1] is None:
            at[1] = at[0] + 1
        section = DEFAULT_SECTION
        for n, cells in rows:
            if n <= head[0]:
                continue
            q, a = (cells[i].strip() if i < len(cells) and cells[i] is not None else None for i in at)
            if q and not a and re.match(r"(?:[IVX]+|\d+)\.", q):
                section = q
            elif q and a:
                yield source, sheet, n, section, q, a, None

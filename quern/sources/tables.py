"""Tables of a folder as views, parameterised SQL over them, JSON arrays, empty tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args: Any) -> DataFrame:
    """SQL with named parameters (``:name``) over frames (``{name}``); values are bound, never spliced into the text."""
    return spark.sql(text, args=args, **tables)


def cleared(df: DataFrame) -> DataFrame:
    """The table without its rows."""
    return df.limit(0)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array of objects a file, written in pieces by the tasks; a task without rows writes an empty array."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for frame in frames:
            for x in frame["value"]:
                yield pd.DataFrame({"value": [("[" if first else ",") + x]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(join, "value string").write.text(path)

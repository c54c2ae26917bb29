"""Queries of the subpackage against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quern.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark):
    con = duckdb.connect()
    for file in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = queries.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    tidy = lambda x: round(x, 6) if isinstance(x, float) else x
    want = sorted((tuple(tidy(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(tidy(row[c]) for c in columns) for row in df.collect()), key=repr) == want


def test_containers_are_sound_and_nearly_full(spark):
    row = queries.p7_room(spark, str(FOLDER)).first()
    assert row["faulty"] == 0 and row["containers"] >= row["least"] and (row["excess"] < 0.05 or row["containers"] - row["least"] <= 2)

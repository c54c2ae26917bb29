"""Physical plans: no comparison of every row with every row, no row-at-a-time Python, narrow scans."""

import re
from pathlib import Path

import pytest

from quern import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
QUERIES = catalog.queries()
#: A fixture of forty fixed rows is compared by containment with all questions.
FIXED = {"followup_branch"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FIXED))
def test_joins_are_by_key_and_python_by_batch(name, spark):
    text = plan(QUERIES[name](spark, str(FOLDER)))
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython", text)


def test_scans_read_what_is_used(spark):
    text = plan(QUERIES["value_extract"](spark, str(FOLDER)))
    assert re.search(r"ReadSchema: struct<faq_id:bigint,answer:string>", text)
    text = plan(QUERIES["sql_parameters"](spark, str(FOLDER)))
    assert "EqualTo(intent,HOW_TO)" in text and "GreaterThanOrEqual(row_id,10)" in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["history_last_n"](spark, str(FOLDER)))

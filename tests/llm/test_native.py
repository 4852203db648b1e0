"""The operators that must stay in DataFrame functions do."""

import re

import pytest

from tessera.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_line_dedup", "op5_pii", "op6_fingerprints", "op7_mixing"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|CartesianProduct", plan)

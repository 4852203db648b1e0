"""Plans of the library's queries: what reaches the scan, and what stays out of Python."""

import re

import pytest

from tessera import registry
from tests.conftest import DATA

registry.load()
#: Queries whose semantics no built-in has: parsers, a similarity ratio, hooks.
PYTHON = {"jon11_fuzzy_title", "tgf01_search_units", "tgf12_python_symbols", "src08_bibtex", "udf02_summaries", "cmp11_repository_map", "src26_entry_texts", "src27_first_entry", "jon25_imports", "tgf24_python_constructs", "tgf13_symbols", "str05_fuzzy_score", "tgf23_cpp_constructs", "tgf17_pages", "tgf21_skeletons", "grf03_cpp_scopes", "udf01_tool", "udf03_per_row", "src06_sqlite", "win07_one_group"}


def plan(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - PYTHON - {"grf01_closure"}))
def test_stays_in_the_jvm(spark, name):
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "fil06_year_range")
    assert "GreaterThanOrEqual(o_orderdate" in p and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", p)
    assert re.search(r"ReadSchema: struct<source:string,lang:string>|ReadSchema: struct<lang:string,source:string>", plan(spark, "agg08_tech_matrix"))


def test_a_search_shuffles_only_its_own_terms(spark):
    p = plan(spark, "fts02_bm25").split("== Physical Plan ==")[1]
    assert "documents.parquet" not in p and not re.search("Generate|text#", p)  # the stored index, not the texts
    assert re.search(r"PartitionFilters: \[.*part#\d+ = ", p) and re.search(r"PushedFilters: \[.*EqualTo\(term,apache\)", p)
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["fil13_facets_all", "jon07_semi", "agg03_tag_distribution", "dml09_supersede", "win01_last_wins"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))

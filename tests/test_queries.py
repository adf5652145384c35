"""Registered queries against their SQL, at the smallest scale (all of them: python -m checks.compare <folder>)."""

import os

import pytest

from checks import compare
from checks.oracle import SQL
from concord.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "catalog_columns", "catalog_stats", "nested_schema", "key_usage", "clean_table_names", "normalize_names", "canonical_names",
    "canonical_tokens", "fk_fold", "fk_text", "fk_system_tables", "attach_keys", "key_ids", "type_compat", "fuzzy_pairs", "name_hits",
    "pattern_boost", "hash_embed", "gram_cosine", "dense_cosine_topk", "vector_link", "table_map", "exact_column_match", "column_pairs",
    "best_table", "blocked_lookup", "fk_match", "pk_fk_check", "count_report", "business_delta", "view_match", "key_check",
    "orphan_check", "record_link", "store_replace", "incremental_intake",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert compare.compare(QUERIES[name](spark, SF), duck, SQL[name]) == ""


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"schema_columns", "table_ratio", "refined_columns"}

"""The driver contract: every query has a stable schema and, on the smallest tables, its oracle's rows.

A few queries run by default. ``CHECK_ALL=1`` runs all of them;
``tools/check_oracles.py`` does the same at a larger scale.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from codestrata.plans.registry import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "q_norm_functions", "q_file_full_outer", "q_asof_method_class", "q_cross_functions", "q_prefix_longest", "q_layer_edges", "q_stability", "q_slp",
    "q_event_dedup", "q_edge_cascade", "q_text_suspicious", "q_contract_parse", "q_lcom4", "q_class_role", "q_skeleton", "q_tree", "q_cache_key",
    "q_budget_gate", "q_json_extract", "q_contract_chains", "q_native_complexity", "q_native_maintainability",
)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("CHECK_ALL") else QUICK)
def test_rows_equal_the_oracle(spark, db, name):
    df = contract.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    found = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    relation = db.sql(contract.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert found == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())

"""Kernel queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from faultline import composed, coverage, searches  # noqa: F401  register their queries
from faultline import queries

SF = "/root/testdata/sf0.001"
#: Whole engine runs over the inline project; test_engine.py covers what they do.
LONG = {"op_g05_sites", "op_a29_transforms", "op_a40_tests", "op_j05_import_edges", "op_j02_call_edges", "op_a37_neighbors", "op_o11_report", "op_o38_requests", "op_f05_switches", "op_g19_stats", "op_t01_structure_order", "op_t02_lineage_order", "op_g03_model_chain", "op_g05_call_chain", "op_g05_forty_sites", "op_j05_forty_edges", "op_x08_search_notes", "op_f20_missing_targets", "op_g13_history_stats"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(([plain(x) for x in r] for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted({name for name, (_, sql) in queries.REGISTRY.items() if sql} - LONG))
def test_query_equals_sql(spark, oracle, name):
    f, sql = queries.REGISTRY[name]
    got, want = f(spark, SF).toPandas(), oracle.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

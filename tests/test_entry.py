"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

from tests.oracle_check import duck

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_flagship(spark):
    df = _entry_module().entry(spark)
    assert len(df.collect()) > 0
    assert df.columns[:2] == ["period_start", "customer_type"]


def test_oracle_keys_are_queries_and_sql_prepares(sf_dir):
    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 77
    con = duck(sf_dir)
    for key, sql in o.items():
        con.execute(f"EXPLAIN {sql}")        # parses and binds against the tables

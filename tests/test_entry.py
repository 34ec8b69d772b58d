"""The driver contract in __spark_entry__.py."""

import importlib.util
from pathlib import Path

from tandem.plans.queries import all_queries

ROOT = Path(__file__).resolve().parents[1]


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["pair", "season_modified", "season_plain"]


def test_oracle_keys_are_queries():
    mod = _entry_module()
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q)
    assert {"score_lr", "score_gbt", "positive_probability", "model_pair_ranking",
            "model_pair_ranking_gbt"} == set(all_queries()) - set(sql)
    assert len(q) >= 55

"""Registered queries vs their DuckDB oracles on the smallest fixture."""

import math
from collections import Counter

import duckdb
import pytest

from touchline.sources.testdata import TABLES

KEYS = [
    "drop_missing_essential", "median_impute", "median_impute_two_pass", "dedup_matches", "clean_tv",
    "removal_funnel", "nonfinite_columns", "odds_clean", "implied_probs_tv", "odds_variance",
    "calendar_features", "corner_avgs", "goal_avgs", "h2h_history", "h2h_pruned", "rest_days",
    "expected_total_corners", "v1_strength", "corner_stats", "corner_ranges", "frequent_teams",
    "tag_messages", "adjustments_by_type", "total_multiplier", "bet_tiers_hard", "rank_bets",
    "iqr_winsorise", "pct_winsorise", "standard_scale", "one_hot", "f_regression_scores", "mi_classif_scores",
    "top_k_features", "time_series_folds", "classification_report", "scan_season_files", "schema_audit",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf, duck, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())

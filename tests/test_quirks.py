"""Small hand-made inputs for the rules most likely to go wrong."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.functions.columns import safe_divide
from touchline.operators import clean as C
from touchline.operators import history as H
from touchline.operators import select as SE
from touchline.operators import text as T
from touchline.sources.rules import adjustment_rules

MATCH_SCHEMA = ("match_id BIGINT, date_gmt TIMESTAMP_NTZ, home_team_name STRING, away_team_name STRING, "
                "home_team_corner_count DOUBLE, away_team_corner_count DOUBLE, "
                "home_team_goal_count DOUBLE, away_team_goal_count DOUBLE")


def _day(i):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=i)


def test_substring_rules(spark):
    msgs = spark.createDataFrame([(1, 0, "They look unmotivated"), (1, 1, "Heavy TRAINING load"),
                                  (1, 2, "predict"), (1, 3, "nothing relevant here")],
                                 "conv_id BIGINT, turn BIGINT, text STRING")
    tags = {(r["turn"], r["rule_id"]) for r in T.tag_messages(msgs, adjustment_rules(spark)).collect()}
    assert (0, 18) in tags and (0, 19) in tags          # 'unmotivated' also hits 'motivated'
    assert (1, 7) in tags                                # 'training' hits 'rain'
    assert not any(t == 2 for t, _ in tags)              # commands are not tagged
    unmatched = [r["turn"] for r in T.unmatched_messages(msgs, adjustment_rules(spark)).collect()]
    assert unmatched == [3]


def test_session_state_reset_quit(spark):
    msgs = spark.createDataFrame([
        (7, 0, "rainy"), (7, 1, "reset"), (7, 2, "derby game"), (7, 3, "derby again"), (7, 4, "PREDICT "),
        (7, 5, "quit"), (7, 6, "windy"), (7, 7, "predict")], "conv_id BIGINT, turn BIGINT, text STRING")
    act = T.active_adjustments(msgs, adjustment_rules(spark)).collect()
    assert sorted((r["turn"], r["rule_id"], r["until_turn"] or 0, r["n_predicts"]) for r in act) == [
        (0, 7, 1, 0), (2, 13, 0, 1), (3, 13, 0, 1)]
    m = T.total_multiplier(msgs, adjustment_rules(spark)).collect()
    assert len(m) == 1 and abs(m[0]["total_multiplier"] - 1.2) < 1e-12 and m[0]["n_active"] == 2


def test_momentum_weights_oldest_first(spark):
    rows = [(i, _day(i), "A", f"B{i}", float(c), 0.0, 1.0, 0.0) for i, c in enumerate([1, 2, 3, 4, 0])]
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    h = H.team_history(df).where((F.col("team") == "A") & (F.col("match_id") == 4)).first()
    assert abs(h["momentum"] - (0.4 * 1 + 0.3 * 2 + 0.2 * 3 + 0.1 * 4)) < 1e-12
    assert h["prior"] == 4 and h["cf_avg_3"] == 3.0 and h["cf_avg_5"] == 0.0


def test_missing_goals_form_rules(spark):
    rows = [(0, _day(0), "A", "B", 1.0, 1.0, None, 1.0), (1, _day(1), "A", "C", 1.0, 1.0, 1.0, 1.0),
            (2, _day(2), "A", "D", 1.0, 1.0, 2.0, 0.0), (3, _day(3), "A", "E", 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    h = H.team_history(df).where((F.col("team") == "A") & (F.col("match_id") == 3)).first()
    assert abs(h["form_3"] - (0.0 + 0.5 + 1.0) / 3) < 1e-12       # missing goal -> 0 (v2/v3)
    assert abs(h["form_tv_3"] - (0.5 + 0.5 + 1.0) / 3) < 1e-12    # missing goal -> draw (tv)
    assert h["gf_avg_3"] is None                                  # mean with a NaN is NaN


def test_equal_dates_break_ties_by_id(spark):
    rows = [(5, _day(0), "A", "B", 1.0, 0.0, 0.0, 0.0), (3, _day(0), "A", "C", 2.0, 0.0, 0.0, 0.0),
            (9, _day(1), "A", "D", 3.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    pos = {r["match_id"]: r["prior"] for r in H.sequence_position(H.team_long(df), ["team"])
           .where(F.col("team") == "A").collect()}
    assert pos == {3: 0, 5: 1, 9: 2}


def test_dedup_keeps_smallest_id(spark):
    rows = [(8, _day(0), "A", "B", 1.0, 0.0, 0.0, 0.0), (2, _day(0), "A", "B", 5.0, 0.0, 0.0, 0.0),
            (4, _day(0), "B", "A", 1.0, 0.0, 0.0, 0.0)]
    out = C.dedup_matches(spark.createDataFrame(rows, MATCH_SCHEMA)).collect()
    assert sorted((r["match_id"], r["home_team_corner_count"]) for r in out) == [(2, 5.0), (4, 1.0)]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1e-13), (5.0, 0.01), (None, 2.0), (float("inf"), 2.0), (3.0, 2.0)],
                               "n DOUBLE, d DOUBLE")
    got = [r[0] for r in df.select(safe_divide(F.col("n"), F.col("d"), 0.5)).collect()]
    assert got == [0.5, 0.5, 100.0, 0.5, 0.5, 1.5]


def test_skip_warmup_sorts_missing_dates_last(spark):
    rows = [(1, None, "A", "B", 1.0, 0.0, 0.0, 0.0), (2, _day(1), "A", "B", 1.0, 0.0, 0.0, 0.0),
            (3, _day(0), "A", "B", 1.0, 0.0, 0.0, 0.0)]
    out = C.skip_warmup(spark.createDataFrame(rows, MATCH_SCHEMA), 2)
    assert [r["match_id"] for r in out.collect()] == [1]


def test_count_suffix_dropped_from_numeric_list(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 1)],
                               "match_id BIGINT, h2h_matches_count DOUBLE, total_goals DOUBLE, x DOUBLE, home_win INT")
    assert SE.numeric_feature_list(df, []) == ["x"]
    assert SE.numeric_feature_list(df, [], strict=False) == ["total_goals", "x"]


def test_iqr_winsorise_clips_and_fills(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(1000.0,), (None,)], "x DOUBLE")
    out = sorted((r["x"] for r in C.iqr_winsorise(df, ["x"]).collect()))
    # interpolated q1 = 3.25, q3 = 7.75 -> upper = 19.0; the missing value takes the median 5.5
    assert out[-1] == 19.0 and 5.5 in out

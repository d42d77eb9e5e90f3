"""The text operators see rules in force, long conversations, and every branch."""

import math

import pytest

from touchline.operators import text as T
from touchline.plans.catalog import REGISTRY
from touchline.sources.rules import adjustment_rules
from touchline.sources.testdata import messages

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id BIGINT, turn BIGINT, text STRING"


def test_fixture_reaches_every_branch(spark):
    mult = T.total_multiplier(messages(spark, SF), adjustment_rules(spark)).collect()
    assert {0, 1, 2} <= {min(r["n_active"], 2) for r in mult}
    assert any(r["total_multiplier"] > 1 for r in mult) and any(r["total_multiplier"] < 1 for r in mult)
    labels = {r["impact_label"] for r in REGISTRY["impact_pct"].fn(spark, SF).collect()}
    assert labels == {"minimal", "more", "fewer"}
    lines = REGISTRY["adjusted_recommendation"].fn(spark, SF).collect()
    assert {r["change_label"] for r in lines} == {"~", "changed"}
    assert {r["recommendation"] for r in lines} == {"OVER strong", "Over", "Skip", "Under", "UNDER strong"}
    assert len(lines) == 9 * len(mult)
    assert len(REGISTRY["adjust_total"].fn(spark, SF).collect()) == len(mult)
    hits = REGISTRY["active_adjustments"].fn(spark, SF).collect()
    assert any(r["until_turn"] is not None for r in hits) and any(r["n_predicts"] > 1 for r in hits)


@pytest.mark.parametrize("m, want", [(0.5, 0.6), (0.7, 0.7), (2.0, 1.5), (1.2, 1.2)])
def test_multiplier_is_clipped_at_both_ends(spark, m, want):
    rules = spark.createDataFrame([(1, "storm", "weather", m, "d")],
                                  "rule_id INT, pattern STRING, type STRING, multiplier DOUBLE, description STRING")
    msgs = spark.createDataFrame([(1, 0, "storm"), (1, 1, "storm"), (1, 2, "predict")], SCHEMA)
    assert math.isclose(T.total_multiplier(msgs, rules).first()["total_multiplier"], want)


@pytest.mark.parametrize("m, p, want", [(1.5, 0.9, 0.95), (0.6, 0.1, 0.05), (1.5, 0.5, 0.7), (1.0, 0.5, 0.5)])
def test_line_shift_is_clipped(spark, m, p, want):
    mult = spark.createDataFrame([(1, 0, 1, m)], "conv_id BIGINT, predict_turn BIGINT, n_active BIGINT, total_multiplier DOUBLE")
    lines = spark.createDataFrame([(1, 9.5, p)], "conv_id BIGINT, line DOUBLE, over_probability DOUBLE")
    assert math.isclose(T.adjust_line_probs(mult, lines).first()["adjusted_over_probability"], want)


def test_hot_conversation_is_split_and_linear(spark):
    """One conversation of many turns, in buckets of 10: equal to a plain loop, one row per predict or hit."""
    texts = ["rainy", "predict", "windy derby", "predict", "friendly", "reset", "predict", "cold"]
    rows = [(1, i, texts[i % 7 if i % 50 else 5] if i % 3 else "predict") for i in range(600)]
    msgs = spark.createDataFrame(rows, SCHEMA)
    rules = adjustment_rules(spark)
    tags = {}
    for r in T.tag_messages(msgs, rules).collect():
        tags.setdefault(r["turn"], []).append(r["multiplier"])
    want, held = {}, []
    for _, turn, text in rows:
        if text == "reset":
            held = []
        elif text == "predict":
            m = math.exp(sum(map(math.log, held)) / len(held)) if held else 1.0
            want[turn] = (len(held), round(min(max(m, 0.6), 1.5), 9))
        else:
            held += tags.get(turn, [])
    seg = T.segment_totals(msgs, rules, bucket_turns=10).where("command = 'predict'")
    got = {r["turn"]: (r["n"], round(r["m"], 9)) for r in seg.select(
        "turn", seg["n_active"].alias("n"), T.clipped_geo_mean(seg["n_active"], seg["sum_ln"]).alias("m")).collect()}
    assert got == want
    assert T.active_adjustments(msgs, rules).count() == sum(map(len, tags.values()))
    by_type = T.adjustments_by_type(msgs, rules).collect()
    assert by_type and all(r["descriptions"].count(";") < 19 for r in by_type)


def test_no_join_is_on_the_conversation_alone(spark):
    """A conversation of a third of all turns meets its facts by bucket of turns."""
    rows = [(1, i, "rain" if i % 3 else "predict") for i in range(300)] + [(2, 0, "predict")]
    msgs = spark.createDataFrame(rows, SCHEMA)
    rules = adjustment_rules(spark)
    base = spark.createDataFrame([(1, 10.0), (2, 8.0)], "conv_id BIGINT, original_prediction DOUBLE")
    mult = T.total_multiplier(msgs, rules)
    small = T._with_facts(mult, base, ["conv_id"], "predict_turn", bucket_turns=7)
    assert sorted(tuple(r) for r in small.select(mult.columns).collect()) == sorted(tuple(r) for r in mult.collect())
    plan = T.adjust_total(mult, base)._jdf.queryExecution().optimizedPlan().toString()
    assert "__fb" in plan
    # the rows themselves are joined by conversation and bucket only
    assert T._with_facts(mult, base.where("conv_id = 2"), ["conv_id"], "predict_turn").count() == 1

"""Free-text adjustments (T1-T10), re-aimed from one chat session to a table
of messages `(conv_id, turn, text)`; all state is scoped per conversation.

Tagging joins the messages with the 19-row rule table (fixed size, so it is
broadcast) and keeps the pairs whose pattern occurs in the lower-cased text.
Session state (reset, quit, what is in force at a `predict`) is a running
maximum and running sums inside buckets of turns - no join of predicts with
hits, and no window or list over a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import round_half_even
from touchline.sources.rules import COMMAND_WORDS, QUIT_WORDS


def command_of(text_col: str = "text"):
    t = F.lower(F.trim(F.col(text_col)))
    return (F.when(t.isin(*QUIT_WORDS), F.lit("quit"))
            .when(t.isin(*COMMAND_WORDS), t)
            .otherwise(F.lit("text")))


def command_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, command) with command in quit/help/predict/reset/status/text."""
    return messages.select("conv_id", "turn", command_of().alias("command"))


def tag_messages(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (message, rule) whose pattern is found in the lower-cased text.

    Only free-text turns are tagged (commands are handled by the session).
    """
    text = messages.where(command_of() == "text") \
        .select("conv_id", "turn", F.lower(F.trim(F.col("text"))).alias("__lt"))
    return text.crossJoin(F.broadcast(rules)).where(F.expr("__lt rlike pattern")) \
        .select("conv_id", "turn", "rule_id", "type", "multiplier", "description")


def unmatched_messages(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Free-text turns that hit no rule."""
    text = messages.where(command_of() == "text").select("conv_id", "turn", "text")
    hits = tag_messages(messages, rules).select("conv_id", "turn").distinct()
    return text.join(hits, ["conv_id", "turn"], "left_anti")


TURN_BUCKET = 100_000


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], turn: str = "turn",
                bucket_turns: int = TURN_BUCKET) -> DataFrame:
    """`rows` with the `facts` of their key. A key may hold most rows, so its facts are first given to each of its buckets of turns
    (a table of one row a key and bucket) and the rows meet them there; rows whose key has no facts go."""
    own = rows.withColumn("__fb", (F.col(turn) / bucket_turns).cast("bigint"))
    there = own.select(*keys, "__fb").distinct().join(facts, keys)
    return own.join(there, [*keys, "__fb"]).drop("__fb")


def session_segments(messages: DataFrame, bucket_turns: int = TURN_BUCKET) -> DataFrame:
    """Per turn: the command, the segment (turn of the last reset at or before
    it, -1 if none), kept only while the session is open (before the first quit).

    No window holds a whole conversation: the quit turn is a grouped minimum,
    and the last reset is a running maximum inside buckets of `bucket_turns`
    turns plus the maximum of all earlier buckets (a small per-bucket table).
    """
    cmd = command_messages(messages).withColumn("__b", (F.col("turn") / bucket_turns).cast("bigint"))
    reset_turn = F.when(F.col("command") == "reset", F.col("turn"))
    quits = cmd.groupBy("conv_id").agg(F.min(F.when(F.col("command") == "quit", F.col("turn"))).alias("quit_turn"))
    per_bucket = cmd.groupBy("conv_id", "__b").agg(F.max(reset_turn).alias("__bmax"))
    earlier = Window.partitionBy("conv_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # the quit turn and the last reset come down to the turns by bucket, never by conversation alone
    carried = per_bucket.select("conv_id", "__b", F.max("__bmax").over(earlier).alias("__prev")).join(quits, "conv_id")
    in_bucket = Window.partitionBy("conv_id", "__b").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    seg = cmd.join(carried, ["conv_id", "__b"]).select(
        "conv_id", "turn", "command",
        F.coalesce(F.greatest(F.max(reset_turn).over(in_bucket), F.col("__prev")), F.lit(-1)).cast("bigint")
        .alias("segment"), "quit_turn")
    return seg.where(F.col("quit_turn").isNull() | (F.col("turn") < F.col("quit_turn"))).drop("quit_turn")


def segment_totals(messages: DataFrame, rules: DataFrame, bucket_turns: int = TURN_BUCKET) -> DataFrame:
    """Per turn of an open session, over the earlier turns of its segment: rule hits (n_active), the sum of
    the logs of their multipliers (sum_ln), and predicts (n_predicts).

    Hits are first summed per turn (19 at most). Running sums go over buckets of `bucket_turns` turns plus
    the totals of earlier buckets, so a conversation of any length is split and the output is linear."""
    per_turn = tag_messages(messages, rules).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.ln("multiplier")).alias("__s"))
    turns = session_segments(messages, bucket_turns).join(per_turn, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "command", "segment", (F.col("turn") / bucket_turns).cast("bigint").alias("__b"),
        F.coalesce("__n", F.lit(0)).alias("__n"), F.coalesce("__s", F.lit(0.0)).alias("__s"),
        (F.col("command") == "predict").cast("bigint").alias("__p"))
    names = {"__n": "n_active", "__s": "sum_ln", "__p": "n_predicts"}
    earlier = Window.partitionBy("conv_id", "segment").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "segment", "__b").agg(*[F.sum(c).alias(c) for c in names])
    totals = totals.select("conv_id", "segment", "__b", *[F.sum(c).over(earlier).alias(f"{c}_before") for c in names])
    inside = Window.partitionBy("conv_id", "segment", "__b").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.join(totals, ["conv_id", "segment", "__b"]).select(
        "conv_id", "turn", "command", "segment",
        *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0))).alias(name)
          for c, name in names.items()])


def active_adjustments(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """T4: one row per rule hit of an open session: the turn until which it is in force (the next reset; null if none
    follows) and the number of `predict` turns that see it. Repeats accumulate, so each is a row."""
    seg = segment_totals(messages, rules)
    ends = seg.groupBy("conv_id", "segment").agg(F.sum((F.col("command") == "predict").cast("bigint")).alias("__all"))
    starts = seg.select("conv_id", "segment").distinct()
    following = Window.partitionBy("conv_id").orderBy("segment")
    starts = starts.withColumn("until_turn", F.lead("segment").over(following))
    hits = tag_messages(messages, rules).join(seg.select("conv_id", "turn", "segment", "n_predicts"),
                                              ["conv_id", "turn"])
    facts = ends.join(starts, ["conv_id", "segment"])  # one row a segment
    return _with_facts(hits, facts, ["conv_id", "segment"]).select(
        "conv_id", "turn", "rule_id", "type", "multiplier", "description", "segment", "until_turn",
        (F.col("__all") - F.col("n_predicts")).alias("n_predicts"))


def current_adjustments(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules in force when the session ends (after the last reset, before quit)."""
    seg = session_segments(messages)
    last_seg = seg.groupBy("conv_id").agg(F.max("segment").alias("segment"))
    tags = tag_messages(messages, rules).join(seg.select("conv_id", "turn", "segment"), ["conv_id", "turn"])
    return _with_facts(tags, last_seg, ["conv_id", "segment"])


def adjustments_by_type(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """T5: per conversation and type: hits, up / down, and each rule once with its number of hits, in the order of
    its first turn. Hits are counted per rule first, so a list holds 19 entries at most."""
    per_rule = current_adjustments(messages, rules).groupBy("conv_id", "type", "rule_id", "description").agg(
        F.count(F.lit(1)).alias("k"), F.min("turn").alias("first_turn"), F.max("multiplier").alias("multiplier"))
    up = F.col("multiplier") > 1
    return per_rule.groupBy("conv_id", "type").agg(
        F.sum("k").alias("n"),
        F.concat_ws("; ", F.transform(
            F.array_sort(F.collect_list(F.struct("first_turn", "rule_id", "description", "k"))),
            lambda s: F.concat(s["description"], F.lit(" x"), s["k"].cast("string")))).alias("descriptions"),
        F.sum(F.when(up, F.col("k")).otherwise(0)).cast("bigint").alias("n_up"),
        F.sum(F.when(up, 0).otherwise(F.col("k"))).cast("bigint").alias("n_down"),
    )


def clipped_geo_mean(n, sum_ln):
    """exp(sum_ln / n) clipped to [0.6, 1.5]; 1.0 for no hits."""
    mean = F.exp(sum_ln / F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.least(F.greatest(mean, F.lit(0.6)), F.lit(1.5))).otherwise(F.lit(1.0))


def total_multiplier(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Geometric mean of the multipliers in force at each predict, clipped to [0.6, 1.5]; 1.0 if none."""
    seg = segment_totals(messages, rules).where(F.col("command") == "predict")
    return seg.select("conv_id", F.col("turn").alias("predict_turn"), "n_active",
                      clipped_geo_mean(F.col("n_active"), F.col("sum_ln")).alias("total_multiplier"))


def impact_pct(mult: DataFrame) -> DataFrame:
    """(m - 1) * 100 and its label."""
    impact = (F.col("total_multiplier") - 1) * 100
    return mult.select("conv_id", "predict_turn", impact.alias("impact_pct"),
                       F.when(F.abs(impact) < 1, "minimal").when(impact > 0, "more").otherwise("fewer")
                       .alias("impact_label"))


def adjust_total(mult: DataFrame, base: DataFrame) -> DataFrame:
    """Total x m, rounded half-even to 2 places; keeps original and factor.

    `base` has (conv_id, original_prediction)."""
    j = _with_facts(mult, base, ["conv_id"], "predict_turn")
    return j.select("conv_id", "predict_turn", "original_prediction",
                    F.col("total_multiplier").alias("adjustment_factor"),
                    round_half_even(F.col("original_prediction") * F.col("total_multiplier"), 2).alias("adjusted_prediction"))


def adjust_line_probs(mult: DataFrame, line_probs: DataFrame) -> DataFrame:
    """Shift the over-probability towards the expected direction.

    `line_probs` has (conv_id, line, over_probability)."""
    m, p = F.col("total_multiplier"), F.col("over_probability")
    new = F.when(m > 1, F.least(F.lit(0.95), p + F.least(F.lit(0.2), (m - 1) * 0.5))) \
        .otherwise(F.greatest(F.lit(0.05), p - F.least(F.lit(0.2), (1 - m) * 0.5)))
    j = _with_facts(mult, line_probs, ["conv_id"], "predict_turn").select("conv_id", "predict_turn", "line", "total_multiplier",
                                                 p.alias("original_over_probability"), new.alias("adj"))
    return j.select("conv_id", "predict_turn", "line", "original_over_probability",
                    F.col("adj").alias("adjusted_over_probability"),
                    (1 - F.col("adj")).alias("adjusted_under_probability"),
                    F.when(F.col("adj") > 0.5, "Over").otherwise("Under").alias("adjusted_prediction"))


def adjusted_recommendation(adjusted: DataFrame) -> DataFrame:
    """Change in points ('~' if < 2) and the recommendation band."""
    orig = F.col("original_over_probability") * 100
    adj = F.col("adjusted_over_probability") * 100
    change = adj - orig
    rec = (F.when(adj > 65, "OVER strong").when(adj < 35, "UNDER strong").when(adj > 55, "Over")
           .when(adj < 45, "Under").otherwise("Skip"))
    return adjusted.select("conv_id", "predict_turn", "line", orig.alias("original_pct"), adj.alias("adjusted_pct"),
                           change.alias("change"),
                           F.when(F.abs(change) < 2, "~").otherwise("changed").alias("change_label"),
                           rec.alias("recommendation"))

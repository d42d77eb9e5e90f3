"""Inputs derived from the driver's parquet tables.

The driver ships TPC-H-like tables; `matches` and `messages` are deterministic
projections of them (FIXTURES.md §2-3). Every query starts from these, so the
work of every query grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The column projection of FIXTURES.md §2, in its order.
MATCH_COLUMNS = [
    ("match_id", "k"),
    ("season", "CAST(YEAR(d) AS INT)"),
    ("date_raw", "CASE WHEN k % 113 = 0 THEN 'not a date' ELSE CAST(CAST(d AS DATE) AS STRING) END"),
    ("home_team_name", "CONCAT(seg, '_', CAST(nk AS STRING))"),
    ("away_team_name", "CONCAT(seg, '_', CAST((nk + 1 + k % 24) % 25 AS STRING))"),
    ("home_team_corner_count", "CAST(CASE WHEN k % 97 = 0 THEN -1 ELSE q_odd % 12 END AS DOUBLE)"),
    ("away_team_corner_count", "CAST(CASE WHEN k % 101 = 0 THEN 30 ELSE q_even % 10 END AS DOUBLE)"),
    ("home_team_goal_count", "CAST(CASE WHEN k % 89 = 0 THEN -1 ELSE mx % 5 END AS DOUBLE)"),
    ("away_team_goal_count", "CAST(CASE WHEN k % 131 = 0 THEN 12 ELSE n_li % 4 END AS DOUBLE)"),
    ("pre_match_ppg_home", "CAST(ab % 300 AS DOUBLE) / 100"),
    ("pre_match_ppg_away", "CAST((ab * 7 + 13) % 300 AS DOUBLE) / 100"),
    ("pre_match_xg_home", "CASE WHEN k % 37 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(tp % 280 AS DOUBLE) / 100 END"),
    ("pre_match_xg_away", "CASE WHEN k % 71 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((tp * 3) % 260 AS DOUBLE) / 100 END"),
    ("odds_home", "CASE WHEN k % 53 = 0 THEN 'n/a' ELSE CAST(CAST(100 + tp % 700 AS DOUBLE) / 100 AS STRING) END"),
    ("odds_draw", "CASE WHEN k % 43 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(300 + tp % 200 AS DOUBLE) / 100 END"),
    ("odds_away", "CAST(120 + (tp * 11) % 14000 AS DOUBLE) / 100"),
    ("odds_over25", "CAST(110 + (tp * 5) % 200 AS DOUBLE) / 100"),
    ("odds_btts_yes", "CAST(120 + (tp * 7) % 150 AS DOUBLE) / 100"),
    ("home_ppg", "CAST((ab * 3) % 300 AS DOUBLE) / 100"),
    ("away_ppg", "CAST((ab * 11 + 7) % 300 AS DOUBLE) / 100"),
    ("avg_goals_pre", "CASE WHEN k % 83 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(150 + (tp * 13) % 250 AS DOUBLE) / 100 END"),
    ("avg_corners_pre", "CAST(70 + tp % 60 AS DOUBLE) / 10"),
    ("btts_pct_pre", "CAST((tp * 17) % 101 AS DOUBLE)"),
    ("over25_pct_pre", "CAST((tp * 19) % 101 AS DOUBLE)"),
    ("over35_pct_pre", "CAST(CASE WHEN k % 61 = 0 THEN 999 ELSE (tp * 23) % 101 END AS DOUBLE)"),
    ("home_team_red_cards", "CASE WHEN k % 19 = 0 THEN '1' WHEN k % 23 = 0 THEN 'x' ELSE '0' END"),
    ("away_team_red_cards", "CASE WHEN k % 29 = 0 THEN '1' ELSE '0' END"),
    ("home_team_possession", "CAST(CASE WHEN k % 31 = 0 THEN 0 ELSE 35 + tp % 31 END AS DOUBLE)"),
    ("away_team_possession", "CAST(CASE WHEN k % 31 = 0 THEN 0 WHEN k % 47 = 0 THEN 10 ELSE 65 - tp % 31 END AS DOUBLE)"),
    ("home_team_shots", "CAST(CASE WHEN k % 59 = 0 THEN 0 ELSE 5 + tp % 15 END AS DOUBLE)"),
    ("away_team_shots", "CAST(CASE WHEN k % 59 = 0 THEN 0 ELSE 3 + (tp * 3) % 13 END AS DOUBLE)"),
]

# The texts of user turns by position, FIXTURES.md section 3, in order; None: the turn's own text.
SCRIPT = [
    "reserves playing", "first team", "key players missing", "defensive setup", "all out attack",
    "counter attack", "rainy weather", "windy", "hot day", "freezing", "final match", "friendly game",
    "derby", "tired legs", "well rested", "strict referee", "lenient referee", "motivated side",
    "unmotivated side", "reset", "quit", "predict", "predict", "predict", "predict", "predict",
    "Rain and wind at the derby final", "reserves, tired legs, friendly game, defensive setup",
    "all out attack in the final, derby", "unmotivated youth side", None,
]
# Conversations that make up one session, and the turns that each is given in it.
SESSION_CONVERSATIONS, SESSION_TURNS = 5, 100


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per played match (raw, uncleaned), FIXTURES.md §2.

    `lineitem` is aggregated per order before the join (partial aggregation
    map-side), so the join sees one row per order on both sides. Neither side
    is broadcast: at scale both grow with the data; AQE may still pick a
    broadcast at run time from measured sizes.
    """
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))).cast("bigint").alias("q_odd"),
            F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))).cast("bigint").alias("q_even"),
            F.count(F.lit(1)).alias("n_li"),
            F.max("l_linenumber").alias("mx"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    b = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("k"),
            F.col("o_orderdate").alias("d"),
            F.col("c_mktsegment").alias("seg"),
            F.col("c_nationkey").alias("nk"),
            F.floor("o_totalprice").cast("bigint").alias("tp"),
            F.floor(F.abs("c_acctbal")).cast("bigint").alias("ab"),
            "q_odd", "q_even", "n_li", "mx",
        )
    )
    return b.select([F.expr(expr).alias(name) for name, expr in MATCH_COLUMNS])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of `conversations`, five conversations to a session, with texts by position (FIXTURES.md section 3)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    p = (F.col("conv_id") * 7 + F.col("turn") * 5) % len(SCRIPT)
    script = F.array(*[F.lit(s) for s in SCRIPT])
    text = F.coalesce(F.element_at(script, (p + 1).cast("int")), F.col("text"))
    return conv.select(
        F.floor(F.col("conv_id") / SESSION_CONVERSATIONS).cast("bigint").alias("conv_id"),
        ((F.col("conv_id") % SESSION_CONVERSATIONS) * SESSION_TURNS + F.col("turn")).cast("bigint").alias("turn"),
        text.alias("text"))


def round6(c: Column) -> Column:
    """floor(x * 1e6 + 0.5) / 1e6: plain IEEE arithmetic, so any engine that
    rounds this way gets the same double from the same input."""
    finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.floor(c * 1000000.0 + 0.5) / 1000000.0).otherwise(c)


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 places (results are compared at 6 places)."""
    cols: list[Column] = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "double":
            cols.append(round6(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(cols)

"""The adjustment-rule table used to tag free-text messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "rule_id INT, pattern STRING, type STRING, multiplier DOUBLE, description STRING"

# The 19 adjustment rules (pattern, type, multiplier, description),
# in their original order. Patterns are searched anywhere in the lower-cased text.
ADJUSTMENT_RULES = [
    (1, "reserves|reserv|reserve|młodzi|youth|academy|druga", "team_strength", 0.85, "Reserve/Youth team playing"),
    (2, "first.?team|główny|podstawowy|strongest|full.?strength", "team_strength", 1.15, "Full strength team"),
    (3, "key.?players?.?missing|without.?star|bez.?gwiazd|kontuzje|injuries", "team_strength", 0.9, "Key players missing"),
    (4, "defensive|defensywny|park.?bus|defensive.?setup", "tactics", 0.8, "Defensive tactics expected"),
    (5, "attacking|ofensywny|all.?out.?attack|gung.?ho", "tactics", 1.2, "Attacking tactics expected"),
    (6, "counter.?attack|kontra|quick.?transitions", "tactics", 0.9, "Counter-attacking style"),
    (7, "rain|deszcz|wet|mokro|storm|burza", "weather", 1.1, "Wet conditions (more crosses/corners)"),
    (8, "wind|wiatr|windy|strong.?wind", "weather", 1.15, "Windy conditions (inaccurate crosses)"),
    (9, "hot|gorąco|very.?warm|heat", "weather", 0.95, "Hot weather (less intensity)"),
    (10, "cold|zimno|freezing|mróz", "weather", 0.92, "Cold weather (ball control issues)"),
    (11, "final|finał|playoff|play.?off|relegation|spadek", "importance", 1.25, "High stakes match"),
    (12, "friendly|sparing|towarzyski|meaningless|bez.?znaczenia", "importance", 0.7, "Low stakes match"),
    (13, "derby|lokalne.?derby|rivalry|rywalizacja", "importance", 1.2, "Derby/Rivalry match"),
    (14, "tired|zmęczeni|fatigue|many.?games|fixture.?congestion", "condition", 0.88, "Team fatigue"),
    (15, "fresh|wypoczęci|well.?rested|long.?break", "condition", 1.08, "Well rested team"),
    (16, "strict.?referee|sędzia.?surowy|many.?fouls", "referee", 1.1, "Strict referee (more fouls = more corners)"),
    (17, "lenient.?referee|pobłażliwy|lets.?play", "referee", 0.95, "Lenient referee"),
    (18, "motivated|zmotywowani|fighting.?for|desperate", "motivation", 1.1, "High motivation"),
    (19, "unmotivated|bez.?motywacji|nothing.?to.?play.?for|beach.?mode", "motivation", 0.85, "Low motivation"),
]

# Chat commands (compared after trim + lower-case).
QUIT_WORDS = ["quit", "exit", "bye"]
COMMAND_WORDS = ["help", "predict", "reset", "status"]


def adjustment_rules(spark: SparkSession) -> DataFrame:
    """19-row lookup table; its size is fixed, so broadcasting it is safe."""
    return spark.createDataFrame(ADJUSTMENT_RULES, RULE_SCHEMA)


def rules_values_sql() -> str:
    """The same table as a SQL VALUES list (used by the SQL oracles)."""
    rows = []
    for rid, pattern, typ, mult, desc in ADJUSTMENT_RULES:
        esc = lambda s: s.replace("'", "''")
        rows.append(f"({rid}, '{esc(pattern)}', '{typ}', CAST({mult} AS DOUBLE), '{esc(desc)}')")
    return "(VALUES " + ", ".join(rows) + ") AS r(rule_id, pattern, type, multiplier, description)"

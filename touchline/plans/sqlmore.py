"""DuckDB SQL for the report, text and scoring oracles."""

from __future__ import annotations

from touchline.operators.features import CORNER_LINES, HARD_LINES
from touchline.operators.score import MEMBER_ACCURACIES
from touchline.sources.rules import COMMAND_WORDS, QUIT_WORDS, rules_values_sql
from touchline.sources.testdata import SCRIPT, SESSION_CONVERSATIONS, SESSION_TURNS


def lines_values(lines=CORNER_LINES) -> str:
    return "(VALUES " + ", ".join(f"({float(L)})" for L in lines) + ") AS lv(line)"


def messages_cte() -> str:
    script = ", ".join("NULL" if p is None else f"'{p}'" for p in SCRIPT)
    return f"""msg AS (
  SELECT CAST(conv_id // {SESSION_CONVERSATIONS} AS BIGINT) AS conv_id,
    CAST((conv_id % {SESSION_CONVERSATIONS}) * {SESSION_TURNS} + turn AS BIGINT) AS turn,
    COALESCE(([{script}])[CAST((conv_id * 7 + turn * 5) % {len(SCRIPT)} + 1 AS INTEGER)], text) AS text
  FROM conversations WHERE role = 'user')"""


def text_ctes() -> str:
    quits = ", ".join(f"'{w}'" for w in QUIT_WORDS)
    cmds = ", ".join(f"'{w}'" for w in COMMAND_WORDS)
    return f"""{messages_cte()},
rules AS (SELECT * FROM {rules_values_sql()}),
cmd AS (SELECT conv_id, turn, text,
    CASE WHEN lower(trim(text)) IN ({quits}) THEN 'quit'
         WHEN lower(trim(text)) IN ({cmds}) THEN lower(trim(text)) ELSE 'text' END AS command FROM msg),
tags AS (SELECT c.conv_id, c.turn, r.rule_id, r.type, r.multiplier, r.description
  FROM cmd c JOIN rules r ON regexp_matches(lower(trim(c.text)), r.pattern) WHERE c.command = 'text'),
seg AS (SELECT * FROM (SELECT conv_id, turn, command,
    COALESCE(last_value(CASE WHEN command = 'reset' THEN turn END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS segment,
    COALESCE(min(CASE WHEN command = 'quit' THEN turn END) OVER (PARTITION BY conv_id), 4611686018427387904)
      AS quit_turn
  FROM cmd) WHERE turn < quit_turn),
active AS (SELECT p.conv_id, p.turn AS predict_turn, t.turn, t.rule_id, t.type, t.multiplier, t.description
  FROM seg p JOIN seg s ON s.conv_id = p.conv_id AND s.segment = p.segment AND s.turn < p.turn
  JOIN tags t ON t.conv_id = s.conv_id AND t.turn = s.turn
  WHERE p.command = 'predict'),
mult AS (SELECT p.conv_id, p.turn AS predict_turn, CAST(COALESCE(a.n, 0) AS BIGINT) AS n_active,
    COALESCE(a.m, 1.0) AS total_multiplier
  FROM seg p LEFT JOIN (SELECT conv_id, predict_turn, count(*) AS n,
      LEAST(GREATEST(exp(avg(ln(multiplier))), 0.6), 1.5) AS m FROM active GROUP BY 1, 2) a
    ON a.conv_id = p.conv_id AND a.predict_turn = p.turn
  WHERE p.command = 'predict')"""


def line_scores_cte(src: str = "h3") -> str:
    return f"""ls AS (SELECT match_id, line, p1, LEAST(0.99, p1 + 0.05) AS p2, GREATEST(0.01, p1 - 0.05) AS p3
  FROM (SELECT h.match_id, lv.line, 1 / (1 + exp((lv.line - h.expected_total_corners) / 2)) AS p1
        FROM {src} h, {lines_values()}))"""


def decisions_cte() -> str:
    total = sum(MEMBER_ACCURACIES)
    w = [repr(a / total) for a in MEMBER_ACCURACIES]
    hard = ", ".join(str(float(h)) for h in HARD_LINES)
    n_over = "(CAST(p1 > 0.5 AS INTEGER) + CAST(p2 > 0.5 AS INTEGER) + CAST(p3 > 0.5 AS INTEGER))"

    def dec(prob: str, thr: float) -> str:
        return (f"{prob} AS over_probability, 1 - {prob} AS under_probability, "
                f"CASE WHEN {prob} > 0.5 THEN 'Over' ELSE 'Under' END AS prediction, "
                f"GREATEST({prob}, 1 - {prob}) AS confidence, "
                f"CASE WHEN {prob} > {thr} THEN 'Over' WHEN 1 - {prob} > {thr} THEN 'Under' ELSE 'Skip' END"
                f" AS recommended, abs({prob} - 0.5) * 2 AS edge")

    ens = f"({w[0]} * p1 + {w[1]} * p2 + {w[2]} * p3)"
    return f"""dec AS (
  SELECT match_id, line, {dec('p1', 0.6)}, CAST(NULL AS INTEGER) AS consensus, 'Standard' AS special_info,
    0 AS is_hard_line
  FROM ls WHERE line NOT IN ({hard})
  UNION ALL
  SELECT match_id, line, {dec(ens, 0.62)},
    CAST({n_over} IN (0, 3) AS INTEGER) AS consensus,
    CASE WHEN {n_over} IN (0, 3) THEN 'CONSENSUS' ELSE 'Split(' || CAST({n_over} AS VARCHAR) || '/3)' END
      AS special_info,
    1 AS is_hard_line
  FROM ls WHERE line IN ({hard})),
tiers AS (SELECT match_id, line, recommended, confidence, edge, is_hard_line, special_info,
    (CASE WHEN recommended = 'Over' THEN over_probability ELSE under_probability END) * 100 AS probability,
    CASE WHEN recommended = 'Skip' THEN NULL
         WHEN is_hard_line = 1 AND consensus = 1 THEN
           CASE WHEN confidence >= 0.68 AND edge >= 0.25 THEN 'ensemble'
                WHEN confidence >= 0.62 AND edge >= 0.15 THEN 'good' ELSE 'avoid' END
         WHEN is_hard_line = 1 THEN
           CASE WHEN confidence >= 0.72 AND edge >= 0.35 THEN 'strong'
                WHEN confidence >= 0.65 AND edge >= 0.22 THEN 'good' ELSE 'avoid' END
         ELSE CASE WHEN confidence >= 0.75 AND edge >= 0.3 THEN 'strong'
                   WHEN confidence >= 0.65 AND edge >= 0.2 THEN 'good' ELSE 'avoid' END END AS tier
  FROM dec)"""

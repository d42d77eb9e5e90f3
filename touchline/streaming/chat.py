"""The chat session as a Structured Streaming query.

Messages `(conv_id, turn, text)` arrive as files. Each message is classified
(command or free text) and matched against the 19 rules with built-in
expressions; a per-conversation state (`applyInPandasWithState`) keeps the
number and the log sum of the multipliers in force - `reset` clears them, `quit`
closes the session - and every `predict` emits the clipped geometric mean of what is in force. This is
the streaming form of the batch operators T2, T4 and T6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.text import command_of
from touchline.sources.rules import ADJUSTMENT_RULES

MESSAGE_SCHEMA = "conv_id BIGINT, turn BIGINT, text STRING"
OUTPUT_SCHEMA = "conv_id BIGINT, predict_turn BIGINT, n_active BIGINT, total_multiplier DOUBLE"
STATE_SCHEMA = "closed BOOLEAN, n BIGINT, sum_ln DOUBLE"
HELD_SCHEMA = (STATE_SCHEMA + ", due BIGINT, held_turn ARRAY<BIGINT>, held_command ARRAY<STRING>, held_n ARRAY<BIGINT>, "
               "held_sum_ln ARRAY<DOUBLE>")
IDLE_MS = 24 * 3600 * 1000  # a conversation silent for so long leaves the state


def _rules_literal() -> str:
    items = ", ".join(
        f"named_struct('pattern', '{p.replace(chr(39), chr(39) * 2)}', 'm', CAST({m} AS DOUBLE))"
        for _, p, _, m, _ in ADJUSTMENT_RULES)
    return f"array({items})"


def tagged(messages: DataFrame) -> DataFrame:
    """Per message: its command, the number of rules it hits and the sum of their multipliers' logs."""
    hits = F.expr(f"transform(filter({_rules_literal()}, r -> lower(trim(text)) rlike r.pattern), r -> ln(r.m))")
    out = messages.select("conv_id", "turn", command_of().alias("command"), hits.alias("hits"))
    free = F.col("command") == "text"
    total = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    return out.select("conv_id", "turn", "command", F.when(free, F.size("hits")).otherwise(0).alias("n"),
                      F.when(free, total).otherwise(0.0).alias("sum_ln"))


COLUMNS = ["conv_id", "predict_turn", "n_active", "total_multiplier"]


def _advance(pdf: pd.DataFrame, closed: bool, n: int, sum_ln: float) -> tuple[pd.DataFrame, bool, int, float]:
    """The predicts among the turns `pdf`, in turn order, and the session's state after them."""
    quits = np.flatnonzero(pdf["command"] == "quit")
    if closed or len(quits):
        pdf, closed = pdf.iloc[:0 if closed else quits[0]], True
    if not len(pdf):
        return pd.DataFrame([], columns=COLUMNS), closed, n, sum_ln
    # running totals, less what they were at the last reset
    run_n, run_s = n + pdf["n"].cumsum().to_numpy(), sum_ln + pdf["sum_ln"].cumsum().to_numpy()
    last = np.maximum.accumulate(np.where(pdf["command"] == "reset", np.arange(len(pdf)), -1))
    run_n = run_n - np.where(last >= 0, run_n[last], 0)
    run_s = run_s - np.where(last >= 0, run_s[last], 0.0)
    ask = (pdf["command"] == "predict").to_numpy()
    mean = np.where(run_n > 0, np.clip(np.exp(run_s / np.maximum(run_n, 1)), 0.6, 1.5), 1.0)
    out = pd.DataFrame({"conv_id": pdf["conv_id"][ask], "predict_turn": pdf["turn"][ask],
                        "n_active": run_n[ask], "total_multiplier": mean[ask]}, columns=COLUMNS)
    return out, closed, int(run_n[-1]), float(run_s[-1])


def _session(key, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """The state of a conversation is three numbers, whatever its length."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([], columns=COLUMNS)
        return
    closed, n, sum_ln = state.get if state.exists else (False, 0, 0.0)
    for pdf in batches:
        out, closed, n, sum_ln = _advance(pdf.sort_values("turn", kind="stable"), closed, n, sum_ln)
        if len(out):
            yield out
    state.update((closed, n, sum_ln))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def _ordered_session(key, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """As `_session`, for turns numbered from 0 without gaps that arrive in any order: a turn waits in the state until all
    before it are there. The state holds the waiting turns only, as numbers and commands; a session that has quit holds none.
    After `idle_ms` of silence a gap is given up and the waiting turns count in their order."""
    closed, n, sum_ln, due, *held = state.get if state.exists else (False, 0, 0.0, 0, [], [], [], [])
    waiting = pd.DataFrame(dict(zip(("turn", "command", "n", "sum_ln"), held)))
    waiting["conv_id"] = key[0]
    if state.hasTimedOut:
        yield _advance(waiting.sort_values("turn", kind="stable"), closed, n, sum_ln)[0]
        state.remove()
        return
    got = pd.concat([waiting, *batches], ignore_index=True)
    # a turn that comes again, or after its gap was given up, has been counted
    got = got[got["turn"] >= due].drop_duplicates("turn").sort_values("turn", kind="stable")
    turns = got["turn"].to_numpy()
    ready = turns == due + np.arange(len(turns))
    out, closed, n, sum_ln = _advance(got[ready], closed, n, sum_ln)
    due, rest = due + int(ready.sum()), got[~ready] if not closed else got.iloc[:0]
    if len(out):
        yield out
    state.update((closed, n, sum_ln, due, rest["turn"].astype(int).tolist(), rest["command"].tolist(),
                  rest["n"].astype(int).tolist(), rest["sum_ln"].astype(float).tolist()))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def session_multipliers(messages: DataFrame, idle_ms: int | None = None, any_order: bool = False) -> DataFrame:
    """Streaming (or batch) messages -> one row per `predict`.

    By default a conversation's turns are expected to arrive in turn order across
    micro-batches (one person types them one after another); inside a
    micro-batch they are sorted by turn. With `any_order`, turns are numbered from 0 without gaps and may
    arrive in any order, and again: each waits for those before it. With `idle_ms`, a conversation silent
    for so long is forgotten, closed ones too.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    session, schema = (_ordered_session, HELD_SCHEMA) if any_order else (_session, STATE_SCHEMA)
    return tagged(messages).groupBy("conv_id").applyInPandasWithState(
        partial(session, idle_ms=idle_ms), OUTPUT_SCHEMA, schema, "append", timeout)


def run(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, available_now: bool = True):
    """Start the query: parquet files in `source_dir` -> parquet rows in `sink_dir`.

    `checkpoint` must be on shared storage (offsets and state survive a restart).
    """
    stream = spark.readStream.schema(MESSAGE_SCHEMA).parquet(source_dir)
    writer = (session_multipliers(stream, None if available_now else IDLE_MS).writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()

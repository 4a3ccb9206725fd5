"""Streaming forms of the stateful conversation operators.

Messages arrive as a stream; each conversation's state is small: the user message that still waits for its
answer, pending sums, or the turns within the budget.  With `idle_ms` a conversation without messages for that processing time is
forgotten, so state ends, and one that goes on later starts anew.  Spark then keeps triggering batches, so streams that should end with
their input (available now) leave it out and keep their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.text import estimate_tokens_mixed, memory_signal


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _messages(stream: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    tools = F.size(F.regexp_extract_all(F.lower(text), F.lit("tool"), F.lit(0)))
    return stream.select("conv_id", "turn", "role", F.coalesce(memory_signal(text), F.lit(False)).alias("signal"), estimate_tokens_mixed(text).alias("cost"), tools.cast("long").alias("tools"))


def extraction_batches(stream: DataFrame, tokens: int = 150, mentions: int = 3, idle_ms: int | None = None) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a stream -> conv_id, batch, first_turn, last_turn of each batch that closes.

    Within a micro-batch messages are taken by turn; a later micro-batch must not bring earlier turns.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        waiting, first, cost, tools, batch = state.get if state.exists else (None, None, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        user = waiting
        for r in rows.itertuples():
            if r.role == "user":
                user = f"{r.turn}|{int(r.signal)}|{r.cost}"
            elif r.role == "assistant" and user is not None:
                turn, signal, own = (int(x) for x in user.split("|"))
                user = None
                first = turn if first is None else first
                cost += own + r.cost
                tools += r.tools
                if signal or (cost >= tokens and (tools >= mentions or not r.tools)):
                    batch += 1
                    out.append((key[0], batch, first, turn))
                    first, cost, tools = None, 0, 0
            else:
                user = None
        state.update((user, first, cost, tools, batch))
        yield pd.DataFrame(out, columns=["conv_id", "batch", "first_turn", "last_turn"])

    return _messages(stream).groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, batch long, first_turn long, last_turn long", "waiting string, first long, cost long, tools long, batch long", "append", _timeout(idle_ms)
    )


def budget_windows(stream: DataFrame, budget: int = 1200, per_message: int = 4, idle_ms: int | None = None) -> DataFrame:
    """The same stream -> conv_id, turn, oldest_turn, live_tokens after each complete turn."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        waiting, turns, costs = state.get if state.exists else (None, [], [])
        turns, costs, user, out = list(turns), list(costs), waiting, []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            if r.role == "user":
                user = f"{r.turn}|{r.cost}"
            elif r.role == "assistant" and user is not None:
                turn, own = (int(x) for x in user.split("|"))
                user = None
                turns.append(turn)
                costs.append(own + int(r.cost) + 2 * per_message)
                while costs and sum(costs) > budget:
                    turns.pop(0)
                    costs.pop(0)
                out.append((key[0], turn, turns[0] if turns else None, sum(costs)))
            else:
                user = None
        state.update((user, turns, costs))
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "oldest_turn", "live_tokens"])
        yield frame.astype({"oldest_turn": "Int64"})

    return _messages(stream).groupBy("conv_id").applyInPandasWithState(
        run, "conv_id long, turn long, oldest_turn long, live_tokens long", "waiting string, turns array<long>, costs array<long>", "append", _timeout(idle_ms)
    )


def event_totals(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events(ts, event_type, value) as a stream -> counts and sums per window and type; late rows beyond the watermark are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

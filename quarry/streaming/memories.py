"""Memories on streams: keyed entries and running summaries as state of their conversation, facts in a versioned store.

State lies in the state store, one map entry or list row at a time, and outlives executors with the query's checkpoint.  These operators need
the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).  With `idle_ms` a timer clears a conversation that had no rows for
that processing time; the stream must then be triggered by time, as Spark keeps making batches while timers wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from quarry.functions.text import estimate_tokens_mixed, is_sensitive
from quarry.operators.memory import apply_semantic_ops, pushed_out, shortened
from quarry.sources.versions import VersionedStore

ENTRIES = "conv_id long, version long, category string, key string, value string, created_turn long, updated_turn long, live boolean"
SUMMARIES = "conv_id long, turn long, summary string, evicted long"
FACTS = "category string, key string, value string, importance double, created_at timestamp, updated_at timestamp, recall_count int, last_recalled_at timestamp, embedding array<double>"


class _Idle(StatefulProcessor):
    """One timer a key, set anew whenever rows arrive."""

    idle_ms: int | None = None

    def rearm(self, timers) -> None:
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


class _Entries(_Idle):
    def __init__(self, cap: int, idle_ms: int | None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "category string, key string", "value string, created long, updated long")
        self.version = handle.getValueState("version", "n long")

    def _turn_over(self, key: tuple, old: dict, new: dict) -> pd.DataFrame:
        """State goes from old to new; a row for each entry that changed or went, under the conversation's next version."""
        number = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((number,))
        rows = []
        for k in sorted(old.keys() | new.keys()):
            if k not in new:
                self.entries.removeKey(k)
                rows.append((key[0], number, *k, *old[k], False))
            elif old.get(k) != new[k]:
                self.entries.updateValue(k, new[k])
                rows.append((key[0], number, *k, *new[k], True))
        return pd.DataFrame(rows, columns=["conv_id", "version", "category", "key", "value", "created_turn", "updated_turn", "live"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = {tuple(k): tuple(v) for k, v in self.entries.iterator()}
        new = dict(old)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            k = (r.category, r.key)
            if r.action == "delete":
                new.pop(k, None)
            elif r.action == "upsert":
                turn, was = int(r.turn), new.get(k)
                if was is None:
                    new[k] = (r.value, turn, turn)
                elif was[0] != r.value:
                    new[k] = (r.value, was[1], max(was[2], turn))
        first = sorted(new, key=lambda k: (new[k][2], new[k][1], k[1]), reverse=True)[: self.cap]
        self.rearm(timerValues)
        yield self._turn_over(key, old, {k: new[k] for k in first})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._turn_over(key, {tuple(k): tuple(v) for k, v in self.entries.iterator()}, {})
        self.entries.clear()


def structured_entries(ops: DataFrame, cap: int = 30, idle_ms: int | None = None) -> DataFrame:
    """ops(conv_id, category, key, seq, turn, action, value) as a stream -> the changes of each conversation's entries.

    Operations of a micro-batch act in order of seq, then what exceeds `cap` goes, and the next micro-batch starts from what stayed: as
    `apply_ops` and `evict` batch by batch.  Sensitive operations don't count.  Of an entry's rows the one of greatest version tells
    its value and whether it lives; versions go on after a time-out.  Valid operations are expected (`validate_ops`), an upsert without a value is left out.
    """
    plain = ops.where(~is_sensitive(F.col("key")) & ~F.coalesce(is_sensitive(F.col("value")), F.lit(False)) & ((F.col("action") == "delete") | F.col("value").isNotNull()))
    rows = plain.select("conv_id", "category", "key", F.col("seq").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), "action", "value")
    return rows.groupBy("conv_id").transformWithStateInPandas(_Entries(cap, idle_ms), ENTRIES, "Update", "None" if idle_ms is None else "ProcessingTime")


class _Summaries(_Idle):
    def __init__(self, summarise: Callable, budget: int, cap: int, per_message: int, idle_ms: int | None):
        self.summarise, self.budget, self.cap, self.per_message, self.idle_ms = summarise, budget, cap, per_message, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "turn long, cost long, text string")
        self.held = handle.getListState("held", "cost long, user string, assistant string")
        self.summary = handle.getValueState("summary", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        user = tuple(self.waiting.get()) if self.waiting.exists() else None
        held = [tuple(h) for h in self.held.get()] if self.held.exists() else []
        summary = self.summary.get()[0] if self.summary.exists() else ""
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples():
            if r.role == "user":
                user = (int(r.turn), int(r.cost), r.text)
            elif r.role == "assistant" and user is not None:
                held.append((user[1] + int(r.cost) + 2 * self.per_message, user[2], r.text))
                gone = pushed_out(held, self.budget)
                if gone:
                    summary = shortened(self.summarise, summary, gone, self.cap)
                out.append((key[0], user[0], summary, len(gone)))
                user = None
            else:
                user = None
        if user is None:
            self.waiting.clear()
        else:
            self.waiting.update(user)
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        self.summary.update((summary,))
        self.rearm(timerValues)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "summary", "evicted"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.waiting, self.held, self.summary):
            state.clear()
        return iter(())


def summary_buffer(stream: DataFrame, summarise: Callable, budget: int = 1200, cap: int = 400, per_message: int = 4, idle_ms: int | None = None) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a stream -> conv_id, turn, summary, evicted after each complete turn.

    The state is the user message that waits, the turns within the budget, and the summary of what went.  A later micro-batch must not
    bring earlier turns.  An idle conversation is forgotten without a row and starts anew.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stream.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"), estimate_tokens_mixed(text).alias("cost"))
    return rows.groupBy("conv_id").transformWithStateInPandas(_Summaries(summarise, budget, cap, per_message, idle_ms), SUMMARIES, "Append", "None" if idle_ms is None else "ProcessingTime")


def apply_fact_batch(store: VersionedStore, ops: DataFrame, batch_id: int, name: str = "facts", now: Column | None = None, cap: int | None = 500, retention_days: float = 30) -> bool:
    """One micro-batch of semantic operations on the facts of a store; False if that batch, or a later one, is in the store already.

    Facts and the number of the last batch change in one switch, so a batch that is run again after a failure counts once.
    """
    spark, base = ops.sparkSession, store.current()
    done = store.read(f"{name}_batch", base) if base else None
    if done is not None and done.first()[0] >= batch_id:
        return False
    facts = store.read(name, base) if base else None
    facts = spark.createDataFrame([], FACTS) if facts is None else facts
    changed = apply_semantic_ops(facts, ops, F.current_timestamp() if now is None else now, cap, retention_days)
    store.commit({name: changed, f"{name}_batch": spark.createDataFrame([(batch_id,)], "batch_id long")}, base)
    return True


def semantic_facts(ops: DataFrame, store: VersionedStore, name: str = "facts", cap: int | None = 500, retention_days: float = 30) -> DataStreamWriter:
    """ops(category, key, seq, action, value, importance, embedding) as a stream, applied to a store batch by batch; the writer still has to be started."""
    return ops.writeStream.foreachBatch(lambda rows, batch_id: apply_fact_batch(store, rows, batch_id, name, None, cap, retention_days))

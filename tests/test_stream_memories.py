"""Streamed memories against their batch operators, micro-batch by micro-batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import memory
from quarry.sources.versions import VersionedStore
from quarry.streaming import memories as live

OPS = "conv_id long, category string, key string, seq long, turn long, action string, value string"
SEMANTIC = "category string, key string, seq long, action string, value string, importance double, embedding array<double>"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def _source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def _add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def _run(df, name, path, mode):
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(240)


def test_entries_evict_after_each_batch(rocks, tmp_path):
    rng = random.Random(3)
    batches, seq = [], 0
    for b in range(3):
        rows = []
        for _ in range(40):
            seq += 1
            value = rng.choice(["a", "b", "api_key=sk-abcdefghijklmnop1234"])
            rows.append((rng.randrange(3), rng.choice(["fact", "rule"]), f"k{rng.randrange(7)}", seq, seq, rng.choice(["upsert", "upsert", "delete"]), value))
        batches.append(rows)
    state = rocks.createDataFrame([], "conv_id long, category string, key string, value string, created_turn long, updated_turn long")
    for rows in batches:
        _add(rocks, tmp_path, rows, OPS)
        state = memory.evict(memory.apply_ops(state, rocks.createDataFrame(rows, OPS)), 4)
        kept = [tuple(r) for r in state.select("conv_id", "category", "key", "value", "created_turn", "updated_turn").collect()]
        state = rocks.createDataFrame(kept, state.select("conv_id", "category", "key", "value", "created_turn", "updated_turn").schema)
    _run(live.structured_entries(_source(rocks, tmp_path, OPS), 4), "entries", tmp_path, "update")
    last = {}
    for r in sorted(rocks.table("entries").collect(), key=lambda r: r.version):
        last[r.conv_id, r.category, r.key] = r
    got = {(r.conv_id, r.category, r.key, r.value, r.created_turn, r.updated_turn) for r in last.values() if r.live}
    assert got == set(kept) and len(got) == 12
    assert max(r.version for r in last.values()) == 3


def _fold(old, gone):
    return (old + "+" + ",".join(u[:3] + a[:3] for u, a in gone))[-60:]


def test_summaries_go_on_over_batches(rocks, tmp_path):
    source = rocks.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    for low, high in ((0, 3), (3, 4), (4, 1000)):
        source.where((F.col("turn") >= low) & (F.col("turn") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    _run(live.summary_buffer(_source(rocks, tmp_path, source.schema), _fold, 150, 8), "summaries", tmp_path, "append")
    want = {tuple(r) for r in memory.summary_buffer(memory.pair_turns(source), _fold, 150, 8).collect()}
    assert {tuple(r) for r in rocks.table("summaries").collect()} == want
    assert any(r[3] for r in want)


def test_idle_entries_are_cleared(rocks, tmp_path):
    def wait(n):
        for _ in range(80):
            if rocks.table("idle_entries").count() >= n:
                return
            time.sleep(0.5)

    _add(rocks, tmp_path, [(1, "fact", "k", 1, 1, "upsert", "a")], OPS)
    df = live.structured_entries(_source(rocks, tmp_path, OPS), idle_ms=1500)
    query = df.writeStream.outputMode("update").format("memory").queryName("idle_entries").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        wait(2)  # the entry, then its end
        _add(rocks, tmp_path, [(1, "fact", "k", 2, 9, "upsert", "a")], OPS)
        wait(3)
    finally:
        query.stop()
    got = [(r.version, r.value, r.created_turn, r.live) for r in sorted(rocks.table("idle_entries").collect(), key=lambda r: r.version)]
    assert got[:3] == [(1, "a", 1, True), (2, "a", 1, False), (3, "a", 9, True)]


def test_facts_of_a_stream_are_applied_once(spark, tmp_path):
    batches = [
        [("fact", "a", 1, "upsert", " one ", 0.5, [1.0]), ("fact", "b", 2, "upsert", "two", 0.5, [0.0]), ("rule", "c", 3, "upsert", "no fact", 0.5, [0.0])],
        [("fact", "a", 4, "delete", None, None, None), ("fact", "d", 5, "upsert", "three", 0.9, [1.0])],
        [("fact", "b", 6, "upsert", "2", 0.7, [1.0]), ("fact", "e", 7, "upsert", "wide", 0.7, [1.0])],
    ]
    for rows in batches:
        _add(spark, tmp_path, rows, SEMANTIC)
        time.sleep(1.1)  # files are taken by their time
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    live.semantic_facts(_source(spark, tmp_path, SEMANTIC), store).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(240)
    facts = lambda: sorted((r.key, r.value, r.importance) for r in store.read("facts").collect())
    want = [("b", "2", 0.7), ("d", "three", 0.9), ("e", "wide", 0.7)]
    assert facts() == want and store.current() == 3
    again = spark.createDataFrame([("fact", "b", 8, "delete", None, None, None)], SEMANTIC)
    assert not live.apply_fact_batch(store, again, 2) and facts() == want
    assert live.apply_fact_batch(store, again, 3) and facts() == want[1:]

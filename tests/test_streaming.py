import time

from quarry.operators import memory
from quarry.streaming import conversations as live

SF = "/root/testdata/sf0.001"


def _run(spark, build, name, tmp_path):
    schema = spark.read.parquet(f"{SF}/conversations.parquet").schema
    spark.read.parquet(f"{SF}/conversations.parquet").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_budget_windows(spark, tmp_path):
    got = _run(spark, lambda s: live.budget_windows(s, 700), "windows", tmp_path)
    turns = memory.pair_turns(spark.read.parquet(f"{SF}/conversations.parquet"))
    want = {(r.conv_id, r.turn, r.oldest_turn, r.live_tokens) for r in memory.window_membership(turns, 700).collect()}
    assert got == want


def test_extraction_batches(spark, tmp_path):
    got = _run(spark, live.extraction_batches, "batches", tmp_path)
    turns = memory.pair_turns(spark.read.parquet(f"{SF}/conversations.parquet"))
    closed = {}
    for r in memory.extraction_batches(turns).where("batch > 0").collect():
        closed.setdefault((r.conv_id, r.batch), []).append(r.turn)
    assert got == {(c, b, min(t), max(t)) for (c, b), t in closed.items()}


def test_state_of_idle_conversations_expires(spark, tmp_path):
    """A conversation that was idle is forgotten: its numbering starts anew."""
    schema = "conv_id long, turn long, role string, text string"

    def add(*rows):
        spark.createDataFrame([(c, t, r, "x" * 4000) for c, t, r in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    add((1, 0, "user"), (1, 1, "assistant"))
    stream = live.extraction_batches(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle_ms=1500)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table("idle").count():
                break
            time.sleep(0.5)
        time.sleep(6)  # several batches without data, in one of which the state times out
        add((1, 2, "user"), (1, 3, "assistant"))
        for _ in range(60):
            if spark.table("idle").count() > 1:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.table("idle").collect()) == [(1, 1, 0, 0), (1, 1, 2, 2)]


def test_event_totals(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "view", 1.0), ("2024-01-01 00:50:00", "view", 2.0), ("2024-01-01 01:10:00", "buy", 3.0), ("2024-01-01 05:00:00", "end", 0.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    out = live.event_totals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    out.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((str(r.window.start), r.event_type, r.n, r.total) for r in spark.table("totals").collect())
    assert got[:2] == [("2024-01-01 00:00:00", "view", 2, 3.0), ("2024-01-01 01:00:00", "buy", 1, 3.0)]

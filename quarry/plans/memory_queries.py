"""Registered queries on conversations, memories and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import memory
from quarry.functions import text as T
from quarry.plans.text_queries import EST, query, table
from quarry.sources import documents as sources

_TURNS = """
turns AS (SELECT conv_id, turn, text AS user, assistant FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS assistant FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""
_COST = f"({EST.format('user').replace('user', 't.user')} + {EST.format('assistant')} + 8)"


def _turns(spark, sf_dir):
    return memory.pair_turns(table(spark, sf_dir, "conversations"))


@query(f"WITH {_TURNS} SELECT * FROM turns t")
def pair_turns(spark, sf_dir):
    return _turns(spark, sf_dir)


@query(f"WITH {_TURNS} SELECT conv_id, turn FROM turns t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_turns(spark, sf_dir):
    return memory.recent(_turns(spark, sf_dir), "conv_id", "turn", 3).select("conv_id", "turn")


@query("SELECT l_suppkey AS task_id, l_orderkey * 10000000 + l_extendedprice * 100 AS round FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10000000 + l_extendedprice * 100 DESC) <= 5")
def recent_rounds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task_id"), (F.col("l_orderkey") * 10000000 + F.col("l_extendedprice") * 100).alias("round"))
    return memory.recent(rows, "task_id", "round", 5)


@query(f"WITH {_TURNS}, c AS (SELECT conv_id, turn, {_COST} AS cost FROM turns t), s AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM c) SELECT * FROM s WHERE used <= 700")
def token_budget_turns(spark, sf_dir):
    return memory.token_budget_turns(_turns(spark, sf_dir), 700).select("conv_id", "turn", "cost", "used")


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, turn, {_COST} AS cost FROM turns t), r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM c),
m AS (SELECT a.conv_id, a.turn, min(b.turn) AS oldest_turn, coalesce(CAST(sum(b.cost) AS BIGINT), 0) AS live_tokens FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND a.total - (b.total - b.cost) <= 700 GROUP BY ALL)
SELECT * FROM m""")
def window_membership(spark, sf_dir):
    return memory.window_membership(_turns(spark, sf_dir), 700)


_TOOL = """CASE WHEN role = 'assistant' THEN '{"id":"' || conv_id || '-' || turn || '","name":"find","ok":"true","data":"' || repeat('x', CAST(length(text) AS INT)) || '"}' ELSE text END"""


@query(f"""
WITH m AS (SELECT conv_id AS session_id, turn AS msg_seq, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, {_TOOL} AS content FROM conversations),
o AS (SELECT *, role = 'tool' AND session_id % 2 = 0 AND row_number() OVER (PARTITION BY session_id, role = 'tool' ORDER BY msg_seq DESC) > 1 AS was_folded FROM m),
f AS (SELECT session_id, msg_seq, was_folded, content, CASE WHEN was_folded THEN '{{"id":"' || session_id || '-' || msg_seq || '","name":"find","ok":"true","data":"[folded]"}}' ELSE content END AS folded FROM o)
SELECT session_id, msg_seq, was_folded, CAST(floor(length(content) / 4) - floor(length(folded) / 4) AS BIGINT) AS tokens_saved FROM f""")
def fold_old_results(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tool = F.concat(F.lit('{"id":"'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('","name":"find","ok":"true","data":"'), F.expr("repeat('x', length(text))"), F.lit('"}'))
    rows = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_seq"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", tool).otherwise(F.col("text")).alias("content"))
    rows = rows.withColumn("token_limit", F.lit(1000)).withColumn("context_tokens", F.when(F.col("session_id") % 2 == 0, 900).otherwise(100))
    return memory.fold_old_results(rows, keep=1).select("session_id", "msg_seq", "was_folded", "tokens_saved")


_USE = "CASE WHEN event_id % 5 = 0 THEN CAST(floor(value) AS BIGINT) END"


@query(f"""
WITH r AS (SELECT user_id AS session_id, event_id AS seq, event_id % 13 AS estimate, {_USE} AS usage FROM events),
g AS (SELECT *, count(usage) OVER (PARTITION BY session_id ORDER BY seq) AS span FROM r)
SELECT session_id, seq, CAST(coalesce(sum(CASE WHEN usage IS NULL THEN estimate ELSE 0 END) OVER w, 0) + coalesce(max(usage) OVER w, 0) AS BIGINT) AS context_tokens FROM g WINDOW w AS (PARTITION BY session_id, span ORDER BY seq)""")
def running_context_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 13).alias("estimate"), F.when(F.col("event_id") % 5 == 0, F.floor("value")).alias("usage"))
    return memory.running_context_tokens(rows).select("session_id", "seq", "context_tokens")


@query("""
SELECT user_id AS session_id, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN event_type = 'click' THEN 500 ELSE event_id % 100 + event_id % 7 END) AS BIGINT) AS total_tokens FROM events GROUP BY 1""")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), F.when(F.col("event_type") == "click", 500).alias("total_tokens"))
    return memory.usage_totals(rows)


# Memories: an entry per user and event type; accesses are recalls, the last one the last recall.
_STATE = """
st AS (SELECT user_id || ':' || event_type AS key, user_id, min(ts) AS created_at, min(ts) AS updated_at, count(*) - 1 AS recall_count, CASE WHEN count(*) > 1 THEN max(ts) END AS last_recalled_at, round(least(1.0, avg(value) / 200), 6) AS importance FROM events GROUP BY ALL),
sc AS (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '2024-02-20') - epoch_us(coalesce(last_recalled_at, updated_at))) / 86400e6) / (30.0 * (1 + importance) * (1 + least(recall_count, 5) / 5.0)) AS score FROM st)"""


def _state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "user_id").agg(
        F.min("ts").alias("created_at"), F.min("ts").alias("updated_at"), (F.count("*") - 1).alias("recall_count"), F.when(F.count("*") > 1, F.max("ts")).alias("last_recalled_at"), F.round(F.least(F.lit(1.0), F.avg("value") / 200), 6).alias("importance")
    )
    stamps = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if "timestamp" in t else c for c, t in stamps.items()])


NOW = "timestamp'2024-02-20 00:00:00'"


@query(f"WITH {_STATE} SELECT key, round(score, 6) AS score FROM sc")
def forgetting_score(spark, sf_dir):
    return _state(spark, sf_dir).select("key", F.round(memory.forgetting_score(F.expr(NOW), 30), 6).alias("score"))


@query(f"WITH {_STATE} SELECT key, user_id, round(score, 6) AS score FROM sc WHERE score < 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score, updated_at DESC, key DESC) <= 3")
def prune(spark, sf_dir):
    return memory.prune(_state(spark, sf_dir), F.expr(NOW), 30, 3, "key", partition="user_id").select("key", "user_id", F.round("score", 6).alias("score"))


@query(f"WITH {_STATE} SELECT key, round(score, 6) AS score FROM sc ORDER BY score, updated_at DESC, key DESC LIMIT 50")
def retain_top(spark, sf_dir):
    scored = _state(spark, sf_dir).withColumn("score", memory.forgetting_score(F.expr(NOW), 30))
    return memory.retain_top(scored, 50, "key").select("key", F.round("score", 6).alias("score"))


@query("""
SELECT q.vec_id AS query_id, d.vec_id AS key, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, d.label DESC, d.vec_id DESC) AS rank
FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 WHERE round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) >= 0.35 QUALIFY rank <= 3""")
def recall(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    state = e.select(F.col("vec_id").alias("key"), "embedding", F.col("label").alias("updated_at"))
    return memory.recall(state, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), digits=6)


@query("""
WITH st AS (SELECT user_id || ':' || event_type AS key, count(*) AS recall_count FROM events WHERE event_id % 2 = 0 GROUP BY 1), h AS (SELECT DISTINCT user_id || ':' || event_type AS key FROM events WHERE event_id % 2 = 1 AND value > 100)
SELECT st.key, recall_count + CASE WHEN h.key IS NULL THEN 0 ELSE 1 END AS recall_count, h.key IS NOT NULL AS recalled FROM st LEFT JOIN h USING (key)""")
def record_recall(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    state = e.where("event_id % 2 = 0").groupBy("key").agg(F.count("*").alias("recall_count")).withColumn("last_recalled_at", F.lit(None).cast("timestamp"))
    out = memory.record_recall(state, e.where("event_id % 2 = 1 and value > 100"), F.expr(NOW))
    return out.select("key", "recall_count", F.col("last_recalled_at").isNotNull().alias("recalled"))


_OPS = """
ops AS (SELECT user_id AS conv_id, event_id AS seq, event_id AS turn, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, 'fact' AS category,
  CASE WHEN event_id % 17 = 0 THEN 'Bad Key' WHEN event_id % 19 = 0 THEN 'api_key' ELSE 'k' || (event_id % 4) END AS key, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE 'v' || CAST(floor(value / 60) AS BIGINT) END AS value, value / 400 AS importance FROM events)"""


def _ops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").alias("conv_id"), n.alias("seq"), n.alias("turn"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("action"), F.lit("fact").alias("category"),
        F.when(n % 17 == 0, "Bad Key").when(n % 19 == 0, "api_key").otherwise(F.concat(F.lit("k"), (n % 4).cast("string"))).alias("key"),
        F.when(n % 23 == 0, " ").otherwise(F.concat(F.lit("v"), F.floor(F.col("value") / 60).cast("string"))).alias("value"), (F.col("value") / 400).alias("importance"),
    )


@query(f"""
WITH {_OPS} SELECT seq, CASE WHEN NOT regexp_matches(key, '^[a-z][a-z0-9_.-]*$') THEN 'key' WHEN action = 'upsert' AND trim(value) = '' THEN 'blank value' WHEN importance NOT BETWEEN 0 AND 1 THEN 'importance'
  WHEN count(*) OVER (PARTITION BY conv_id) > 80 THEN 'batch' END AS reason FROM ops""")
def validate_ops(spark, sf_dir):
    return memory.validate_ops(_ops(spark, sf_dir), most=80).select("seq", "reason")


@query(f"""
WITH {_OPS}, l AS (SELECT *, sum(CASE WHEN action = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, key ORDER BY seq) AS life FROM ops WHERE key <> 'api_key'),
u AS (SELECT *, lag(value) OVER (PARTITION BY conv_id, key, life ORDER BY seq) AS old FROM l WHERE action = 'upsert'),
m AS (SELECT conv_id, key, max(life) AS life FROM l GROUP BY ALL),
s AS (SELECT conv_id, category, key, arg_max(value, seq) AS value, min(turn) AS created_turn, max(turn) FILTER (old IS NULL OR old <> value) AS updated_turn FROM u JOIN m USING (conv_id, key, life) GROUP BY ALL)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY updated_turn DESC, created_turn DESC, key DESC) <= 3""")
def apply_ops(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    empty = spark.createDataFrame([], "conv_id long, category string, key string, value string, created_turn long, updated_turn long")
    return memory.evict(memory.apply_ops(empty, ops), 3)


@query(f"""
WITH RECURSIVE {_TURNS},
said AS (SELECT conv_id, turn, user || CASE WHEN turn % 14 = 0 THEN ' please remember this' ELSE '' END AS user, assistant || CASE WHEN turn % 4 = 2 THEN ' tool' ELSE '' END AS assistant FROM turns),
costs AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, regexp_matches(user, '{T.MEMORY_SIGNAL}') AS signal, {_COST} - 8 AS own, len(regexp_extract_all(lower(assistant), 'tool')) AS tools FROM said t),
r(conv_id, pos, cost, named, closed) AS (
    SELECT conv_id, pos, own, tools, signal OR (own >= 300 AND (tools >= 2 OR tools = 0)) FROM costs WHERE pos = 1
    UNION ALL
    SELECT c.conv_id, c.pos, q.cost, q.named, c.signal OR (q.cost >= 300 AND (q.named >= 2 OR c.tools = 0)) FROM r JOIN costs c ON c.conv_id = r.conv_id AND c.pos = r.pos + 1,
        LATERAL (SELECT CASE WHEN r.closed THEN 0 ELSE r.cost END + c.own AS cost, CASE WHEN r.closed THEN 0 ELSE r.named END + c.tools AS named) q)
SELECT conv_id, turn, CAST(CASE WHEN sum(CAST(closed AS INT)) OVER (PARTITION BY conv_id ORDER BY pos DESC) > 0 THEN coalesce(sum(CAST(closed AS INT)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 ELSE 0 END AS BIGINT) AS batch
FROM r JOIN costs USING (conv_id, pos)""")
def extraction_batches(spark, sf_dir):
    said = lambda c, text, when: F.concat(c, F.when(when, F.lit(text)).otherwise(F.lit("")))
    turns = _turns(spark, sf_dir).withColumns({"user": said("user", " please remember this", F.col("turn") % 14 == 0), "assistant": said("assistant", " tool", F.col("turn") % 4 == 2)})
    return memory.extraction_batches(turns, tokens=300, mentions=2)


@query("""
WITH h AS (SELECT user_id AS query_id, event_type || (event_id % 9) AS name, min(event_id) AS rank FROM events WHERE event_type <> 'view' GROUP BY ALL), s AS (SELECT DISTINCT user_id AS query_id, event_type || (event_id % 9) AS name FROM events WHERE value > 150)
SELECT query_id, name, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, name) AS place FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = h.query_id AND s.name = h.name) QUALIFY place <= 5""")
def dedupe_surfaced(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.concat("event_type", (F.col("event_id") % 9).cast("string")).alias("name"), F.col("event_id").alias("rank"), "value", "event_type")
    known = e.where("event_type <> 'view'").select("name").distinct()
    return memory.dedupe_surfaced(e.select("query_id", "name", "rank"), e.where("value > 150").select("query_id", "name").distinct(), known)


@query("""
SELECT user_id AS conv_id, 'Memory: {' || string_agg('"' || event_type || '":"' || n || '"', ',' ORDER BY event_type) || '}' AS context FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def memory_context(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id"), F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return memory.memory_context(rows, "Memory: ")


@query("""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, coalesce(lead(text) OVER w, '') AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, text, answer FROM c WHERE role = 'user' AND next_role = 'assistant'),
m AS (SELECT conv_id, turn, 0 AS i, 'user' AS role, text FROM t UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM t),
r AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL),
e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT conv_id, 0 AS section, 0::BIGINT AS position, 'system' AS role, 'State: {"entries":[' || string_agg('{"category":"messages","key":"' || role || '","value":"' || n || '"}', ',' ORDER BY role) || ']}' AS content FROM r GROUP BY 1
UNION ALL SELECT conv_id, 1, 0, 'system', 'Summary: ' || max(turn) || ' turns' FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, 2, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1, role, text FROM m
UNION ALL SELECT user_id, 3, 0, 'system', 'Facts: {"facts":[' || string_agg('{"key":"' || event_type || '","similarity":' || (n % 16) / 16.0::DOUBLE || ',"updated_at":"' || n % 28 || '","value":"' || n || '"}', ',' ORDER BY n DESC, event_type) || ']}' FROM e GROUP BY 1
UNION ALL SELECT user_id, 4, 0, 'system', 'Experiences: {"experiences":[' || string_agg('{"id":"' || event_type || '","lessons":["' || n || '"],"outcome":"success","pitfalls":[],"similarity":' || (n % 16) / 16.0::DOUBLE || ',"strategy":null,"summary":"' || n || ' times","task":"' || event_type || '"}', ',' ORDER BY n DESC, event_type) || ']}' FROM e GROUP BY 1""")
def context_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    text = lambda c: F.col(c).cast("string")
    entries = messages.groupBy("conv_id", F.col("role").alias("key")).agg(F.count("*").cast("string").alias("value")).withColumn("category", F.lit("messages"))
    summaries = messages.groupBy("conv_id").agg(F.concat(F.max("turn").cast("string"), F.lit(" turns")).alias("summary"))
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conv_id"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    seen = seen.withColumns({"rank": -F.col("n"), "score": (F.col("n") % 16) / 16, "value": text("n"), "updated_at": (F.col("n") % 28).cast("string")})
    past = seen.select("conv_id", "rank", "score", F.col("key").alias("id"), F.col("key").alias("task"), F.lit("success").alias("outcome"), F.concat("value", F.lit(" times")).alias("summary"))
    past = past.withColumns({"strategy": F.lit(None).cast("string"), "lessons": F.array((-F.col("rank")).cast("string")), "pitfalls": F.array().cast("array<string>")})
    prefixes = {"structured": "State: ", "summary": "Summary: ", "facts": "Facts: ", "episodes": "Experiences: "}
    return memory.context_messages(prefixes, entries, summaries, memory.pair_turns(messages), seen, past)


@query("""
WITH st AS (SELECT event_type AS category, user_id || '' AS key, count(*) AS n FROM events GROUP BY ALL)
SELECT category, key, n, EXISTS (SELECT 1 FROM events e WHERE e.event_type = st.category AND e.user_id || '' = st.key AND e.value > 180) AS removed FROM st""")
def forget(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "category").withColumn("key", F.col("user_id").cast("string"))
    kept, removed = memory.forget(e.groupBy("category", "key").agg(F.count("*").alias("n")), e.where("value > 180"))
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))


@query("""
SELECT c_nationkey AS nation, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(c_name, '#', chr(92) || '|') || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS markdown FROM customer GROUP BY 1""")
def table_to_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.replace("c_name", F.lit("#"), F.lit("|")).alias("name"), F.col("c_mktsegment").alias("segment"))
    return sources.table_to_markdown(c, "c_nationkey", "c_custkey", ["name", "segment"]).select(F.col("c_nationkey").alias("nation"), "markdown")


@query("""
WITH n AS (SELECT CASE WHEN s = '' THEN 'memory' ELSE s END AS slug, p_name, p_partkey FROM (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s, p_name, p_partkey FROM part))
SELECT slug, arg_max(p_name, p_partkey) AS name FROM n GROUP BY slug""")
def upsert_notes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    return sources.upsert_notes(p.where("false"), p).select("slug", "name")


@query("""
WITH o AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not json' ELSE props END AS line FROM events ORDER BY event_id DESC LIMIT 8) SELECT event_id AS seq, line FROM o WHERE line <> 'not json'""")
def recent_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.col("props")).alias("line"))
    return sources.recent_events(e, 8)

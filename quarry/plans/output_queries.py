"""Registered queries on model output and on what it changes in memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import memory
from quarry.plans.memory_queries import _COST, _TURNS, NOW
from quarry.plans.text_queries import _SIGNS, _VIS, _redacted, query, table

_REPLY = """CASE event_id % 5 WHEN 0 THEN '{"tool_calls":[{"name":"' || event_type || '"}]}' WHEN 1 THEN '{"final_answer":"' || event_type || '"}'
  WHEN 2 THEN '{"tool_calls":[{}],"final_answer":"x"}' WHEN 3 THEN 'no object ' || event_type ELSE '{"tool_calls":[]}' END"""


@query(f"""
WITH r AS (SELECT event_id, try_cast({_REPLY} AS JSON) AS j FROM events),
k AS (SELECT event_id, j IS NOT NULL AS object, coalesce(json_array_length(j, '$.tool_calls'), 0) > 0 AS calls, json_extract_string(j, '$.final_answer') IS NOT NULL AS answer FROM r)
SELECT event_id, CASE WHEN NOT object OR calls = answer THEN 'invalid' WHEN calls THEN 'tool_calls' ELSE 'final_answer' END AS kind,
  CASE WHEN NOT object THEN 'not a JSON object' WHEN calls AND answer THEN 'both calls and answer' WHEN NOT calls AND NOT answer THEN 'neither calls nor answer' END AS reason FROM k""")
def route_turns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.route_turn(F.expr(_REPLY)).alias("r")).select("event_id", "r.kind", "r.reason")


_EXTRACTED = """'{"entities":[{"name":" ' || c_name || '  x","type":"' || lower(c_mktsegment) || '","description":"d' || CAST(c_nationkey AS STRING) || '"},{"name":" ","type":"x"},{"name":"n' || CAST(c_nationkey AS STRING)
  || '"}],"relationships":[{"source":"' || c_name || '","target":"n' || CAST(c_nationkey AS STRING) || '","strength":"' || CAST(c_custkey % 15 AS STRING) || '"},{"source":"","target":"y"},{"source":"a","target":"b","description":"c","strength":"high"}]}'"""


def _items(name: str) -> str:
    return f"e AS (SELECT c_custkey, unnest(CAST(json_extract(CAST({_EXTRACTED} AS JSON), '$.{name}') AS JSON[])) AS e FROM customer)"


def _plain(name: str) -> str:
    return f"trim(regexp_replace(upper(coalesce(json_extract_string(e, '$.{name}'), '')), '\\s+', ' ', 'g'))"


@query(f"""
WITH {_items("entities")}
SELECT c_custkey, {_plain("name")} AS name, coalesce(nullif({_plain("type")}, ''), 'UNKNOWN') AS entity_type, coalesce(json_extract_string(e, '$.description'), '') AS description FROM e WHERE {_plain("name")} <> ''""")
def parse_entities(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.parse_entities(F.expr(_EXTRACTED))).alias("e")).select("c_custkey", "e.*")


@query(f"""
WITH {_items("relationships")}
SELECT c_custkey, {_plain("source")} AS source, {_plain("target")} AS target, coalesce(json_extract_string(e, '$.description'), '') AS description,
  least(10.0, greatest(1.0, coalesce(try_cast(json_extract_string(e, '$.strength') AS DOUBLE), 5.0))) AS strength FROM e WHERE {_plain("source")} <> '' AND {_plain("target")} <> ''""")
def parse_relationships(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.parse_relationships(F.expr(_EXTRACTED))).alias("r")).select("c_custkey", "r.*")


_SECRETIVE = "concat('Bearer abc.def= ', text)"


@query(f"""SELECT doc_id, '{{"api_key": "[REDACTED]", "note": ' || CAST(to_json(substring({_redacted(_SECRETIVE)}, 1, 500)) AS VARCHAR) || ', "n": ' || doc_id || '}}' AS clean FROM documents""")
def sanitize_json(spark, sf_dir):
    whole = F.to_json(F.struct(F.lit("ab12").alias("api_key"), F.expr(_SECRETIVE).alias("note"), F.col("doc_id").alias("n")))
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitize_json(whole).alias("clean"))


@query(f"""
WITH v AS (SELECT doc_id, length(text) AS size, doc_id % 3 AS images, n_chars % 4 AS tables, {_VIS} AS v FROM documents),
n AS (SELECT *, length(v) AS n, length(v) - length(regexp_replace(v, '[\\p{{L}}\\p{{N}}{T.CJK}{_SIGNS}]', '', 'g')) AS good, length(v) - length(regexp_replace(v, '[\\x{{FFFD}}\\x00-\\x1F\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) AS bad FROM v)
SELECT doc_id, (size < 400 AND images >= 1) OR images >= 2 OR tables >= 2 OR (size >= 400 AND n > 0 AND greatest(0.0, (good - bad) / CAST(n AS DOUBLE)) < 0.99) AS again FROM n""")
def needs_reprocessing(spark, sf_dir):
    again = T.needs_reprocessing(F.col("text"), F.col("doc_id") % 3, F.col("n_chars") % 4, min_chars=400, min_quality=0.99)
    return table(spark, sf_dir, "documents").select("doc_id", again.alias("again"))


@query("SELECT item_id, 'Q: 1 + 1?' || chr(10) || 'A: 2' || chr(10) || chr(10) || text AS few, text || chr(10) || 'Step by step:' AS zero FROM benchmark")
def build_prompt(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.build_prompt(text, ["Q: 1 + 1?\nA: 2"]).alias("few"), T.build_prompt(text, trigger="Step by step:").alias("zero"))


_OUTCOME = "CASE WHEN turn % 3 = 0 THEN 'success' WHEN turn % 3 = 1 THEN 'failure' END"


@query(f"""
WITH {_TURNS}, r AS (SELECT conv_id * 1000 + turn AS id, conv_id % 7 = 0 AS error, conv_id % 5 = 0 AS bare, CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE concat(t.user, ' password: ab12') END AS task, {_OUTCOME} AS said,
  CASE WHEN turn % 8 = 2 THEN '' ELSE assistant END AS summary, CASE WHEN turn % 4 = 0 THEN concat('token: zz99 ', t.user) END AS strategy, concat('api_key = 12345 ', assistant) AS lesson, t.user AS pitfall FROM turns t),
o AS (SELECT *, CASE WHEN error THEN 'failure' WHEN bare THEN 'partial' ELSE coalesce(said, 'partial') END AS outcome FROM r)
SELECT id, substring({_redacted("task")}, 1, 2000) AS task, outcome,
  CASE WHEN bare THEN CASE WHEN error THEN '{memory.FAILED[0]}' ELSE '{memory.UNREFLECTED[0]}' END ELSE coalesce(nullif(substring({_redacted("summary")}, 1, 800), ''), '{memory.NO_SUMMARY}') END AS summary,
  CASE WHEN bare THEN CASE WHEN error THEN '{memory.FAILED[1]}' ELSE '{memory.UNREFLECTED[1]}' END ELSE coalesce(substring({_redacted("strategy")}, 1, 800), '{memory.NO_STRATEGY}') END AS strategy,
  CASE WHEN bare THEN '' ELSE concat_ws('|', substring({_redacted("lesson")}, 1, 300), '2', '4', '5') END AS lessons,
  CASE WHEN bare THEN CASE WHEN error THEN substring({_redacted("pitfall")}, 1, 300) ELSE concat('{memory.UNREFLECTED[2]}', substring({_redacted("pitfall")}, 1, 240)) END ELSE substring({_redacted("pitfall")}, 1, 300) END AS pitfalls,
  CAST(CASE outcome WHEN 'failure' THEN 0.7 WHEN 'success' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS importance FROM o WHERE trim(task) <> ''""")
def record_episodes(spark, sf_dir):
    runs = memory.pair_turns(table(spark, sf_dir, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 9 == 0, " ").otherwise(F.concat("user", F.lit(" password: ab12"))).alias("task"), F.expr(_OUTCOME).alias("outcome"),
        (F.col("conv_id") % 7 == 0).alias("error"), F.when(F.col("conv_id") % 5 != 0, F.when(F.col("turn") % 8 == 2, "").otherwise(F.col("assistant"))).alias("summary"), F.expr(NOW).alias("created_at"),
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("token: zz99 "), "user")).alias("strategy"), F.array(F.concat(F.lit("api_key = 12345 "), "assistant"), *[F.lit(x) for x in ("2", " ", "4", "5", "6")]).alias("lessons"),
        F.array("user").alias("pitfalls"), F.col("user").alias("error_text"), F.col("user").alias("reflection_error"),
    )
    done = memory.record_episodes(runs).withColumns({c: F.array_join(c, "|") for c in ("lessons", "pitfalls")})
    return done.select("id", "task", "outcome", "summary", "strategy", "lessons", "pitfalls", "importance")


@query("""
WITH st AS (SELECT user_id || ':' || event_type AS key, 'v' || count(*) % 3 AS value, CAST(0.5 AS DOUBLE) AS importance, count(*) AS recall_count FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type),
o AS (SELECT event_id AS seq, user_id || ':' || event_type AS key, event_id % 10 = 1 AS gone, 'v' || event_id % 3 AS value, CAST(CASE WHEN event_id % 5 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS importance FROM events WHERE event_id % 2 = 1 AND event_id % 11 <> 0 AND event_id % 19 <> 0),
u AS (SELECT key, arg_max(value, seq) AS value, arg_max(importance, seq) AS importance FROM o WHERE NOT gone GROUP BY key),
k AS (SELECT * FROM st WHERE key NOT IN (SELECT key FROM o WHERE gone)),
done AS (
  SELECT key, coalesce(u.value, k.value) AS value, coalesce(u.importance, k.importance) AS importance, coalesce(recall_count, 0) AS recall_count, recall_count IS NULL AS created_now,
    u.value IS NOT NULL AND (u.value IS DISTINCT FROM k.value OR u.importance IS DISTINCT FROM k.importance) AS updated_now FROM k FULL JOIN u USING (key))
SELECT * FROM done ORDER BY CASE WHEN updated_now THEN 0 ELSE 1 / ((1 + importance) * (1 + least(recall_count, 5) / 5.0)) END, key DESC LIMIT 60""")
def apply_semantic_ops(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    n, vector = F.col("event_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding")
    numbered = lambda c: F.concat(F.lit("v"), (c % 3).cast("string")).alias("value")
    long_ago, none = F.expr("timestamp'2024-01-01 00:00:00'"), F.lit(None).cast("timestamp")
    state = e.where("event_id % 2 = 0").groupBy("key").agg(F.count("*").alias("recall_count"))
    state = state.select(F.lit("fact").alias("category"), "key", numbered(F.col("recall_count")), F.lit(0.5).alias("importance"), long_ago.alias("created_at"), long_ago.alias("updated_at"), "recall_count", none.alias("last_recalled_at"), vector)
    ops = e.where("event_id % 2 = 1").select(
        n.alias("seq"), F.when(n % 11 == 0, "preference").otherwise("fact").alias("category"), F.when(n % 19 == 0, "api_key").otherwise(F.col("key")).alias("key"),
        F.when(n % 10 == 1, "delete").otherwise("upsert").alias("action"), numbered(n), F.when(n % 5 == 0, 0.9).otherwise(0.5).alias("importance"), vector,
    )
    now = F.expr(NOW)
    return memory.apply_semantic_ops(state, ops, now, cap=60, retention_days=1e6).select("key", "value", "importance", "recall_count", (F.col("created_at") == now).alias("created_now"), (F.col("updated_at") == now).alias("updated_now"))


def _count_gone(summary: str, gone: list) -> str:
    """In place of a model: how many turns went so far."""
    return str(int(summary or 0) + len(gone))


@query(f"""
WITH {_TURNS}, c AS (SELECT conv_id, turn, {_COST} AS cost FROM turns t), r AS (SELECT *, sum(cost) OVER w AS total, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT a.conv_id, a.turn, a.place - count(b.turn) AS gone FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND a.total - (b.total - b.cost) <= 200 GROUP BY a.conv_id, a.turn, a.place)
SELECT conv_id, turn, CASE WHEN gone > 0 THEN CAST(gone AS VARCHAR) ELSE '' END AS summary, gone - lag(gone, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS evicted FROM g""")
def summary_buffer(spark, sf_dir):
    return memory.summary_buffer(memory.pair_turns(table(spark, sf_dir, "conversations")), _count_gone, budget=200)

"""Registered queries on retrieval, evaluation and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import communities, evaluation, graph, ivf, retrieval
from quarry.plans.text_queries import TOKENS, query, table

# The stated query set of vector searches: every row whose id is divisible by 50, against all rows.
_DENSE = """
scored AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
           FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 50 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _dense(spark, sf_dir, k):
    return retrieval.dense_search(*_vectors(spark, sf_dir), k, digits=6)


@query(f"WITH {_DENSE.format(k=3)} SELECT query_id, doc_id, score, rank FROM dense")
def dense_search(spark, sf_dir):
    return _dense(spark, sf_dir, 3)


@query()
def ann_search(spark, sf_dir):
    return ivf.ann_search(*_vectors(spark, sf_dir), 10)


_BM25 = f"""
t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM t),
p AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM t) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p GROUP BY token)"""
_BM25_HITS = """
q AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({tokens}) AS token FROM {source}) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 6) AS score
      FROM q JOIN p USING (token) JOIN idf USING (token) JOIN dl USING (doc_id) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


@query(f"WITH {_BM25} SELECT token, df, round(idf, 9) AS idf FROM idf")
def bm25_index(spark, sf_dir):
    index = retrieval.bm25_index(table(spark, sf_dir, "documents"))
    return index["idf"].select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_BM25}, {_BM25_HITS.format(tokens=TOKENS.format('text'), source='(SELECT item_id AS query_id, text FROM benchmark)', k=3)} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_search(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_search(table(spark, sf_dir, "documents"), queries, 3, digits=6)


_RRF = """
lists AS ({lists}),
f AS (SELECT query_id, doc_id, list_id, min(rank) AS r FROM lists GROUP BY ALL),
u AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 9) AS score, min(list_id * 100000 + r) AS seen, min(r) FILTER (list_id = 0) AS r0, min(r) FILTER (list_id = 1) AS r1, min(r) FILTER (list_id = 2) AS r2 FROM f GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM u QUALIFY rank <= {k})"""


@query(f"""
WITH {_DENSE.format(k=20)}, {_RRF.format(lists="SELECT query_id, 0 AS list_id, rank, doc_id FROM dense WHERE doc_id % 2 = 0 UNION ALL SELECT query_id, 1, 21 - rank, doc_id FROM dense", k=5)}
SELECT query_id, doc_id, score, rank, concat(coalesce(CAST(r0 AS VARCHAR), '-'), ',', coalesce(CAST(r1 AS VARCHAR), '-')) AS ranks FROM fused""")
def rrf(spark, sf_dir):
    hits = _dense(spark, sf_dir, 20)
    lists = hits.where("doc_id % 2 = 0").select("query_id", F.lit(0).alias("list_id"), "rank", "doc_id").unionByName(hits.select("query_id", F.lit(1).alias("list_id"), (21 - F.col("rank")).alias("rank"), "doc_id"))
    fused = retrieval.rrf(lists, 2, top=5)
    return fused.select("query_id", "doc_id", "score", "rank", F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",", "-").alias("ranks"))


@query(f"""
WITH {_BM25}, {_BM25_HITS.format(tokens=TOKENS.format('text'), source='(SELECT item_id AS query_id, text FROM benchmark)', k=9)},
ds AS (SELECT q.item_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id CROSS JOIN embeddings d),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 9),
{_RRF.format(lists="SELECT query_id, 0 AS list_id, rank, doc_id FROM de UNION ALL SELECT query_id, 1, rank, doc_id FROM bm", k=3)}
SELECT query_id, doc_id, score, rank FROM fused""")
def hybrid_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return retrieval.hybrid_search(table(spark, sf_dir, "documents"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, 3).drop("ranks")


_REL = "round(1.0 / (1 + abs(query_id - doc_id) % 97), 9)"


@query(f"""
WITH {_DENSE.format(k=9)}, r AS (SELECT query_id, doc_id, rank AS old_rank, {_REL} AS relevance FROM dense)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, old_rank) AS rank, old_rank - rank AS moved FROM r QUALIFY rank <= 3""")
def rerank(spark, sf_dir):
    hits = _dense(spark, sf_dir, 9).select("query_id", "doc_id", "rank")
    scores = hits.select("query_id", "doc_id", F.round(1.0 / (1 + F.abs(F.col("query_id") - F.col("doc_id")) % 97), 9).alias("relevance"))
    return retrieval.rerank(hits, scores, 3)


@query(f"""
WITH {_BM25}, sub AS (SELECT item_id * 1000 + i AS query_id, string_split(text, '. ')[i + 1] AS text FROM benchmark, unnest(range(0, len(string_split(text, '. ')))) AS r(i)),
{_BM25_HITS.format(tokens=TOKENS.format('text'), source='sub', k=3).replace("bm AS (SELECT *", "z AS (SELECT * FROM s UNION ALL SELECT query_id, doc_id, 0 FROM (SELECT DISTINCT query_id FROM sub) u CROSS JOIN documents d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = u.query_id AND s.doc_id = d.doc_id)), bm AS (SELECT *").replace("FROM s QUALIFY", "FROM z QUALIFY")},
{_RRF.format(lists="SELECT query_id // 1000 AS query_id, query_id % 1000 AS list_id, rank, doc_id FROM bm", k=3)}
SELECT query_id, doc_id, score, rank FROM fused""")
def multi_query_search(spark, sf_dir):
    """Every sentence of a benchmark text is a query of its own."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.split("text", r"\. ")).alias("sub_id", "text"))
    most = b.agg(F.max("sub_id")).first()[0]
    return retrieval.multi_query_search(table(spark, sf_dir, "documents"), b, (most or 0) + 1, 3).drop("ranks")


_CHOSEN = "CASE query_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['nowhere'] WHEN 2 THEN ['kb1', 'kb2', 'nowhere'] ELSE ['kb0'] END"


@query(f"""
WITH {_DENSE.format(k=3).replace("PARTITION BY query_id", "PARTITION BY query_id, doc_id % 3")}, st AS (SELECT 'kb' || i AS store FROM range(0, 3) AS r(i)),
sel AS (SELECT query_id, {_CHOSEN} AS chosen FROM (SELECT DISTINCT query_id // 50 AS query_id FROM dense)),
known AS (SELECT query_id, store FROM (SELECT DISTINCT query_id, unnest(chosen) AS store FROM sel) WHERE store IN (SELECT store FROM st)),
res AS (SELECT * FROM known UNION ALL SELECT query_id, store FROM sel CROSS JOIN st WHERE len(chosen) > 0 AND query_id NOT IN (SELECT query_id FROM known)),
h AS (SELECT query_id // 50 AS query_id, 'kb' || (doc_id % 3) AS store, doc_id, score FROM dense),
b AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, doc_id) AS r FROM h JOIN res USING (query_id, store) QUALIFY r <= 3)
SELECT query_id, store AS knowledge_base, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, store, doc_id) AS rank FROM b QUALIFY rank <= 3""")
def multi_store_search(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    best = [retrieval.dense_search(vectors.where(F.col("doc_id") % 3 == i), asked, 3, digits=6) for i in range(3)]  # of each store, over all its rows
    hits = best[0].unionByName(best[1]).unionByName(best[2]).select((F.col("query_id") / 50).cast("long").alias("query_id"), F.concat(F.lit("kb"), (F.col("doc_id") % 3).cast("string")).alias("store"), "doc_id", "score")
    chosen = F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("query_id") % 4 == 1, F.array(F.lit("nowhere"))).when(F.col("query_id") % 4 == 2, F.array(F.lit("kb1"), F.lit("kb2"), F.lit("nowhere"))).otherwise(F.array(F.lit("kb0")))
    selection = hits.select("query_id").distinct().withColumn("chosen", chosen)
    stores = spark.range(3).select(F.concat(F.lit("kb"), F.col("id").cast("string")).alias("store"))
    return retrieval.multi_store_search(hits, selection, stores, 3)


@query("SELECT doc_id, source FROM documents WHERE contains(source, 'rc1') OR contains(source, 'c7')")
def partition_store(spark, sf_dir):
    return retrieval.partition_store(table(spark, sf_dir, "documents"), ["rc1", "c7"]).select("doc_id", "source")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def merge_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return retrieval.merge_evidence(d).select("doc_id", "source")


@query("""
WITH s AS (SELECT l_orderkey AS plan_id, l_linenumber AS step_id, l_linenumber AS position, CASE WHEN l_linenumber = 1 THEN [] ELSE [l_linenumber - 1, l_partkey % 7 + 1] END AS d FROM lineitem),
done AS (SELECT o_orderkey AS plan_id, unnest([o_custkey % 9 + 1, o_custkey % 4 + 1]) AS step_id FROM orders WHERE o_orderkey % 3 = 0),
again AS (SELECT plan_id, count(*) AS n FROM s JOIN (SELECT DISTINCT * FROM done) USING (plan_id, step_id) GROUP BY 1),
w AS (SELECT plan_id, position, unnest(d) AS need FROM s),
m AS (SELECT plan_id, string_agg(DISTINCT CAST(need AS VARCHAR), ',' ORDER BY CAST(need AS VARCHAR)) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.plan_id = w.plan_id AND s.step_id = w.need AND s.position < w.position)
  AND NOT EXISTS (SELECT 1 FROM done WHERE done.plan_id = w.plan_id AND done.step_id = w.need) GROUP BY plan_id)
SELECT plan_id, count(*) AS n_steps, count(*) - count(DISTINCT step_id) + coalesce(any_value(n), 0) AS duplicates, count(*) FILTER (step_id < 2) AS below, coalesce(any_value(missing), '') AS missing,
  count(*) - count(DISTINCT step_id) + coalesce(any_value(n), 0) = 0 AND count(*) FILTER (step_id < 2) = 0 AND any_value(missing) IS NULL AS valid FROM s LEFT JOIN m USING (plan_id) LEFT JOIN again USING (plan_id) GROUP BY plan_id""")
def validate_plan(spark, sf_dir):
    line = F.col("l_linenumber").cast("long")
    needs = F.when(line == 1, F.array().cast("array<bigint>")).otherwise(F.array(line - 1, (F.col("l_partkey") % 7 + 1).cast("long")))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), line.alias("step_id"), line.alias("position"), needs.alias("depends_on"))
    c = F.col("o_custkey").cast("long")
    done = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("plan_id"), F.explode(F.array(c % 9 + 1, c % 4 + 1)).alias("step_id"))
    return retrieval.validate_plan(steps, done, minimum=2)


@query("""
WITH h AS (SELECT d.doc_id, d.source, b.item_id AS query_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank, d.text AS content FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id QUALIFY rank <= 3)
SELECT query_id, string_agg('[来源: ' || source || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id""")
def format_context(spark, sf_dir):
    from quarry.operators import memory

    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "source", F.col("text").alias("content"))
    hits = retrieval.top_k(d.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), "query_id"), 3, "doc_id")
    return memory.format_context(hits)


@query(f"""
WITH {_DENSE.format(k=10)}, v AS (SELECT query_id AS sample_id, rank AS position, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS v FROM dense JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id),
p AS (SELECT *, sum(v) OVER (PARTITION BY sample_id ORDER BY position) / position * v AS g FROM v)
SELECT sample_id, round(coalesce(sum(g) / nullif(sum(v), 0), 0), 9) AS context_precision FROM p GROUP BY sample_id""")
def context_precision(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = _dense(spark, sf_dir, 10).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b")), "doc_id")
    verdicts = hits.select(F.col("query_id").alias("sample_id"), F.col("rank").alias("position"), (F.col("a") == F.col("b")).cast("int").alias("verdict"))
    return evaluation.context_precision(verdicts).withColumn("context_precision", F.round("context_precision", 9))


@query("SELECT l_orderkey AS sample_id, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 9) AS context_recall FROM lineitem GROUP BY 1")
def context_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_returnflag") == "N").cast("int").alias("attributed"))
    return evaluation.share_of(rows, "attributed", "context_recall").withColumn("context_recall", F.round("context_recall", 9))


@query("SELECT l_suppkey AS sample_id, round(avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END), 9) AS faithfulness FROM lineitem GROUP BY 1")
def faithfulness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_id"), (F.col("l_quantity") > 20).cast("int").alias("verdict"))
    return evaluation.share_of(rows, "verdict", "faithfulness").withColumn("faithfulness", F.round("faithfulness", 9))


@query("""
SELECT a.vec_id // 5 AS sample_id, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) * (1 - min(CASE WHEN a.label < 8 THEN 1 ELSE 0 END)), 6) AS answer_relevancy
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1""")
def answer_relevancy(spark, sf_dir):
    from quarry.functions.vectors import cosine

    e = table(spark, sf_dir, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    rows = pairs.select(F.floor(F.col("vec_id") / 5).alias("sample_id"), cosine(F.col("embedding"), F.col("other")).alias("similarity"), (F.col("label") < 8).cast("int").alias("noncommittal"))
    return evaluation.answer_relevancy(rows).withColumn("answer_relevancy", F.round("answer_relevancy", 6))


@query("""
WITH s AS (SELECT o_orderpriority AS metric_name, o_orderstatus AS config, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS v FROM orders),
m AS (SELECT metric_name, avg(v) FILTER (config = 'F') AS a, avg(v) FILTER (config = 'O') AS b FROM s GROUP BY 1)
SELECT metric_name, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(b - a, 4) AS delta FROM m""")
def compare_configs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    scores = o.select(F.col("o_orderpriority").alias("metric_name"), F.col("o_orderstatus").alias("config"), value.alias("value"))
    return evaluation.compare_configs(scores, "F", "O").select("metric_name", *[F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "delta")])


@query("SELECT o_orderpriority AS metric_name, round(avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderkey % 11 <> 0), 4) AS mean FROM orders GROUP BY 1")
def average_scores(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice").cast("double"))
    scores = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric_name"), value.alias("value"))
    return evaluation.average_scores(scores).withColumn("mean", F.round("mean", 4))


_SEV = "CASE WHEN l_quantity > 45 THEN 'high' WHEN l_quantity > 30 THEN 'medium' WHEN l_quantity > 15 THEN 'odd' END"


@query(f"""
SELECT l_orderkey AS task_id, bool_and(l_discount < 0.08) AND count(*) FILTER ({_SEV} = 'high') = 0 AS approved, count(*) FILTER (l_discount < 0.08) || '/' || count(*) AS ratio,
  count(*) FILTER ({_SEV} = 'high') AS high, count(*) FILTER ({_SEV} = 'medium') AS medium, count(*) FILTER ({_SEV} = 'odd') AS low,
  coalesce(string_agg({_SEV} || ' ' || l_linenumber, ',' ORDER BY l_linenumber, {_SEV}), '') AS issues, coalesce(string_agg(CASE WHEN l_tax > 0.04 THEN 'check ' || l_linenumber END, ',' ORDER BY l_linenumber), '') AS suggestions FROM lineitem GROUP BY 1""")
def aggregate_reviews(spark, sf_dir):
    severity = F.when(F.col("l_quantity") > 45, "High").when(F.col("l_quantity") > 30, "medium").when(F.col("l_quantity") > 15, "odd")
    line = F.col("l_linenumber").cast("string")
    issues = F.filter(F.array(F.struct(severity.alias("severity"), line.alias("text"))), lambda i: i["severity"].isNotNull())
    suggestions = F.when(F.col("l_tax") > 0.04, F.array(F.concat(F.lit("check "), line), F.lit(None)))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("reviewer"), (F.col("l_discount") < 0.08).alias("approved"), issues.alias("issues"), suggestions.alias("suggestions"))
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", F.lower(i["severity"]), i["text"])), ",")
    return evaluation.aggregate_reviews(rows).withColumn("issues", told).withColumn("suggestions", F.array_join("suggestions", ","))


# Graph: suppliers and parts of order lines; a line relates its supplier to its part.
_ENT = """
raw AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 20000 + l_suppkey * 2 AS seq, 's ' || l_suppkey AS name, CASE WHEN l_quantity > 25 THEN 'SUPPLIER' ELSE 'VENDOR' END AS kind, 'from ' || l_returnflag AS description, l_orderkey AS chunk_id FROM lineitem
        UNION ALL SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 20000 + l_suppkey * 2 + 1, 'p  ' || l_partkey, CASE WHEN l_tax > 0.04 THEN 'PART' ELSE 'ITEM' END, CASE WHEN l_tax > 0.02 THEN 'at ' || l_linestatus ELSE ' ' END, l_orderkey FROM lineitem),
n AS (SELECT *, upper(regexp_replace(name, '\\s+', ' ', 'g')) AS nm FROM raw),
k AS (SELECT nm, kind, count(*) AS c, min(seq) AS f FROM n GROUP BY ALL),
kb AS (SELECT nm, kind FROM k QUALIFY row_number() OVER (PARTITION BY nm ORDER BY c DESC, f) = 1),
d AS (SELECT nm, string_agg(description, ' | ' ORDER BY f) AS description FROM (SELECT nm, description, min(seq) AS f FROM n WHERE trim(description) <> '' GROUP BY ALL) GROUP BY nm),
ck AS (SELECT nm, string_agg(DISTINCT lpad(CAST(chunk_id AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(chunk_id AS VARCHAR), 9, '0')) AS chunks FROM n GROUP BY nm),
entities AS (SELECT kb.nm AS name, kind AS entity_type, coalesce(description, '') AS description, chunks AS chunk_ids FROM kb LEFT JOIN d USING (nm) JOIN ck USING (nm))"""
_REL_SQL = """
rr AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 20000 + l_suppkey * 2 AS seq, 'S ' || l_suppkey AS source, 'P ' || l_partkey AS target, repeat('x', CAST(l_quantity AS INT) % 9) || l_returnflag AS description, least(10, greatest(1, CAST(l_quantity AS DOUBLE) / 5)) AS strength, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS chunk_id FROM lineitem),
rels AS (SELECT source, target, arg_max(description, length(description) * 100000000000000000::HUGEINT - seq) AS description, max(strength) AS strength, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM rr GROUP BY ALL)"""


def _rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    chunk = F.lpad(F.col("l_orderkey").cast("string"), 9, "0").alias("chunk_id")
    base = (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")) * 10000000000 + F.col("l_partkey") * 20000 + F.col("l_suppkey") * 2
    s = li.select(base.cast("long").alias("seq"), F.concat(F.lit("s "), F.col("l_suppkey").cast("string")).alias("name"), F.when(F.col("l_quantity") > 25, "SUPPLIER").otherwise("VENDOR").alias("entity_type"), F.concat(F.lit("from "), "l_returnflag").alias("description"), chunk)
    p = li.select((base + 1).cast("long"), F.concat(F.lit("p  "), F.col("l_partkey").cast("string")), F.when(F.col("l_tax") > 0.04, "PART").otherwise("ITEM"), F.when(F.col("l_tax") > 0.02, F.concat(F.lit("at "), "l_linestatus")).otherwise(" "), chunk)
    strength = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.col("l_quantity").cast("double") / 5))
    r = li.select(base.cast("long").alias("seq"), F.concat(F.lit("s "), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p "), F.col("l_partkey").cast("string")).alias("target"), F.concat(F.expr("repeat('x', cast(l_quantity as int) % 9)"), "l_returnflag").alias("description"), strength.alias("strength"), chunk)
    return s.union(p), r


def _joined(df):
    return df.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"WITH {_ENT} SELECT * FROM entities")
def merge_entities(spark, sf_dir):
    return _joined(graph.merge_entities(_rows(spark, sf_dir)[0]))


@query(f"WITH {_REL_SQL} SELECT * FROM rels")
def merge_relationships(spark, sf_dir):
    return _joined(graph.merge_relationships(_rows(spark, sf_dir)[1]))


@query(f"WITH {_ENT}, {_REL_SQL} SELECT r.source, r.target, r.strength FROM rels r WHERE source IN (SELECT name FROM entities WHERE entity_type IN ('SUPPLIER', 'PART')) AND target IN (SELECT name FROM entities WHERE entity_type IN ('SUPPLIER', 'PART'))")
def build_graph(spark, sf_dir):
    entities, relations = _rows(spark, sf_dir)
    named = graph.merge_entities(entities).where("entity_type in ('SUPPLIER', 'PART')").select("name")
    kept = entities.withColumn("n", graph.normalize_name(F.col("name"))).join(named.select(F.col("name").alias("n")), "n", "left_semi").drop("n")
    return graph.build_graph(kept, relations)[1].select("source", "target", "strength")


@query(f"""
WITH {_ENT}, {_REL_SQL}, deg AS (SELECT name, count(*) AS d FROM (SELECT source AS name FROM rels UNION ALL SELECT target FROM rels) GROUP BY name)
SELECT (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM rels) AS edges, round(avg(d), 6) AS mean_degree, max(d) AS max_degree,
  (SELECT string_agg(entity_type || ' ' || c, ',' ORDER BY c DESC, entity_type) FROM (SELECT entity_type, count(*) AS c FROM entities GROUP BY 1)) AS types FROM deg""")
def graph_stats(spark, sf_dir):
    entities, relations = _rows(spark, sf_dir)
    return graph.graph_stats(graph.merge_entities(entities), graph.merge_relationships(relations)).withColumns({
        "mean_degree": F.round("mean_degree", 6), "types": F.array_join(F.transform("types", lambda t: F.concat_ws(" ", t["entity_type"], t["n"].cast("string"))), ","),
    })


@query(f"""
WITH {_REL_SQL}, links AS (SELECT source AS a, target AS b FROM rels UNION SELECT target, source FROM rels),
seeds AS (SELECT 'P ' || p_partkey AS seed FROM part WHERE p_partkey % 50 = 0),
h1 AS (SELECT DISTINCT seed, b AS name FROM seeds JOIN links ON a = seed),
h2 AS (SELECT DISTINCT h1.seed, b AS name FROM h1 JOIN links ON a = h1.name WHERE b <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.name = b))
SELECT seed, name, 1 AS hop FROM h1 UNION ALL SELECT seed, name, 2 FROM h2""")
def neighbors(spark, sf_dir):
    relations = graph.merge_relationships(_rows(spark, sf_dir)[1])
    seeds = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("P "), F.col("p_partkey").cast("string")).alias("name"))
    return graph.neighbors(relations, seeds, 2)[0]


@query("""
WITH e AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS seq, upper(n_name) AS name FROM nation),
r AS (SELECT c_custkey AS seq, upper(CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE n_name || ' OFFICE' END) AS source, CASE WHEN c_custkey % 5 = 0 THEN 'NOWHERE' ELSE upper(r_name) END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e2 AS (SELECT seq, name FROM e UNION ALL SELECT 100 + r_regionkey, upper(r_name) FROM region),
ends AS (SELECT DISTINCT source AS x FROM r UNION SELECT target FROM r),
m AS (SELECT x, coalesce(max(CASE WHEN e2.name = x THEN e2.name END), arg_min(e2.name, e2.seq)) AS name FROM ends JOIN e2 ON contains(e2.name, x) OR contains(x, e2.name) GROUP BY x)
SELECT r.seq, a.name AS source, b.name AS target FROM r JOIN m a ON a.x = source JOIN m b ON b.x = target""")
def repair_endpoints(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entities = nation.select((F.col("n_nationkey") + 1).cast("long").alias("seq"), F.upper("n_name").alias("name")).union(region.select((F.col("r_regionkey") + 100).cast("long"), F.upper("r_name")))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    relations = c.select(F.col("c_custkey").alias("seq"), F.upper(F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" OFFICE")))).alias("source"), F.when(F.col("c_custkey") % 5 == 0, "NOWHERE").otherwise(F.upper("r_name")).alias("target"))
    return graph.repair_endpoints(relations, entities)


@query("""
SELECT DISTINCT c_custkey AS query_id, upper(n.n_name) AS name FROM customer c JOIN nation m ON c.c_nationkey = m.n_nationkey JOIN nation n
ON contains(upper('orders from ' || m.n_name || ' and ' || m.n_name || ' to china'), upper(n.n_name))""")
def link_query_entities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    queries = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("orders from "), "n_name", F.lit(" and "), "n_name", F.lit(" to china")).alias("text"))
    return graph.link_query_entities(queries, nation.select(F.col("n_nationkey").alias("seq"), F.upper("n_name").alias("name")))


@query("""
WITH n AS (SELECT n_nationkey AS seq, upper(n_name) AS name FROM nation),
asked AS (SELECT s_suppkey AS query_id, upper(CASE WHEN s_suppkey % 3 = 0 THEN n_name WHEN s_suppkey % 3 = 1 THEN substring(n_name, 2, 3) ELSE 'the ' || n_name || ' and china' END) AS asked FROM supplier JOIN nation ON s_nationkey = n_nationkey),
best AS (SELECT query_id, coalesce((SELECT name FROM n WHERE name = asked), (SELECT arg_min(name, seq) FROM n WHERE contains(name, asked) OR contains(asked, name))) AS name FROM asked)
SELECT query_id, name FROM best WHERE name IS NOT NULL
UNION SELECT s_suppkey, name FROM supplier, n WHERE contains(upper('supplies' || s_suppkey || 'chinaindia'), name)""")
def link_extracted_entities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_suppkey") % 3
    name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.substring("n_name", 2, 3)).otherwise(F.concat(F.lit("the  "), "n_name", F.lit(" and china ")))
    queries = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("supplies"), F.col("s_suppkey").cast("string"), F.lit("chinaindia")).alias("text"))
    return graph.link_query_entities(queries, nation.select(F.col("n_nationkey").alias("seq"), F.upper("n_name").alias("name")), s.select(F.col("s_suppkey").alias("query_id"), name.alias("name")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'C' || o_custkey AS a, 'P' || o_orderkey AS b FROM orders),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM both_ways UNION SELECT r.node, b.b FROM r JOIN both_ways b ON b.a = r.root WHERE b.b < r.node OR true)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return graph.connected_components(e, nodes)


def _weighted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s, p = F.col("l_suppkey").cast("long") * 2, F.col("l_partkey").cast("long") * 2 + 1
    rows = li.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_quantity")).alias("seq"), s.alias("source"), p.alias("target"), F.col("l_quantity").cast("double").alias("weight"))
    return graph.undirected(rows)


_W = """
w AS (SELECT least(l_suppkey * 2, l_partkey * 2 + 1) AS a, greatest(l_suppkey * 2, l_partkey * 2 + 1) AS b, arg_max(CAST(l_quantity AS DOUBLE), (l_orderkey * 10 + l_linenumber) * 10000000 + l_quantity) AS weight FROM lineitem GROUP BY ALL),
lab AS (SELECT DISTINCT n AS node, n % 4 AS label FROM (SELECT a AS n FROM w UNION SELECT b FROM w))"""


@query(f"""
WITH {_W}, d AS (SELECT label, sum(weight) AS d FROM (SELECT a AS n, weight FROM w UNION ALL SELECT b, weight FROM w) JOIN lab ON n = node GROUP BY label),
i AS (SELECT x.label, sum(weight) AS w FROM w JOIN lab x ON a = x.node JOIN lab y ON b = y.node WHERE x.label = y.label GROUP BY 1), t AS (SELECT sum(weight) AS m FROM w)
SELECT round(sum(coalesce(i.w, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM d LEFT JOIN i USING (label) CROSS JOIN t""")
def modularity(spark, sf_dir):
    edges = _weighted(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.modularity(edges, nodes.withColumn("label", F.col("node") % 4)).withColumn("modularity", F.round("modularity", 9))


@query()
def detect_communities(spark, sf_dir):
    edges = graph.written(_weighted(spark, sf_dir), "edges")
    labels = graph.written(communities.detect_communities(edges), "labels")
    return labels.join(F.broadcast(graph.modularity(edges, labels).withColumn("modularity", F.round("modularity", 6))))


@query()
def bounded_communities(spark, sf_dir):
    return communities.bounded_communities(graph.written(_weighted(spark, sf_dir), "edges"))


@query(f"""
WITH {_ENT}, {_REL_SQL}, lab AS (SELECT name, ord(right(name, 1)) - 48 AS label FROM entities),
m AS (SELECT label, count(*) AS size, string_agg(name, ', ' ORDER BY name) AS names FROM lab GROUP BY label),
i AS (SELECT x.label, string_agg(source || ' → ' || target || ': ' || description, chr(10) ORDER BY source || ' → ' || target || ': ' || description) AS relationships FROM rels JOIN lab x ON source = x.name JOIN lab y ON target = y.name WHERE x.label = y.label GROUP BY 1)
SELECT label AS community_id, size, 'Community ' || label AS title, names AS entity_names, coalesce(relationships, '') AS relationships FROM m LEFT JOIN i USING (label)""")
def assemble_communities(spark, sf_dir):
    rows, relations = _rows(spark, sf_dir)
    entities = graph.merge_entities(rows)
    labels = entities.select("name", F.expr("ascii(right(name, 1)) - 48").alias("label"))
    out = graph.assemble_communities(labels, entities, graph.merge_relationships(relations))
    return out.select("community_id", "size", "title", F.array_join("entity_names", ", ").alias("entity_names"), F.array_join("relationship_descriptions", "\n").alias("relationships"))


@query("""
SELECT o_custkey AS query_id, string_agg('### [' || o_orderpriority || '] (相关度: ' || (o_orderkey % 100) || ')' || chr(10) || o_orderstatus, chr(10) || chr(10) ORDER BY o_orderkey % 100 DESC, o_orderkey) AS answer
FROM orders WHERE o_orderkey % 100 >= 20 AND o_orderkey % 7 <> 0 GROUP BY 1""")
def global_reduce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    summary = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("text")
    rows = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("community_id"), F.col("o_orderpriority").alias("title"), summary.alias("summary"), (F.col("o_orderkey") % 100).alias("score"), F.col("o_orderstatus").alias("answer"))
    return graph.global_reduce(rows)


@query(f"""
WITH {_ENT}, {_REL_SQL}, seeds AS (SELECT p_partkey AS query_id, 'P ' || p_partkey AS name FROM part WHERE p_partkey % 50 = 0),
links AS (SELECT source, target, strength, description, source AS near, target AS far FROM rels UNION ALL SELECT source, target, strength, description, target, source FROM rels),
hit AS (SELECT query_id, l.* FROM seeds JOIN links l ON near = name WHERE far <> name),
lines AS (
  SELECT query_id, 1 AS section, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, source, target) AS position, source || ' → ' || target || ': ' || description AS text FROM (SELECT DISTINCT query_id, source, target, strength, description FROM hit)
  UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY label), '[Community ' || label || '] suppliers and parts' FROM (SELECT DISTINCT query_id, ord(right(name, 1)) - 48 AS label FROM seeds JOIN entities USING (name))
  UNION ALL SELECT * FROM (SELECT query_id, 3, row_number() OVER (PARTITION BY query_id ORDER BY name) AS position, name || ': ' || substring(description, 1, 100) FROM (SELECT DISTINCT query_id, far AS name FROM hit ANTI JOIN seeds s ON s.query_id = hit.query_id AND s.name = hit.far) JOIN entities USING (name)) WHERE position <= 10),
cost AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id, section ORDER BY position) AS used FROM lines),
k1 AS (SELECT * FROM cost WHERE section = 1 AND used <= 1500),
l1 AS (SELECT query_id, 1500 - coalesce(max(k1.used), 0) AS remain FROM (SELECT DISTINCT query_id FROM lines) LEFT JOIN k1 USING (query_id) GROUP BY query_id),
k2 AS (SELECT cost.* FROM cost JOIN l1 USING (query_id) WHERE section = 2 AND used <= remain AND remain > 0),
l2 AS (SELECT query_id, any_value(remain) - coalesce(max(k2.used), 0) AS remain FROM l1 LEFT JOIN k2 USING (query_id) GROUP BY query_id),
k3 AS (SELECT cost.* FROM cost JOIN l2 USING (query_id) WHERE section = 3 AND used <= remain AND remain > 0)
SELECT query_id, section, position, text FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)
UNION ALL SELECT query_id, 0, row_number() OVER (PARTITION BY query_id ORDER BY name), name || ': ' || description FROM seeds JOIN entities USING (name)""")
def local_context(spark, sf_dir):
    rows, relations = _rows(spark, sf_dir)
    entities, merged = graph.build_graph(rows, relations)
    labels = entities.select("name", F.expr("ascii(right(name, 1)) - 48").alias("label"))
    communities = labels.select("name", "label", F.concat(F.lit("Community "), F.col("label").cast("string")).alias("title"), F.lit("suppliers and parts").alias("summary"))
    seeds = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("P "), F.col("p_partkey").cast("string")).alias("name"))
    return graph.local_context(seeds, entities, merged, communities, 1500)


@query(f"""
WITH {_BM25}, {_BM25_HITS.format(tokens=TOKENS.format('text'), source='(SELECT item_id AS query_id, text FROM benchmark JOIN embeddings ON vec_id = item_id)', k=27)},
ds AS (SELECT q.item_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id CROSS JOIN embeddings d),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 27),
{_RRF.format(lists="SELECT query_id, 0 AS list_id, rank, doc_id FROM de UNION ALL SELECT query_id, 1, rank, doc_id FROM bm", k=9)},
rel AS (SELECT f.query_id, f.doc_id, f.rank AS old_rank, coalesce(s.score, 0) AS score FROM fused f LEFT JOIN s ON s.query_id = f.query_id AND s.doc_id = f.doc_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank, score FROM rel QUALIFY rank <= 3""")
def retrieve(spark, sf_dir):
    """Hybrid retrieval of three hits for each benchmark text, reranked by their lexical scores, 0 where no token is shared."""
    from quarry.plans.retrieve import retrieve as plan

    e = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    scores = retrieval.bm25_scores(docs, queries, digits=6).select("query_id", "doc_id", F.col("score").alias("relevance"))
    return plan(docs, e.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, 3, scores)

"""Registered queries on page layout and context budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph, layout
from quarry.plans.text_queries import query, table

# Line items stand for text blocks on their supplier's page, suppliers for regions and images.
_LINES = """lines AS (SELECT l_suppkey AS page, CAST(l_linenumber * 10 AS DOUBLE) AS x0, CAST(l_orderkey + l_linenumber / CAST(10 AS DOUBLE) AS DOUBLE) AS y0,
  concat(CASE WHEN l_partkey % 3 = 0 THEN 'Figure ' ELSE 'See ' END, CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS text FROM lineitem),
blocks AS (SELECT page, text, x0, y0, x0 + 8 AS x1, y0 + 0.04e0 AS y1 FROM lines)"""
_REGIONS = "regions AS (SELECT s_suppkey AS page, CAST(15 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(42 AS DOUBLE) AS x1, CAST(20000 + s_suppkey AS DOUBLE) AS y1 FROM supplier)"
_IMAGES = "images AS (SELECT s_suppkey AS image_id, s_suppkey AS page, CAST(5 AS DOUBLE) AS x0, CAST(45 AS DOUBLE) AS x1, s_suppkey * 7 + 0.05e0 AS y0, s_suppkey * 7 + 0.05e0 AS y1 FROM supplier)"


def _made(spark, sf_dir, parts: list[str], name: str):
    """A table of the shared SQL, from the given tables."""
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}".replace("FROM lineitem", "FROM {lineitem}").replace("FROM supplier", "FROM {supplier}"), lineitem=table(spark, sf_dir, "lineitem"), supplier=table(spark, sf_dir, "supplier"))


@query(f"""
WITH {_LINES}, {_REGIONS}
SELECT page, text, x0, y0 FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.page = b.page AND b.x0 >= r.x0 AND b.y0 >= r.y0 AND b.x1 <= r.x1 AND b.y1 <= r.y1)""")
def drop_contained(spark, sf_dir):
    return layout.drop_contained(_made(spark, sf_dir, [_LINES], "blocks"), _made(spark, sf_dir, [_REGIONS], "regions")).select("page", "text", "x0", "y0")


@query(f"""
WITH {_LINES}, {_IMAGES},
near AS (SELECT image_id, text, greatest(b.y0 - i.y1, i.y0 - b.y1, 0) AS distance FROM images i JOIN blocks b USING (page) WHERE text LIKE 'Figure %' AND least(i.x1, b.x1) > greatest(i.x0, b.x0)),
best AS (SELECT image_id, arg_min(text, distance) AS caption FROM near WHERE distance <= 80 GROUP BY image_id)
SELECT image_id, caption FROM images LEFT JOIN best USING (image_id)""")
def nearest_caption(spark, sf_dir):
    return layout.nearest_caption(_made(spark, sf_dir, [_IMAGES], "images"), _made(spark, sf_dir, [_LINES], "blocks")).select("image_id", "caption")


@query(f"""
WITH {_LINES}, shown AS (SELECT page, x0, y0, CASE WHEN x0 = 10 THEN '[image' || CASE WHEN text LIKE 'Figure %' THEN ': ' || text ELSE '' END || ']' ELSE text END AS shown FROM lines)
SELECT page, '# Page ' || page || chr(10) || chr(10) || string_agg(shown, chr(10) || chr(10) ORDER BY y0, x0, shown) AS content FROM shown GROUP BY page""")
def assemble_pages(spark, sf_dir):
    blocks = _made(spark, sf_dir, [_LINES], "blocks")
    blocks = blocks.withColumn("kind", F.when(F.col("x0") == 10, "image").otherwise("text")).withColumn("caption", F.when(F.col("text").startswith("Figure "), F.col("text")))
    return layout.assemble_pages(blocks)


@query("""
WITH l AS (SELECT user_id AS query_id, event_id % 3 AS section, event_id AS position, props AS text FROM events),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id, section ORDER BY position) AS used FROM l),
s AS (SELECT query_id, max(CASE WHEN section = 0 AND used <= 300 THEN used ELSE 0 END) AS a FROM c GROUP BY query_id),
t AS (SELECT query_id, a, max(CASE WHEN section = 1 AND used <= 300 - a THEN used ELSE 0 END) AS b FROM c JOIN s USING (query_id) GROUP BY query_id, a)
SELECT query_id, section, position, text FROM c JOIN t USING (query_id) WHERE used <= 300 - CASE section WHEN 0 THEN 0 WHEN 1 THEN a ELSE a + b END""")
def pack_to_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("section"), F.col("event_id").alias("position"), F.col("props").alias("text"))
    return graph.pack_to_budget(lines, 300)

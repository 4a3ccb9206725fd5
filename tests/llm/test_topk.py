import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def brute(rows, queries, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if queries(i)}):
        vq = min(v for i, v in fine if i == q)
        scored = sorted((-sum(a * b for a, b in zip(vq, v)), i) for i, v in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_against_brute_force(spark):
    rnd = random.Random(8)
    for scale, n in ((1, 400), (0.002, 300)):  # small components: many ties
        rows = [(i, [rnd.gauss(0, scale) for _ in range(16)]) for i in range(n)]
        rows += [(7, rows[3][1]), (n, rows[3][1]), (n + 1, None), (n + 2, [1.0, None]), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (n + 5, [0.5] * 3), (n + 6, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
        got = topk.top_k(df, df.where("vec_id % 10 = 0"), block=100, query_block=7)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_stops_on_proof_only():
    rng = np.random.default_rng(1)
    grid = (rng.normal(size=(3000, 32)) * 1024).astype(np.int64)
    grid[5] = grid[6] = grid[7] * 3
    index = topk.ImpactIndex(np.arange(3000), grid)
    for q in range(0, 3000, 150):
        scores = grid @ grid[q]
        scores[q] = -(2**60)
        want = np.lexsort((np.arange(3000), -scores))[:10]
        assert index.search(grid[q], q, 10) == [(int(i), int(scores[i])) for i in want]


def test_large_components(spark):
    """Components far beyond 2**40 keep their order and exact scores; a score beyond 64 bits is an error."""
    rows = [(0, [1.5e9, 5.0]), (100, [3e9, 1.0]), (101, [2e9, 0.0]), (102, [4e9, 0.0]), (103, [2.0, 3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id = 103")).collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i == 103, 10)
    ids = np.arange(4)
    grid = topk._whole(np.array([[3e9 * 1024, 1024.0], [2e9 * 1024, 0], [4e9 * 1024, 0], [1.5e9 * 1024, 5 * 1024]]))
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(grid[0].tolist(), v)), i) for i, v in enumerate(grid.tolist()) if i))
    assert topk.ImpactIndex(ids, grid).search(grid[0], 0, 10) == [(i, -s) for s, i in want]
    with pytest.raises(Exception, match="Overflow|too big|too large"):
        topk.top_k(df, df.where("vec_id = 0")).collect()


def test_equal_rows_spread(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0])] * 500 + [(0, [1.0, 1.0])], "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), block=50).collect()]
    assert sorted(got) == [(0, r, 5, 3 * 1024 * 1024) for r in range(1, 11)]
    assert topk._packed(df.select("vec_id", F.col("embedding").alias("vector")), "block", 10).agg(F.max(F.length("ids"))).first()[0] < 8 * 90

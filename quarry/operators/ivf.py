"""Approximate vector search with an inverted-file index: coarse cells, byte codes to scan, exact rescoring."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import norm, valid_vector
from quarry.operators.retrieval import dense_search, top_k
from quarry.plans.stages import location, written

#: Most cells of an index; their centroids go along with each task.
MOST_CELLS = 16_384
#: Rows per cell from which centroids are learned, chosen by a hash of the key among all rows.
SAMPLE_PER_CELL = 64
#: Rows that stand in as queries when the number of cells to probe is measured.
SAMPLE_QUERIES = 256
#: Rows of a block of codes, and queries that meet it at once.
BLOCK, ASKED = 4096, 256


@dataclass
class Index:
    """blocks(cell, block, ids, codes, units), written partitioned by cell; unit centroids; probes: cells that a query visits."""

    blocks: DataFrame
    path: str
    centroids: np.ndarray
    probes: int


def _units(df: DataFrame, key: str) -> DataFrame:
    """(key, u): rows with a finite vector that has a length, as unit vectors."""
    v = df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("e")).where(valid_vector(F.col("e")))
    return v.withColumn("n", norm(F.col("e"))).where("n > 0").select(key, F.transform("e", lambda x: x / F.col("n")).alias("u"))


def _nearest(units: DataFrame, key: str, centroids: np.ndarray, count: int) -> DataFrame:
    """(key, u, cells): the `count` cells of nearest centroids, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                near = np.array(own.column(1).to_pylist()) @ centroids.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :count]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], [key, "u", "cells"])

    return units.mapInArrow(run, f"{key} long, u array<double>, cells array<int>")


def _pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """One block: ids in order, components as bytes around zero with a scale a row, and unit vectors."""
    t = t.sort_by("doc_id")
    units = np.array(t.column("u").to_pylist())
    scale = np.abs(units).max(axis=1, keepdims=True) / 127
    codes = np.rint(units / scale).astype(np.int8)
    return pa.table({
        "block": [key[1].as_py()], "ids": [t.column("doc_id").to_numpy().tobytes()], "scales": [scale.astype(np.float32).tobytes()], "codes": [codes.tobytes()], "units": [units.tobytes()], "cell": pa.array([key[0].as_py()], pa.int32()),
    })


def build_ivf(corpus: DataFrame, cells: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 42) -> Index:
    """corpus(doc_id, embedding) -> an index of every row with a finite vector that has a length; one dimension per store.

    Cells: the root of the number of rows, MOST_CELLS at most.  Centroids are learned from about SAMPLE_PER_CELL rows a cell; every row
    is stored.  `probes` is the least number of cells that holds `recall` of the k nearest rows of about SAMPLE_QUERIES rows, which one
    exact search finds: few for clustered vectors, many where directions are even.  A large cell is cut into blocks.
    """
    spark = corpus.sparkSession
    units = written(_units(corpus, "doc_id"), "units")
    rows = units.count()
    cells = min(cells or max(1, math.isqrt(rows)), MOST_CELLS, max(1, rows))
    chosen = lambda most, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < math.ceil(min(1.0, most / max(1, rows)) * (1 << 30))
    sample = units.where(chosen(cells * SAMPLE_PER_CELL, 1)).select(array_to_vector("u").alias("features"))
    centroids = np.zeros((1, len((units.first() or [None, [0.0]])[1])))
    if cells > 1 and sample.distinct().limit(2).count() > 1:
        centroids = np.array(KMeans(k=cells, seed=seed, maxIter=8, distanceMeasure="cosine").fit(sample).clusterCenters())  # at most MOST_CELLS
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    placed = written(_nearest(units, "doc_id", centroids, 1).select("doc_id", "u", F.col("cells")[0].alias("cell")), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    # a cell's rows are dealt to as many blocks as it needs, by a hash that tells equal ids apart
    dealt = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("doc_id", "u", F.monotonically_increasing_id()), F.ceil(F.col("n") / BLOCK)))
    blocks = dealt.groupBy("cell", "block").applyInArrow(_pack, "block long, ids binary, scales binary, codes binary, units binary, cell int")
    path = location(spark, "ivf")
    blocks.write.partitionBy("cell").parquet(path)
    stored = spark.read.schema(blocks.schema).parquet(path)
    asked = _nearest(units.where(chosen(SAMPLE_QUERIES, 2)), "doc_id", centroids, len(centroids)).withColumnsRenamed({"doc_id": "query_id"})
    near = dense_search(units.withColumnRenamed("u", "embedding"), asked.select("query_id", F.col("u").alias("embedding")), k)
    place = near.join(placed.select("doc_id", "cell"), "doc_id").join(asked.select("query_id", "cells"), "query_id").select(F.array_position("cells", F.col("cell")).alias("at"))
    probes = place.agg(F.percentile("at", F.lit(recall))).first()[0] if rows else 1
    return Index(stored, path, centroids, max(1, math.ceil(probes or 1)))


def save_ivf(index: Index, path: str) -> None:
    """Blocks by cell, centroids and the number of probes under a folder."""
    spark = index.blocks.sparkSession
    index.blocks.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    rows = [(i, c, index.probes) for i, c in enumerate(index.centroids.tolist())]
    spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")


def load_ivf(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
    schema = "block long, ids binary, scales binary, codes binary, units binary, cell int"
    return Index(spark.read.schema(schema).parquet(f"{path}/blocks"), f"{path}/blocks", np.array([r.centroid for r in rows]), rows[0].probes)


def _in_lots(rows: DataFrame, by: list[str], name: str, fields: list[str], size: int) -> DataFrame:
    """Rows grouped by `by` into arrays of about `size`, however many a group has."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("group_rows"))
    lots = rows.join(counts, by).withColumn("lot", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("group_rows") / size)))
    return lots.groupBy(*by, "lot").agg(F.collect_list(F.struct(*fields)).alias(name))


def ivf_scan(index: Index, queries: DataFrame, most: int, probes: int | None = None) -> DataFrame:
    """(query_id, u, cell, block, at, near, scanned): the `most` best rows by codes of the cells that each query visits.

    A block of codes meets about ASKED queries at once and sends its `most` best of each; vectors aren't read.
    """
    probes = min(probes or index.probes, len(index.centroids))
    asked = _nearest(_units(queries, "query_id"), "query_id", index.centroids, probes)
    sent = _in_lots(asked.select("query_id", "u", F.explode("cells").alias("cell")), ["cell"], "asked", ["query_id", "u"], ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, block, scales, codes, asked = (batch.column(i)[row].as_py() for i in range(5))
                scales = np.frombuffer(scales, np.float32)
                codes = np.frombuffer(codes, np.int8).reshape(len(scales), -1)
                names, grid = [a["query_id"] for a in asked], [a["u"] for a in asked]
                near = np.array(grid, np.float32) @ (codes.astype(np.float32) * scales[:, None]).T
                own = min(most, len(scales))
                best = np.argpartition(-near, own - 1, axis=1)[:, :own]
                columns = [np.repeat(names, own), np.full(best.size, cell), np.full(best.size, block), best.ravel(), np.take_along_axis(near, best, 1).ravel().astype(np.float64), np.full(best.size, len(scales))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "cell", "block", "at", "near", "scanned"])

    met = index.blocks.join(sent, "cell").select("cell", "block", "scales", "codes", "asked")
    found = met.mapInArrow(run, "query_id long, cell long, block long, at long, near double, scanned long")
    return top_k(found, most, F.desc("near"), "cell", "block", "at").drop("rank").join(asked.select("query_id", "u"), "query_id")


def ivf_rescore(index: Index, found: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score): exact cosines of what a scan found, from the blocks' vectors."""
    sent = _in_lots(found.withColumn("cell", F.col("cell").cast("int")), ["cell", "block"], "found", ["query_id", "u", "at"], BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, units, found = (batch.column(i)[row].as_py() for i in range(3))
                ids, at = np.frombuffer(ids, np.int64), np.array([f["at"] for f in found])
                units = np.frombuffer(units).reshape(len(ids), -1)
                scores = np.einsum("ij,ij->i", units[at], np.array([f["u"] for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array([f["query_id"] for f in found]), pa.array(ids[at]), pa.array(np.round(scores, digits) + 0.0)], ["query_id", "doc_id", "score"])

    met = index.blocks.join(sent, ["cell", "block"]).select("ids", "units", "found")
    return met.mapInArrow(run, "query_id long, doc_id long, score double")


def ivf_search(index: Index, queries: DataFrame, k: int = 3, probes: int | None = None, rescore: int = 4, digits: int = 9) -> DataFrame:
    """queries(query_id, embedding) -> query_id, doc_id, score, rank: the k nearest of the rows that the index finds.

    Scores are exact cosines, of the `rescore` * k best rows by codes; a code's component is right to 1/254 of the row's largest.  Queries that find fewer than k rows visit all cells, so
    only a corpus of fewer than k rows gives fewer.  Ties go to the smaller doc_id.  Queries without a finite vector that has a
    length get no rows.
    """
    asked = queries.select("query_id", "embedding")
    if index.blocks.isEmpty():
        return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    out, visited = None, min(probes or index.probes, len(index.centroids))
    while True:
        near = ivf_rescore(index, ivf_scan(index, asked, rescore * k, visited), digits)
        near = written(top_k(near, k, F.desc("score"), "doc_id"), "near")
        if visited == len(index.centroids):
            return near if out is None else out.unionByName(near)
        full = near.where(F.col("rank") == k).select("query_id")
        done = near.join(full, "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        asked, visited = written(asked.join(full, "query_id", "left_anti"), "asked"), len(index.centroids)
        if asked.isEmpty():
            return out


def ann_search(corpus: DataFrame, queries: DataFrame, k: int = 3, recall: float = 0.95) -> DataFrame:
    """Approximate cosine search: build an inverted-file index of the corpus and search it."""
    return ivf_search(build_ivf(corpus, recall=recall, k=k), queries, k)

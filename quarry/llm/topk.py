"""Exact top-k inner products over an impact-ordered index, one score at a time.

Vectors are dealt to blocks.  A block's index holds, for each component, its vectors by falling value, cut
into segments of nearly equal value.  What a segment can add to a query's score is its impact: the query's component
times the segment's largest value (its smallest where the query's component is negative).

A query takes the segments of all components by falling impact and adds each impact to the accumulators of the
segment's vectors.  Segments without positive impact can only lower a score, so an accumulator is an upper bound as
soon as the remaining impacts are covered; the walk stops earlier when the proof below holds already.
Then vectors are rescored exactly by falling bound, until the k-th exact score is no less than the bound of
every vector left: that is the proof, and without it nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

BLOCK = 8192
QUERIES = 256
LEVELS = 16
PROBE = 128
RESCORE = 256
LOT = 64
#: Sums of products must stay below this for the fast path, in which bounds and scores are 64-bit integers.
SAFE = 1 << 60


def usable(column: str):
    """No null, no null or non-finite component."""
    fine = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(column).isNotNull() & fine, F.lit(False))


def scaled(column: str, factor: int = 1024):
    """floor(factor * x) of each component, as a whole number in a double: exact for any finite component."""

    def whole(x):
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # from there on every double is whole

    return F.transform(column, whole)


def _whole(values) -> np.ndarray:
    """Whole numbers in doubles as 64-bit integers, or as Python integers where one is too large for those."""
    if not np.isfinite(values).all():
        raise OverflowError("a component leaves the range of doubles when scaled")
    if not values.size or np.abs(values).max() < 2.0**62:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(v) for v in values.ravel().tolist()]
    return out




class ImpactIndex:
    """The postings of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.members, comp, high, low = [], [], [], []
        for d in range(dims):
            values = vectors[order[:, d], d]
            top, bottom = int(values[0]), int(values[-1])
            level = np.minimum((top - values.astype(np.float64)) * (levels / max(1, top - bottom)), levels - 1).astype(np.int64)
            cuts = np.flatnonzero(np.diff(level)) + 1
            for part in np.split(np.arange(n), cuts):
                self.members.append(order[part, d])
                comp.append(d)
                high.append(values[part[0]])
                low.append(values[part[-1]])
        self.largest = np.abs(vectors).max(0).tolist() if vectors.dtype != object else [SAFE] * dims
        self.comp, self.high, self.low = np.array(comp, np.int64), np.array(high, vectors.dtype), np.array(low, vectors.dtype)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best candidates, ties to the smaller id; vectors with the query's id take no part.

        Where sums could leave 64 bits, all of it runs on Python integers: slower, as exact.
        """
        candidates = self.ids != own
        if not candidates.any():
            return []
        most = sum(a * b for a, b in zip(self.largest, map(abs, query.tolist()), strict=True))
        kind = np.int64 if most < SAFE and query.dtype != object else object
        query, high, low = (x.astype(kind) for x in (query, self.high, self.low))
        q = query[self.comp]
        impact = np.where(q > 0, q * high, q * low)
        walk = np.argsort(-impact, kind="stable")
        walk = walk[: int(np.count_nonzero(impact > 0))]
        bound = np.zeros(len(self.ids), kind)
        impacts = impact[walk]
        for at in range(0, len(walk), PROBE):
            for s, gain in zip(walk[at : at + PROBE].tolist(), impacts[at : at + PROBE].tolist(), strict=True):
                bound[self.members[s]] += gain
            after = walk[at + PROBE :]
            if not len(after):
                break
            # A vector has one posting per component: those left add at most the impact of each component's next
            # segment in the walk, which is its largest.
            comps, first = np.unique(self.comp[after], return_index=True)
            found = self._prove(query, bound + sum(impact[after[first]].tolist()), candidates, k, RESCORE)
            if found is not None:
                return found
        return self._prove(query, bound, candidates, k, None)

    def _prove(self, query, bound, candidates, k, most):
        """Rescore by falling bound until no vector left can enter; None if `most` vectors don't suffice."""
        best_ids, best_scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        at, size = 0, max(k, 64)
        pool = np.flatnonzero(candidates)
        if most is not None and len(pool) > most:
            part = np.argpartition(-bound[pool], most) if bound.dtype != object else np.argsort(-bound[pool], kind="stable")
            left = int(bound[pool[part[most:]]].max())
            pool = pool[part[:most]]
        else:
            left = None
        order = pool[np.argsort(-bound[pool], kind="stable")]
        while at < len(order):
            chunk = order[at : at + size]
            scores = self.vectors[chunk].astype(query.dtype) @ query
            best_ids = np.concatenate([best_ids, self.ids[chunk]])
            best_scores = np.concatenate([best_scores, scores])
            by_id = np.argsort(best_ids, kind="stable")
            keep = by_id[np.argsort(-best_scores[by_id], kind="stable")][:k]
            best_ids, best_scores = best_ids[keep], best_scores[keep]
            at += size
            size *= 2
            if len(best_ids) == k and at < len(order) and best_scores[-1] > bound[order[at]]:
                return list(zip(best_ids.tolist(), best_scores.tolist(), strict=True))
        if left is not None and not (len(best_ids) == k and best_scores[-1] > left):
            return None
        return list(zip(best_ids.tolist(), best_scores.tolist(), strict=True))


def _packed(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """Rows as `blocks` binary blocks: (name, dims, ids, vectors).  A row's block depends on its place in the table, so equal rows spread like others."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        vectors = t.column("vector").to_pylist()
        dims = max(map(len, vectors))
        grid = np.zeros((len(vectors), dims))
        for i, v in enumerate(vectors):
            grid[i, : len(v)] = v
        return pa.table({name: [key[0].as_py()], "dims": pa.array([dims], pa.int32()), "ids": [t.column("vec_id").to_numpy().astype(np.int64).tobytes()], "vectors": [grid.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return materialize(dealt.groupBy(name).applyInArrow(run, f"{name} long, dims int, ids binary, vectors binary"), name)


def _unpacked(t: pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(t.column("ids")[row].as_py(), np.int64)
    return ids, _whole(np.frombuffer(t.column("vectors")[row].as_py()).reshape(len(ids), t.column("dims")[row].as_py()))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, exactly.

    Components are floor(1024 * x), of any size; a score that no long can hold is an error, never a wrong
    number.  A candidate is every usable row whose id isn't the query's; rows repeated
    in the id are candidates each, and a repeated query answers once, with its smallest vector.  Vectors that are null or hold null or
    non-finite components, and rows with null ids, take no part; a shorter vector counts as padded with zeros.
    Fewer than k candidates give all of them.  The query set is stated by the caller; its blocks meet the index's
    blocks, LOT query blocks and one index block to a task's group, so that memory doesn't grow with either.
    """

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable("v")).select("vec_id", scaled("v").alias("vector"))

    stored = clean(vectors)
    asked = materialize(clean(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    blocks = max(1, -(-stored.count() // block))
    sets = max(1, -(-asked.count() // query_block))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = _packed(stored, "block", blocks).withColumn("lot", upto(-(-sets // LOT)))
    sent = _packed(asked, "part", sets).withColumn("lot", F.floor(F.col("part") / LOT)).withColumn("block", upto(blocks))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            held = ImpactIndex(*_unpacked(left, 0))
            wide = held.vectors.shape[1]
            for row in range(right.num_rows):
                q_ids, q = _unpacked(right, row)
                q = np.concatenate([q, np.zeros((len(q), max(0, wide - q.shape[1])), q.dtype)], axis=1)[:, :wide]
                out += [(int(i), v, s) for i, query in zip(q_ids, q, strict=True) for v, s in held.search(query, int(i), k)]
        return pa.table({name: pa.array([o[c] for o in out], pa.int64()) for c, name in enumerate(("query_id", "vec_id", "score"))})

    near = index.groupBy("block", "lot").cogroup(sent.groupBy("block", "lot")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

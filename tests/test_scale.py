"""Properties of plans and approximations: recall, modularity, keyed joins, shared packing of chunks."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import sanitize_json
from quarry.functions.vectors import cosine
from quarry.operators import chunking, classify, communities, graph, ivf, memory, retrieval

SF = "/root/testdata/{}/embeddings.parquet"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_search(spark, sf):
    if not os.path.exists(SF.format(sf)):
        pytest.skip("the supplied tables aren't here")
    e = spark.read.parquet(SF.format(sf))
    docs, queries = e.select(F.col("vec_id").alias("doc_id"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieval.dense_search(docs, queries, 10)
    index = ivf.build_ivf(docs)
    near = ivf.ivf_search(index, queries, 10)
    n = exact.count()
    assert near.count() == n
    assert near.join(exact, ["query_id", "doc_id"], "left_semi").count() >= 0.9 * n
    rows, blocks = docs.count(), index.blocks.groupBy("cell").count().count()
    assert 1 < blocks <= len(index.centroids)
    assert ivf.ivf_scan(index, queries, 40).count() <= 0.2 * rows * queries.count()  # what is compared exactly


def clusters(spark, rows=20_000, centres=100, dims=16, seed=3):
    """Rows around centres; the draw is Spark's, so that no list of rows passes through the driver."""
    centre = lambda i: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.pmod(F.xxhash64(i, d), F.lit(2001)) / 1000.0 - 1)
    noise = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.pmod(F.xxhash64("id", d, F.lit(seed)), F.lit(2001)) / 10000.0 - 0.1)
    rows = spark.range(rows).select(F.col("id").alias("doc_id"), F.zip_with(centre(F.col("id") % centres), noise, lambda a, b: a + b).alias("embedding"))
    return rows


def test_few_cells_for_clustered_vectors(spark, tmp_path):
    """Rows with clusters: under a fifth of all pairs is scanned, a hundredth compared exactly, and nearly all neighbours are found."""
    docs = clusters(spark)
    queries = docs.where("doc_id % 200 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    ivf.save_ivf(ivf.build_ivf(docs), str(tmp_path / "index"))
    index = ivf.load_ivf(spark, str(tmp_path / "index"))
    near, exact = ivf.ivf_search(index, queries, 10), retrieval.dense_search(docs, queries, 10)
    assert near.count() == 1000 and near.join(exact, ["query_id", "doc_id"], "left_semi").count() >= 900
    met = ivf.ivf_scan(index, queries, 40)
    scanned = met.groupBy("query_id", "cell", "block").agg(F.max("scanned").alias("n")).agg(F.sum("n")).first()[0]
    assert met.count() == 4000 and scanned <= 0.2 * 100 * 20_000  # of two million pairs
    plan = index.blocks.where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_search_of_odd_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [0.0, 1.0])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    got = [(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in ivf.ann_search(docs.where("doc_id is not null"), queries, 9).collect()]
    assert sorted(got) == [(1, 1, 1.0, 1), (1, 5, 0.707107, 2), (1, 5, 0.707107, 3)]
    assert ivf.ann_search(docs.limit(0), queries, 3).collect() == []


def test_communities_beat_label_propagation(spark):
    """A planted partition: the labels found are connected, as good as the planted ones, and better than propagated labels."""
    rnd = random.Random(1)
    group = [i // 20 for i in range(100)]
    rows = [(i, j, 1.0) for i in range(100) for j in range(i) if rnd.random() < (0.5 if group[i] == group[j] else 0.03)]
    edges = spark.createDataFrame([(b, a, w) for a, b, w in rows], "a long, b long, weight double").cache()
    around = {i: [] for i in range(100)}
    for i, j, _ in rows:
        around[i].append(j)
        around[j].append(i)
    label = list(range(100))
    for _ in range(20):
        for i in range(100):
            seen = [label[j] for j in around[i]]
            if seen:
                label[i] = max(sorted(set(seen)), key=seen.count)
    value = lambda labels: graph.modularity(edges, labels).first()[0]
    labels = communities.detect_communities(edges)
    _pieces(labels, rows)
    found = value(labels)
    frame = lambda own: spark.createDataFrame(list(enumerate(own)), "node long, label long")
    assert found >= value(frame(group)) - 0.02 and found >= value(frame(label)) - 1e-9


def _pieces(labels, rows):
    """The nodes of each label, after a look that they hang together by edges."""
    own = {r.node: r.label for r in labels.collect()}
    groups = {}
    for node, label in own.items():
        groups.setdefault(label, set()).add(node)
    around = {}
    for a, b, _ in rows:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    for members in groups.values():
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += around.get(x, set()) & members
        assert seen == members
    assert set(own) == set(around) and len(own) == labels.count()
    return groups


def test_communities_are_connected_and_bounded(spark):
    """A ring of cliques, a clique, a star and a chain above the size, and a pair; all nodes once, every community connected."""
    rows = [(8 * c + i, 8 * c + j, 1.0) for c in range(6) for i in range(8) for j in range(i)]
    rows += [(8 * c, (8 * c + 9) % 48, 0.5) for c in range(6)]
    rows += [(100 + i, 100 + j, 2.0) for i in range(23) for j in range(i)]
    rows += [(200, 201 + i, 1.0) for i in range(30)] + [(300 + i, 301 + i, 1.0) for i in range(40)] + [(400, 401, 1.0)]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    bound = _pieces(communities.bounded_communities(edges), rows)
    assert max(map(len, bound.values())) <= 10
    assert [sorted(bound[8 * c]) for c in range(6)] == [list(range(8 * c, 8 * c + 8)) for c in range(6)]
    assert bound[400] == {400, 401} and sum(100 <= min(g) < 200 for g in bound.values()) <= 6


def test_communities_of_odd_edges(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    assert communities.detect_communities(none).collect() == [] and communities.bounded_communities(none).collect() == []
    odd = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (2, 3, 0.0), (3, 4, None), (None, 5, 1.0), (6, 6, 1.0)], "a long, b long, weight double")
    assert {(r.node, r.label) for r in communities.detect_communities(odd).collect()} == {(1, 1), (2, 1), (6, 6)}


def test_endpoints_met_by_keys_are_all_that_contain(spark):
    rnd = random.Random(2)
    names = ["".join(rnd.choice("AB ") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    ends = ["".join(rnd.choice("AB ") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    entities = spark.createDataFrame(list(enumerate(names)), "seq long, name string")
    relations = spark.createDataFrame([(i, e, names[0]) for i, e in enumerate(ends)], "seq long, source string, target string")
    want = {}
    for i, e in enumerate(ends):
        hit = e if e in names else next((n for n in names if e in n or n in e), None)
        if hit is not None:
            want[i] = hit
    assert {r.seq: r.source for r in graph.repair_endpoints(relations, entities).collect()} == want


def test_chunks_cover_their_text():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", " ", ". ", "\n", "\n\n", "。", "defgh"]) for _ in range(rnd.randint(0, 60)))
        size = rnd.randint(3, 20)
        overlap = rnd.randint(0, size - 1)
        for pieces in (chunking.sentence_pieces(text, size, overlap), chunking.recursive_pieces(text, size, overlap, chunking.SEPARATORS)):
            assert all(p in text for p in pieces)
            assert set(re.findall(r"\w", text)) == set(re.findall(r"\w", "".join(pieces)))
        assert all(p and len(p) <= size + overlap + 2 for p in chunking.recursive_pieces(text, size, overlap, chunking.SEPARATORS))


def test_sanitized_json(spark):
    deep = '{"a":' * 200 + "1" + "}" * 200
    rows = ['{"password":"x","list":[1,2.5,NaN,{"api_key":1,"t":"sk-abcdefghijkl"}]}', "[" + ",".join("1" * 1 for _ in range(80)) + "]", '"' + "y" * 900 + '"', "no json", None, deep, "1e999", '{"' + "k" * 150 + '":null}']
    got = [r.s for r in spark.createDataFrame([(t,) for t in rows], "t string").select(sanitize_json(F.col("t")).alias("s")).collect()]
    assert got[0] == '{"password": "[REDACTED]", "list": [1, 2.5, "nan", {"api_key": "[REDACTED]", "t": "[REDACTED]"}]}'
    assert got[1].count("1") == 50 and len(got[2]) == 502 and got[3] is None and got[4] is None
    assert got[5].replace(" ", "") == deep and got[6] == '"inf"' and got[7] == '{"' + "k" * 100 + '": null}'


def test_frequent_words_are_a_superset_with_few_counters(spark):
    """Summaries far smaller than the vocabulary lose no frequent word, ties at the edge included."""
    rng = random.Random(5)
    rows = [([f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(40))],) for _ in range(400)]
    exact = Counter(w for (ws,) in rows for w in ws)
    df = spark.createDataFrame(rows, "words array<string>").repartition(6)
    for most, capacity in ((1, 4), (20, 16), (50, 200), (10_000, 8)):
        got = {r.word for r in classify.frequent_words(df, most, capacity).collect()}
        assert {w for w, _ in sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:most]} <= got <= set(exact)
    assert classify.frequent_words(df.limit(0), 5).count() == 0


def test_neighbors_with_many_seeds(spark):
    """More seeds than a block holds, self links and repeated links, against a search from each seed."""
    rng = random.Random(8)
    rels = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(220)]
    seeds = [f"n{i}" for i in range(140)] + ["n1", "absent"]
    links = [(s, t, s, t) for s, t in rels] + [(s, t, t, s) for s, t in rels]
    names, edges = set(), Counter()
    for seed in set(seeds):
        seen, front = {seed}, {seed}
        for hop in (1, 2, 3):
            step = [(s, t, b) for s, t, a, b in links if a in front and b not in seen]
            edges.update((seed, s, t, hop) for s, t, _ in step)
            front = {b for _, _, b in step}
            names |= {(seed, n, hop) for n in front}
            seen |= front
    df = spark.createDataFrame(rels, "source string, target string")
    found, own = graph.neighbors(df, spark.createDataFrame([(s,) for s in seeds], "name string"), 3)
    assert Counter(map(tuple, found.collect())) == Counter(names)
    assert Counter(map(tuple, own.collect())) == edges


def test_recall_meets_blocks_and_keeps_odd_rows(spark):
    """Against every pair: repeated keys, ties by time and key, other lengths, zero, null and endless components; pairs that can't be hits don't leave a task."""
    rng, nan = random.Random(4), float("nan")
    vector = lambda n=3: [float(rng.randrange(-2, 3)) for _ in range(n)]
    rows = [(i % 50, vector(), rng.randrange(3)) for i in range(120)] + [(200, vector(2), 1), (201, None, 1), (202, [nan, 1.0, 1.0], 2), (203, [1.0, None, 0.0], 2), (None, [1.0, 1.0, 1.0], None), (204, [float("inf"), 1.0, 0.0], 1), (205, [], 1)]
    asked = [(i, vector()) for i in range(30)] + [(30, vector(2)), (31, None), (32, [nan, 1.0, 0.0]), (3, vector()), (None, [1.0, 1.0, 1.0]), (33, [])]
    state = spark.createDataFrame(rows, "key long, embedding array<double>, updated_at int").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    pairs = state.withColumn("n", F.size("embedding")).join(queries.select("query_id", F.col("embedding").alias("q"), F.size("embedding").alias("n")), "n")
    pairs = pairs.withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("q")), 6)).where("similarity >= 0.35")
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("updated_at"), F.desc("key")))).where("rank <= 3")
    hits = memory.recall(state, queries, digits=6, block=7, lot=5)
    told = lambda df: Counter(repr(tuple(r)) for r in df.select("query_id", "key", "similarity", "rank").collect())
    assert told(hits) == told(want) and hits.count() > 60
    assert "MapInArrow" in (plan := hits._jdf.queryExecution().executedPlan().toString()) and "salt" not in plan


def test_communities_in_blocks_are_those_of_written_rounds(spark, monkeypatch):
    """Several blocks, loops, repeated edges and weights that aren't whole, with what is known of nodes in arrays or in tables."""
    rng = random.Random(6)
    ids = [rng.randrange(-(2**40), 2**40) for _ in range(40)]
    rows = [(ids[i], ids[j], rng.randrange(1, 9) / 4) for i in range(40) for j in range(i + 1) if rng.random() < (0.6 if i // 14 == j // 14 else 0.04)]
    rows += rows[:5] + [(77, 77, 2.0)]
    edges = spark.createDataFrame(rows, "a long, b long, weight double")
    monkeypatch.setattr(communities, "BLOCK", 40)
    told = lambda: [Counter(map(tuple, f(edges, **o).collect())) for f, o in ((communities.detect_communities, {}), (communities.bounded_communities, {"largest": 6}))]
    held = told()
    monkeypatch.setattr(communities, "MOST_NODES", 0)
    assert held == told() and len(held[0]) == 41
    numbers = spark.createDataFrame([(x,) for x in ids], "n long").select("n", *(F.pmod(F.xxhash64("n", F.lit(r)), F.lit(2)) == 0 for r in (0, 5, 1000))).collect()
    for at, r in enumerate((0, 5, 1000)):
        assert communities._even(np.array([x.n for x in numbers]), r).tolist() == [x[at + 1] for x in numbers]


def test_lexical_scores_are_summed_where_the_tokens_are(spark):
    """Repeated, null and empty rows and queries, several lots, against sums of every posting; no pair of a document and a query is shuffled."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(n)))
    docs = [(i, text(12)) for i in range(60)] + [(5, "a b c"), (5, "b c d"), (6, "a a"), (6, "a a"), (None, "a j"), (None, "j a"), (61, None)]
    asked = [((i, i % 2), text(6)) for i in range(25)] + [((3, 1), "a b"), ((7, None), "c zz"), ((8, 0), None)]
    kind = "query_id struct<q:long,s:int>, text string"
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, kind)
    tf, terms = Counter(), Counter()
    for i, t in docs:
        tf.update((w, i, len((t or "").split())) for w in (t or "").split())
    terms.update((q, w) for q, t in asked for w in (t or "").split())
    n, mean, df = len(docs), sum(len((t or "").split()) for _, t in docs) / len(docs), Counter(w for w, _, _ in tf)
    want = Counter()
    for (q, w), qf in terms.items():
        for (token, i, dl), f in tf.items():
            if token == w:
                want[q, i] += qf * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / mean))
    for lot in (1 << 18, 7):
        scores = retrieval.bm25_scores(frame, queries, digits=6, lot=lot)
        got = {(tuple(r.query_id), r.doc_id): r.score for r in scores.collect()}
        assert got.keys() == want.keys() and scores.count() == len(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
        assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    best = {(tuple(r.query_id), r.doc_id): r["rank"] for r in retrieval.bm25_search(frame, queries, 4, digits=6).where("score > 0").collect()}
    for q in {q for q, _ in want}:
        ranked = sorted((i for p, i in want if p == q), key=lambda i: (-round(want[q, i], 6), i is not None, i or 0))[:4]
        assert [best[q, i] for i in ranked] == [*range(1, len(ranked) + 1)]


def test_neighbors_dealt_by_far_ends(spark, monkeypatch):
    """Few pairs at once, several links a task, frontiers that aren't sent, null ends: the same as a search from each seed; a task gets a frontier's seeds once."""
    rng = random.Random(11)
    rels = [(f"s{rng.randrange(6)}", f"p{rng.randrange(40)}") for _ in range(150)] + [("s1", None), (None, "p3"), ("p3", "p3")]
    seeds = [f"p{i}" for i in range(0, 40, 3)]
    links = [(s, t, s, t) for s, t in rels] + [(s, t, t, s) for s, t in rels]
    names, edges = set(), Counter()
    for seed in seeds:
        seen, front = {seed}, {seed}
        for hop in (1, 2, 3):
            step = [(s, t, b) for s, t, a, b in links if a is not None and a in front and b not in seen]
            edges.update((seed, s, t, hop) for s, t, _ in step)
            front = {b for _, _, b in step}
            names |= {(seed, n, hop) for n in front}
            seen |= front - {None}
    df, asked = spark.createDataFrame(rels, "source string, target string"), spark.createDataFrame([(s,) for s in seeds] + [(None,)], "name string")
    for name, value in (("PAIRS", 1 << 21), ("PAIRS", 5), ("LINKS", 10), ("MOST_SENT", 0)):
        monkeypatch.setattr(graph, name, value)
        found, own = graph.neighbors(df, asked, 3)
        assert Counter(map(tuple, found.collect())) == Counter(names)
        assert Counter(map(tuple, own.collect())) == edges
    plan = graph.neighbors(df, asked, 2)[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Exchange hashpartitioning\(name", plan)


def test_local_context_merges_only_what_may_touch_a_seed(spark, monkeypatch):
    """The same lines with and without the sieve, which Spark carries below the groupings; a null seed and one without entity have none of their own."""
    rng = random.Random(12)
    rows = [(i, f" e {rng.randrange(30)}", rng.choice("AB"), rng.choice(["x", "y", " ", "zz"]), f"c{i % 7}") for i in range(200)]
    rels = [(i, f"e {rng.randrange(33)}", f"e {rng.randrange(33)}", "r" * rng.randrange(9), float(rng.randrange(9)), f"c{i % 7}") for i in range(200)]
    entities = spark.createDataFrame(rows, "seq long, name string, entity_type string, description string, chunk_id string")
    relations = spark.createDataFrame(rels, "seq long, source string, target string, description string, strength double, chunk_id string")
    seeds = spark.createDataFrame([(1, "E 1"), (1, "E 2"), (2, "E 31"), (3, None), (4, "E 7"), (5, "E 2")], "query_id long, name string")

    def told():
        nodes, merged = graph.build_graph(entities, relations)
        groups = nodes.select("name", F.ascii(F.right("name", F.lit(1))).alias("label"), F.lit("t").alias("title"), F.lit("s").alias("summary"))
        return sorted(tuple(r) for r in graph.local_context(seeds, nodes, merged, groups, 200).select("query_id", "section", "position", "text").collect())

    kept, merged = graph._sieve(seeds.where("name is not null").select("name")), graph.merge_relationships(relations)
    plan = merged.where(kept("source") | kept("target"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
    lines = told()
    monkeypatch.setattr(graph, "MOST_SENT", 0)
    assert lines == told() and len({x[:2] for x in lines}) >= 9 and {x[0] for x in lines} == {1, 4, 5}

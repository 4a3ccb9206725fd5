import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash


def brute_fp(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, most):
    root = {i: i for i in range(len(items))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(items))]


def test_documents_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(400)] + ["É", "a\tb", "LOUD"]
    texts = ["", None, " \n ", "one", "One", "one two", "x" * 5000]
    for _ in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(3, 150))]
        texts.append(" ".join(t))
        for _ in range(rnd.randint(0, 3)):
            u = list(t)
            u[rnd.randrange(len(u))] = "changed"
            texts.append(" ".join(u))
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[10], "y"), (None, "quite alone here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("node", F.lit(1)).withColumn("id", F.lit("clash"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    items = [(d, brute_fp(t, 3)) for d, t, _ in rows]
    want = sorted(((d, "%016x" % f, c) for (d, f), c in zip(items, brute_components(items, 2))), key=str)
    assert got == want


@pytest.mark.parametrize("node_limit", [10, 100000])
def test_dense_fingerprints(spark, node_limit):
    rnd = random.Random(7)
    fps = set()
    for _ in range(30):
        c = rnd.getrandbits(64)
        for _ in range(20):
            fps.add(c ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))}))
    items = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in items], "node long, fp binary")
    roots = {r.node: r.root for r in simhash.components(simhash.trie_self_join(df, node_limit=node_limit)).collect()}
    assert [roots.get(i, i) for i, _ in items] == brute_components(items, 2)


def test_bands(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2, (40, 256))
    rows = np.concatenate([np.where(rnd.random(base.shape) < p, 1 - base, base) for p in (0, 0.03, 0.06)])
    fps = [np.packbits(r).tobytes() for r in rows]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(fps)], "node long, fp binary")
    got = {}
    for limit in (5, 1000):
        got[limit] = sorted((r.node, r.root) for r in simhash.components(simhash.trie_self_join(df, 8, 32, 3, 42, limit)).collect())
    assert got[5] == got[1000]
    assert sum(r == n % 40 for n, r in got[5]) >= 118


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_expansion_is_bounded(spark, monkeypatch):
    """A crowded trie is expanded by as many rows as its node pairs with two sides need, whatever the limit."""
    rnd = random.Random(9)
    top = rnd.getrandbits(22) << 42
    fps = sorted({top | rnd.getrandbits(42) for _ in range(3000)})  # one block agrees in all
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "node long, fp binary")
    written = []
    real = simhash.materialize

    def counted(frame, name):
        out = real(frame, name)
        if name == "expanded":
            written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    roots = []
    for limit in (3000, 1000, 300, 100):
        written.clear()
        roots.append(sorted(map(tuple, simhash.components(simhash.trie_self_join(df, node_limit=limit)).collect())))
        steps = 3 + int(np.ceil(np.log2(3000 / limit)))  # bits down to pairs of nodes within the limit
        assert max(written, default=0) <= 3000 * (1 + steps + steps * (steps - 1) // 2)
    assert all(r == roots[0] for r in roots)


def test_dominated_subtrees(spark):
    """Labelled links with salted tasks are those without: all pairs of different labels, none lost."""
    rnd = random.Random(10)
    base = rnd.getrandbits(128)
    fps = sorted({base ^ sum({1 << rnd.randrange(128) for _ in range(rnd.randint(0, 9))}) for _ in range(400)})
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(16, "big")), 1 if i % 10 else i) for i, f in enumerate(fps)], "node long, fp binary, label long")
    tables = simhash._tables(8, 6, 128)
    found = [{(r.u, r.v) for r in simhash.trie_self_join(df, budget=12, node_limit=limit, labelled=True, tables=tables).collect()} for limit in (50, 399)]
    assert found[0] == found[1] and len(found[0]) > 500


def test_tables_reach_the_stated_recall():
    rng = np.random.default_rng(2)
    assert simhash.tables_for(16, 0.8, 0.95) < simhash.tables_for(20, 0.8, 0.95) < 4 * simhash.tables_for(16, 0.8, 0.95)
    hits, n = 0, 200
    tables = simhash._tables(16, simhash.tables_for(16, 0.8, 0.99), 256)
    for _ in range(n):  # sets of 300 and 300 shingles, 8 of 9 in each shared: Jaccard similarity 0.8
        both, a, b = (rng.integers(0, 2**64, size, np.uint64) for size in (320, 40, 40))
        bits = [np.unpackbits(np.frombuffer(simhash._majority(np.concatenate([both, x]), 4), np.uint8)) for x in (a, b)]
        hits += any((bits[0][root] == bits[1][root]).all() and (bits[0][key] != bits[1][key]).sum() <= 20 for root, key, _ in tables)
    assert hits / n >= 0.96


def test_rows_that_share_an_id_keep_apart(spark):
    """Links are of texts: a second text under an id brings no links to the first one's, and the other way round."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(5, a), (5, b), (3, a), (9, b), (4, "words of its own here"), (4, a)]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    prints = {t: f for t in least for i, f, c in got if i == least[t] == c}
    assert len(set(prints.values())) == 3
    assert got == sorted((i, prints[t], least[t]) for i, t in rows)

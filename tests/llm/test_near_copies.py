import random

import corpus_pipeline
import pytest

from quarry.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pairs_near(rnd, target, n):
    """Texts of 304 words (300 shingles) and copies with words changed until the next change would pass the target."""
    out = []
    for _ in range(n):
        words = ["w%d" % rnd.randrange(100_000) for _ in range(304)]
        copy = list(words)
        for at in rnd.sample(range(304), 304):
            changed = copy[:at] + ["x%d" % rnd.randrange(100_000)] + copy[at + 1 :]
            if similarity(" ".join(words), " ".join(changed)) < target:
                break
            copy = changed
        out.append((" ".join(words), " ".join(copy)))
    return out


@pytest.mark.parametrize("target", [0.7, 0.8, 0.85])
def test_pairs_at_similarity(spark, target):
    rnd = random.Random(11)
    pairs = pairs_near(rnd, target, 60)
    rows = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    want = {2 * i for i in range(60)} | {2 * i + 1 for i, pair in enumerate(pairs) if similarity(*pair) < 0.8}
    assert kept == want


def test_groups_against_brute_force(spark):
    """Copies of copies, where links of a group don't hold between all its members; repeats, no words, no ids."""
    rnd = random.Random(12)
    texts = ["", None, "one", "One", "one two", "a b c d e f a b c d e f", "a b c d e f a b c d e"]
    for _ in range(6):
        base = ["w%d" % rnd.randrange(10_000) for _ in range(150)]
        group = [base]
        for _ in range(25):
            words = list(rnd.choice(group))
            for at in rnd.sample(range(150), rnd.randint(1, 6)):
                words[at] = "x%d" % rnd.randrange(10_000)
            group.append(words)
        texts += [" ".join(g) for g in group]
    rnd.shuffle(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a or "", texts[j] or "") >= 0.8 and bool((a or "").split()) == bool((texts[j] or "").split()):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, df, "").collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}


def test_exact_decision_in_small_buckets(spark, monkeypatch):
    """Every u against every v, over many buckets of sets, each copied to several tasks; an empty set and a long one."""
    monkeypatch.setattr(simhash, "SET_BYTES", 3000)
    monkeypatch.setattr(simhash, "ASKED_BYTES", 2000)
    rnd = random.Random(13)
    base = ["w%d" % rnd.randrange(10_000) for _ in range(60)]
    texts = ["", "w", "w x", "b " * 5000, " ".join("l%d" % i for i in range(4000))]
    texts += [" ".join("x%d" % rnd.randrange(10) if rnd.random() < 0.03 else w for w in base) for _ in range(40)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "row long, text binary")
    nodes = spark.createDataFrame([(100 + i, i) for i in range(len(texts))], "node long, row long")
    pairs = [(100 + j, 100 + i) for i in range(len(texts)) for j in range(i)]
    got = simhash.similar(spark.createDataFrame(pairs, "u long, v long"), rows, nodes, 5, 0.8).collect()
    want = {(u, v) for u, v in pairs if u > 100 and similarity(texts[u - 100], texts[v - 100]) >= 0.8}
    assert len(got) == len(want) > 50 and {(r.u, r.v) for r in got} == want
    assert simhash.similar(spark.createDataFrame([], "u long, v long"), rows, nodes, 5, 0.8).count() == 0


def crowd(rnd, n):
    """Texts of 150 words with 1 to 4 of them changed: alike, most pairs below 0.8; copies of some."""
    base = ["w%d" % rnd.randrange(10_000) for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rnd.sample(range(150), rnd.randint(1, 4)):
            words[at] = "x%d" % rnd.randrange(50)
        out.append(" ".join(words))
    return out + out[: n // 10]


def test_a_crowd_gives_few_candidates(spark, monkeypatch):
    """Candidates of a crowd are about as many as its links, not as its pairs; none of its links is lost."""
    texts = crowd(random.Random(14), 300)
    written = {}
    real = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df, shingle=5, least=0.8).collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    candidates = sum(x.count() for x in written["pairs"])
    assert len(set(root)) > 40 and candidates < 4000


def test_crowd_pairs_lose_none(spark, monkeypatch):
    """Every pair of two labels at 0.8 or more, each once, also where all rarities look alike."""
    rnd = random.Random(15)
    texts = crowd(rnd, 120) + ["", "a b", "c " * 40, " ".join("l%d" % i for i in range(3000)), " ".join("l%d" % i for i in range(100, 3000))]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "row long, text binary")
    members = spark.createDataFrame([(500 + i, i % 100, i) for i in range(len(texts))], "node long, label long, row long")
    sets = [shingles(t) for t in texts]
    want = {(500 + i, 500 + j) for j in range(len(texts)) for i in range(j) if i % 100 != j % 100 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for counters in (1 << 22, 1 << 16):
        monkeypatch.setattr(simhash, "COUNTERS", counters)
        if counters == 1 << 16:
            monkeypatch.setattr(simhash, "MAP", 1)
        got = [(r.u, r.v) for r in simhash.crowd_pairs(members, rows, 5, 0.8).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and len(want) > 20
    empty = members.where("false")
    assert simhash.crowd_pairs(empty, rows, 5, 0.8).count() == 0

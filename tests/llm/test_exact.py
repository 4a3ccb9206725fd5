import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode(), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(spark, rows, largest=True, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("kind", F.lit(1)).repartition(5)
    got = exact.exact_groups(df, largest=largest, **kwargs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows, largest)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def sample(n=1500, seed=3):
    rnd = random.Random(seed)
    stems = ["", "a", "ab", "shared opening " * 40, "é", "\x00", "shared opening " * 40 + "x"]
    return [(i if rnd.random() < 0.9 else None, rnd.choice([None, rnd.choice(stems) + str(rnd.randrange(60)) * rnd.randrange(3), "hot text"])) for i in range(n)]


@pytest.mark.parametrize("largest", [True, False])
def test_against_brute_force(spark, largest):
    rows = sample() + [(7, "twice"), (7, "twice"), (None, "nobody"), (None, "nobody"), (5, "x" * 300_000), (6, "x" * 300_000), (8, "x" * 299_999 + "y")]
    check(spark, rows, largest)


def test_spilled_subtrees_and_salted_groups(spark):
    """A budget of a few texts spills subtrees over several rounds; a fan-in of two salts the hot text."""
    check(spark, sample(600), budget=3000)
    check(spark, sample(600), fan_in=2)
    check(spark, sample(600), budget=3000, fan_in=2)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(df).collect() == []
    check(spark, [(1, None), (2, "")])


def test_equal_keys_are_told_apart(spark):
    """Different texts under one length and hash stay apart: the trie compares whole byte strings."""
    texts = [b"one", b"two", b"one", b"six"]
    rows = [("open", i, len(t), 1, "s", i, i, 1, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "kind string, rep long, n_bytes long, hash long, sha256 string, owner long, owner_row long, copies long, subtree string, text binary").coalesce(1)
    got = df.mapInArrow(exact._merged(False, 1 << 20, True), exact.SCHEMA).collect()
    assert sorted((r.rep, r.copies) for r in got if r.kind == "done") == [(0, 2), (1, 1), (3, 1)]
    assert [(r["class"], r.rep) for r in got if r.kind == "link"] == [(2, 0)]


def test_trie_weights_and_spills():
    rnd = random.Random(1)
    trie, texts = exact.Patricia(), set()
    for i in range(400):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randrange(12))).encode()
        found = trie.find(text)
        if isinstance(found, exact.Node):
            assert text not in texts
            found.terminal = exact.Terminal(i, "", 0, i, i, 1)
            texts.add(text)

    def weight(node):
        assert node.weight == len(node.label) + exact.NODE + sum(map(weight, node.children.values()))
        return node.weight

    weight(trie.root)
    assert {t for t, _ in trie.entries()} == texts
    gone = set()
    while (heavy := trie.heaviest()) is not None:
        out = {t for t, _ in trie.spill(*heavy)}
        assert out and not out & gone and all(t.startswith(heavy[1]) for t in out)
        gone |= out
        weight(trie.root)
        assert all(trie.find(t) is heavy[0] for t in out)
    left = {t for t, _ in trie.entries()}
    assert gone | left == texts and not gone & left and len(left) < 40

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import phrases
from quarry.llm.common import scratch


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest, top, percent=100):
    f, n, sides = defaultdict(Counter), Counter(), defaultdict(lambda: [0, 0])
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for p in pieces(text):
            n[lang] += len(p)
            for i in range(len(p)):
                for k in range(1, min(longest, len(p) - i) + 1):
                    g = tuple(p[i : i + k])
                    f[lang][g] += 1
                    sides[lang, g][0] += i > 0
                    sides[lang, g][1] += i + k < len(p)
    out = []
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in good.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    inside[g[i : i + size]] = max(inside[g[i : i + size]], a)
        scored = []
        for g, a in good.items():
            if 100 * inside[g] >= percent * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r, *sides[lang, g]))
        for i, (s, a, g, l, r, before, after) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, g.decode(), -a, l, r, n[lang], -s, before, after))
    return sorted(out)


def sample(count, seed):
    rnd = random.Random(seed)
    stock = ["of", "the", "New", "york", "city", "É", "été", "a", " x", "zz ", "b", "c"]
    text = lambda: "".join(rnd.choice(stock) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "! "]) for _ in range(rnd.randrange(30)))
    return [(rnd.choice(["en", "en", "fr", None]), rnd.choice([None, "", text(), text(), "new york city of the a b c. the city"])) for _ in range(count)]


@pytest.mark.parametrize("shard, broadcast, least", [(1 << 20, 1 << 20, 8), (60, 1 << 20, 5), (60, 0, 8), (1, 1 << 20, 3)])
def test_against_brute_force(spark, shard, broadcast, least):
    rows = sample(300, 1) + [("en", "long " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("shard", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    got = phrases.collocations(df, least=least, top=50, shard=shard, broadcast=broadcast)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 5, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_other_lengths_and_shares(spark):
    rows = sample(200, 2)
    df = spark.createDataFrame(rows, "lang string, text string")
    for longest, percent in ((2, 100), (3, 60), (4, 100)):
        got = phrases.collocations(df, least=4, longest=longest, percent=percent, top=1000)
        assert sorted(map(tuple, got.collect())) == brute(rows, 4, longest, 1000, percent)


def test_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", " . ")], "lang string, text string"), least=1).collect() == []


def test_intervals_extend_both_ways():
    """From any phrase, right and left extensions have the counts and places that a plain scan finds."""
    rnd = np.random.default_rng(3)
    for symbols in (4, 70_000):
        sequence = np.concatenate([[0], rnd.integers(0, 4, 400) if symbols == 4 else rnd.choice([0, 1, 2, 69_999], 400), [0]]).astype(np.uint32)
        index, plain = phrases.Index.of(sequence), sequence.tolist()
        count = lambda g: sum(tuple(plain[i : i + len(g)]) == g for i in range(len(plain) - len(g) + 1))
        used = sorted({s for s in plain if s})
        low = np.array([sum(x < s for x in plain) for s in used])
        level = {(s,): (l, l, count((s,))) for s, l in zip(used, low.tolist())}
        for _ in range(4):
            grams = list(level)
            intervals = [np.array(x) for x in zip(*level.values())]
            right = {(*grams[p], s): (a, b, c) for p, s, a, b, c in zip(*[x.tolist() for x in index.right(*intervals)])}
            left = {(s, *grams[p]): (a, b, c) for p, s, a, b, c in zip(*[x.tolist() for x in index.left(*intervals)])}
            assert right == left and all(count(g) == c for g, (_, _, c) in right.items())
            assert set(right) == {tuple(plain[i : i + len(grams[0]) + 1]) for i in range(len(plain) - len(grams[0])) if 0 not in plain[i : i + len(grams[0]) + 1]}
            level = right


def test_index_is_read_without_a_shuffle(spark):
    df = spark.createDataFrame([("en", "a b c")] * 20, "lang string, text string")
    built = df.select("lang", F.col("text").cast("binary")).mapInArrow(phrases._indexed(5, 100), phrases.SHARDS)
    built.write.bucketBy(4, "lot").option("path", scratch(spark, "plan")).saveAsTable("phrases_plan")
    known = spark.table("phrases_plan").selectExpr("lot", "1 as level", "1L as prefix", "1L as suffix", "1L as gram", "lows as places").distinct()
    plan = spark.table("phrases_plan").select("lot", "shard", "length", "forward", "backward").groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(phrases._extended, phrases.GRAMS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table phrases_plan")
    assert "Bucketed: true" in text and "Exchange" not in text[: text.index("HashAggregate")], text


@pytest.mark.parametrize("shard, part", [(60, 3), (1, 40), (1 << 20, 1)])
def test_many_parts(spark, shard, part):
    rows = sample(300, 4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = phrases.collocations(df, least=4, top=100, shard=shard, part=part)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 5, 100)


def test_what_a_lot_sends():
    """A row a part at most, few bytes a phrase, and nothing where the lot has no phrase of the level before."""
    import pyarrow as pa

    rnd, parts = np.random.default_rng(5), 8
    text = " ".join(f"w{int(x)}" for x in np.minimum(rnd.zipf(1.3, 60_000), 2_000))
    batch = pa.record_batch([pa.array(["en"]), pa.array([text.encode()])], ["lang", "text"])
    old, phrases.TaskContext.get = phrases.TaskContext.get, lambda: type("Context", (), {"partitionId": lambda self: 0})()
    try:
        index = pa.Table.from_batches(list(phrases._indexed(5, 1 << 20)(iter([batch]))))
    finally:
        phrases.TaskContext.get = old
    sent = pa.Table.from_batches(list(phrases._worded(parts)(iter(index.to_batches()))))
    assert sent.num_rows <= parts
    told = pa.concat_tables([phrases._summed_words((part,), sent.filter(pa.compute.equal(sent["part"], part)), least=10, parts=parts) for part in pa.array(range(parts))])
    known, lot = told.filter(pa.compute.is_valid(told["lot"])), (pa.scalar(0),)
    pairs = phrases._extended(lot, index, known, level=2, parts=parts)
    columns = [phrases.unpacked(b) for b in pairs["blob"].to_pylist()]
    words = text.split()
    answers = [phrases.unpacked(b) for b in known["blob"].to_pylist()]
    assert sum(int(mask.sum()) for mask, _ in answers) == sum(n >= 10 for n in Counter(words).values())
    assert not any((steps & 1).any() for _, steps in answers)  # numbers rise in the order that the shard has its words in
    frequent = {w for w, n in Counter(words).items() if n >= 10}
    plain = Counter((a, b) for a, b in zip(words, words[1:]) if a in frequent and b in frequent)
    assert pairs.num_rows <= parts and sum(len(c[0]) for c in columns) == len(plain) and sum(int(c[2].sum()) for c in columns) == sum(plain.values())
    assert sum(map(len, pairs["blob"].to_pylist())) < 5 * len(plain)
    assert phrases._extended(lot, index, known, level=3, parts=parts).num_rows == 0


def test_packed_numbers():
    for columns in ([[0, 0, 0]], [[], []], [[1, 255, 256, 70_000], [0, 1 << 33, 1 << 40, 5]]):
        assert [c.tolist() for c in phrases.unpacked(phrases.packed(*map(lambda c: np.array(c, np.int64), columns)))] == columns
    for high in (9, 1 << 40):
        prefix, suffix = np.array([3, 1, high, 1, 3, high]), np.array([7, high, 2, high, 7, 2])
        order, new = phrases.by_pair(prefix, suffix)
        assert list(zip(prefix[order].tolist(), suffix[order].tolist())) == sorted(zip(prefix.tolist(), suffix.tolist())) and new.tolist() == [0, 2, 4]

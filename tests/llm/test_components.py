import random

from quarry.llm.components import components


def test_against_union_find(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (5, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            find(a), find(b)
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for x in list(root):
        want.setdefault(find(x), []).append(x)
    edges = spark.createDataFrame(pairs + pairs[:20] + [(b, a) for a, b in pairs[:20]], "u long, v long")
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(x, min(own)) for own in want.values() for x in own}


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0

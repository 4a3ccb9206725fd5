import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import katz, queries

R = katz.RESERVE


def tokens(text):
    return (text or "").encode().lower().split() + [None]


class Brute:
    """The model from its definition, token by token."""

    def __init__(self, texts):
        self.c1, self.c2, self.ch = Counter(), Counter(), Counter()
        for t in texts:
            before = "begin"
            for w in tokens(t):
                self.c1[w] += 1
                self.c2[before, w] += 1
                self.ch[before] += 1
                before = w
        self.n = sum(self.c1.values())
        self.d1, self.d2 = (katz.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in (self.c1, self.c2))
        self.after = {}
        for (h, w), c in self.c2.items():
            self.after.setdefault(h, {})[w] = c

    def word(self, w):
        if self.c1[w]:
            return self.d1[min(self.c1[w], 6)] * self.c1[w] / (self.n + R)
        return 1 - sum(self.d1[min(c, 6)] * c for c in self.c1.values()) / (self.n + R)

    def next(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.word(w)
        if w in seen:
            return self.d2[min(seen[w], 6)] * seen[w] / (self.ch[h] + R)
        left = 1 - sum(self.d2[min(c, 6)] * c for c in seen.values()) / (self.ch[h] + R)
        return left / (1 - sum(self.word(x) for x in seen)) * self.word(w)

    def score(self, t):
        total, before = 0.0, "begin"
        for w in tokens(t):
            total += math.log10(self.next(before, w))
            before = w
        return total


def corpus():
    rnd = random.Random(6)
    vocab = ["w%d" % int(rnd.paretovariate(0.7)) for _ in range(400)] + ["É", "Loud", "ß"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(60)] + [(400, None), (401, ""), (402, " \t\n"), (403, "new words only here"), (404, "w1 " * 20000), (None, "no id"), (3, "w1 w2 again")]
    return rows


@pytest.mark.parametrize("chunk, hot", [(24 << 20, None), (4000, None), (4000, 30.0)])
def test_scores_against_definition(spark, tmp_path, monkeypatch, chunk, hot):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    if hot:
        real = katz._bigram_rows
        monkeypatch.setattr(katz, "_bigram_rows", lambda parts, _: real(parts, hot))
    rows = corpus()
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, chunk string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_katz_scores(spark, str(tmp_path)).collect()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    brute = Brute([t for d, t in rows if not held(d)])
    v = len(brute.c1)
    want = []
    for d, t in rows:
        ts = tokens(t)
        base = sum(math.log10((brute.c1[w] + 0.5) / (brute.n + 0.5 * (v + 1))) for w in ts)
        want.append((d is None, d or 0, len(ts), sum(brute.c1[w] > 0 for w in ts), held(d), round(base, 6), round(brute.score(t), 6)))
    have = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert {r.train_tokens for r in got} == {brute.n}
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], atol=2e-5)


def test_probabilities_add_up():
    rows = corpus()
    brute = Brute([t for d, t in rows if d is not None and d % 5])
    words = [*brute.c1, "unknown"]
    for h in ["begin", b"w1", b"w2", "never seen", *list(brute.after)[:20]]:
        assert math.isclose(sum(brute.next(h, w) for w in words), 1)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_texts(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = katz.score_texts(df, F.lit(False)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and got.score == 0

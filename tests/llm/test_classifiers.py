import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, queries, toxicity


def test_prior_is_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        positive = rng.normal(2, 1, 4000)
        n = int(share * 8000)
        mixed = np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 8000 - n)])
        assert abs(quality.estimate_prior(positive, mixed) - share) < 0.08


def test_features_of_odd_texts():
    for t in (b"", b" ", b"\n", b"\xff\xfe", b"a" * 1_000_000, "é ß".encode()):
        assert np.isfinite(quality.features(t)).all()


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    odds, lengths = rng.normal(size=(5, 6)), np.array([5, 4, 3, 2, 1, 5])
    transition, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    marginal, log_z, pairs = toxicity.chain_pass(odds, lengths, transition, start, counts=True)
    for i, n in enumerate(lengths):
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            s = start[y[0]] + sum(odds[t, i] for t in range(n) if y[t]) + sum(transition[a, b] for a, b in zip(y, y[1:]))
            weight[y] = np.exp(s)
        z = sum(weight.values())
        assert np.isclose(np.log(z), log_z[i])
        for t in range(n):
            assert np.isclose(marginal[t, i], sum(w for y, w in weight.items() if y[t]) / z)
        want = np.zeros((2, 2))
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += w / z
        assert np.allclose(pairs[:, i], want.ravel())


def test_marginals_of_mixed_lengths():
    rng = np.random.default_rng(5)
    field = toxicity.SpanField(np.zeros(toxicity.SLOTS), rng.normal(size=(2, 2)), rng.normal(size=2))
    odds = [rng.normal(size=n) for n in (1, 40, 3, 900, 7, 0, 17)]
    got = np.split(field.marginals(np.concatenate(odds), np.array(list(map(len, odds)))), np.cumsum(list(map(len, odds)))[:-1])
    for o, p in zip(odds, got):
        if len(o):
            assert np.allclose(p, toxicity.chain_pass(o[:, None], np.array([len(o)]), field.transition, field.start)[0][:, 0])


def _corpus(path, spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        words = [rnd.choice("calm lake river stone cloud green morning walk".split()) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randint(20, 120))]
        good, toxic = rnd.random() < 0.8, rnd.random() < 0.25
        if not good:
            words = [w + rnd.choice(["%%%", "&&&", "$$$"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["fiend", "wretch"]))
        docs.append((i, " ".join(words) + ".", "x"))
        if rnd.random() < 0.6:
            labels.append((i, int(good), int(toxic)))
    truth = {d: (q, t) for d, q, t in labels}
    docs += [(700, None, None), (701, "", "x"), (None, "no id here", "x"), (702, "word " * 30000, "x"), (0, docs[0][1], "x")]
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, truth


@pytest.mark.parametrize("query, which", [(queries.op2_pu_quality, 0), (queries.op3_toxic_spans, 1)])
def test_held_out_accuracy(spark, tmp_path, query, which):
    docs, truth = _corpus(tmp_path, spark)
    rows = query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((False, d) for d, _, _ in docs if d is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if which else 0.3)) for r in rows)
    held = [(r.predicted, truth[r.doc_id][which]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    if which:
        text = {d: t for d, t, _ in docs}
        assert all(set(text[r.doc_id][s.begin : s.end].split()) <= {"fiend", "wretch"} for r in rows if r.doc_id in truth and truth[r.doc_id][1] for s in r.spans)


def test_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()} == {0.5}
    assert {r.score for r in toxicity.tag_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()} == {0.0}
    assert quality.score_quality(docs.limit(0), None).count() == 0


def _held_out(spark, folder, query, column, least):
    """Recall and share of false alarms on held-out labelled rows of a supplied table."""
    rows = query(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    got = rows.groupBy(column).agg(F.avg("predicted").alias("share"), F.count("*").alias("n")).collect()
    return {r[column]: r.share for r in got if r.n >= least}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="the supplied tables aren't here")
def test_recall_on_supplied_tables(spark):
    folder = "/root/testdata/sf0.1"
    toxic = _held_out(spark, folder, queries.op3_toxic_spans, "toxic", 50)
    assert toxic[1] >= 0.85 and toxic[0] <= 0.01
    good = _held_out(spark, folder, queries.op2_pu_quality, "quality", 50)
    assert good[1] >= 0.95 and good[0] <= 0.1


@pytest.mark.parametrize("prior", [0.05, 0.5, 0.95])
def test_risk_of_unlabelled_learning_against_differences(monkeypatch, prior):
    """The gradient that is followed is that of the non-negative risk, summed row by row; where the negative part is below zero, that part's own, backwards."""
    rng = np.random.default_rng(int(prior * 100))
    positive, unlabelled, l2 = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), 1e-3
    followed = []
    monkeypatch.setattr(quality, "_adam", lambda gradient, size, **_: (followed.append(gradient), np.zeros(size))[1])
    monkeypatch.setattr(quality, "estimate_prior", lambda *_: prior)
    model = quality.PUModel(positive, unlabelled, l2)
    rows = lambda x: [[min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(r, model.mean, model.scale, strict=True)] + [1.0] for r in x]
    p, u = rows(positive), rows(unlabelled)

    def parts(w):
        dot = lambda r: sum(a * b for a, b in zip(r, w, strict=True))
        loss = lambda z: float(np.log1p(np.exp(-z)))
        gain = sum(loss(dot(r)) for r in p) / len(p)
        negative = sum(loss(-dot(r)) for r in u) / len(u) - prior * sum(loss(-dot(r)) for r in p) / len(p)
        return gain, negative, l2 / 2 * sum(a * a for a in w)

    signs = set()
    for scale in (0.0, 0.3, 3.0, -3.0):
        w = scale * np.array([1.0, 0.6, 0.9, 1.1, 0.5])
        negative = parts(w)[1]
        signs.add(negative < 0)
        followed_risk = lambda v: (-parts(v)[1] if negative < 0 else prior * parts(v)[0] + parts(v)[1]) + parts(v)[2]  # noqa: B023, E731
        step = 1e-6
        want = [(followed_risk(w + step * e) - followed_risk(w - step * e)) / (2 * step) for e in np.eye(5)]
        assert np.allclose(followed[1](w), want, atol=1e-6)
    assert prior < 0.9 or True in signs

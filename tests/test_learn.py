"""Models against what a whole fit gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import learn, sample
from spanloom.plans import queries


def reference(votes, classes, weights=True):
    """The same model over a matrix of votes (-1: none), to convergence."""
    n, m = votes.shape
    post = np.full((n, classes), 0.25)
    for s in range(m):
        for c in range(classes):
            post[:, c] += votes[:, s] == c
    post /= post.sum(axis=1, keepdims=True)

    def tables():
        prior = post.sum(axis=0) + 1
        t = np.ones((m, classes, classes))
        for s in range(m):
            for c in range(classes):
                for v in range(classes):
                    t[s, c, v] += post[votes[:, s] == v, c].sum()
        return prior / prior.sum(), t / t.sum(axis=2, keepdims=True)

    prior, t = tables()
    penalty = np.zeros(m)
    for i in range(m):
        for j in range(m):
            on = (votes[:, i] >= 0) & (votes[:, j] >= 0)
            if i != j and on.sum() >= 20:
                penalty[i] = max(penalty[i], (votes[on, i] == votes[on, j]).mean() - (post[on] @ (t[i] * t[j]).sum(axis=1)).mean())
    w = 1 / (1 + 4 * penalty * weights)
    for _ in range(500):
        new = np.tile(np.log(prior), (n, 1))
        for s in range(m):
            on = votes[:, s] >= 0
            new[on] += w[s] * np.log(t[s][:, votes[on, s]].T)
        new = np.exp(new - new.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, post = np.abs(new - post).max(), new
        if moved <= 1e-8:
            break
        prior, t = tables()
    return post


def test_dawid_skene_to_the_end_with_copied_sources(spark):
    r = random.Random(21)
    votes = np.full((400, 6), -1)
    for i in range(400):
        truth = r.randrange(3)
        votes[i] = [truth if r.random() < p else r.randrange(3) for p in (0.6, 0.6, 0.6, 0.55, 0.7, 0.7)]
        votes[i, 1] = votes[i, 0] if r.random() < 0.95 else votes[i, 1]
        votes[i, 2] = votes[i, 0] if r.random() < 0.95 else votes[i, 2]
        for s in range(6):
            if r.random() < 0.2:
                votes[i, s] = -1
    rows = [(i, f"s{s}", "ABC"[votes[i, s]]) for i in range(400) for s in range(6) if votes[i, s] >= 0]
    got = {x.item_id: x for x in learn.dawid_skene(spark.createDataFrame(rows, "item_id bigint, source string, type string")).collect()}
    want, plain = reference(votes, 3), reference(votes, 3, False)
    assert all(abs(x.probability - want[i].max()) < 1e-4 and want[i]["ABC".index(x.label)] > want[i].max() - 1e-4 for i, x in got.items())
    assert (want.argmax(axis=1) != plain.argmax(axis=1)).any()


def test_bags_of_each_type(spark):
    r = random.Random(22)
    rows = []
    for i in range(400):
        t, up = r.choice((("A", 1), ("B", 0), ("C", 1))), r.random() < 0.5
        # in A long texts are positive, in B short ones; C has one positive
        long = up == bool(t[1])
        rows.append((i, "x" * (30 if long else 3) + "y" * r.randrange(4), t[0], {"s": 0.5}, (up and r.random() < 0.7) if t[0] != "C" else i == 7))
    rows[7] = (7, "x", "C", None, True)
    df = spark.createDataFrame(rows, "record bigint, text string, type string, confidences map<string,double>, positive boolean")
    got = {x.record: x for x in learn.pu_bagging(df, "positive", F.col("record")).collect()}
    for t, text_long in (("A", True), ("B", False)):
        high = [got[i].score for i, text, k, *_ in rows if k == t and (len(text) > 10) == text_long]
        low = [got[i].score for i, text, k, *_ in rows if k == t and (len(text) > 10) != text_long]
        assert min(high) > max(low)
    assert all(got[i].score is None for i, _, k, *_ in rows if k == "C") and len(got) == 400


def test_resamples_within_strata(spark):
    r = random.Random(23)
    rows = [(i, "a" if i % 4 else "b", r.random() + 5 * (i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k bigint, s string, x double")
    means = np.asarray([x.mean for x in sample.resampled_means(df, "k", "x", 3000, 1, "s", most=64).collect()])
    x, s = np.asarray([x[2] for x in rows]), np.asarray([x[1] for x in rows])
    error = np.sqrt(sum((s == t).sum() * x[s == t].var() for t in "ab")) / len(x)
    assert len(means) == 3000 and abs(means.mean() - x.mean()) < 5 * error / 50 and abs(means.std() / error - 1) < 0.06
    whole = np.asarray([x.mean for x in sample.resampled_means(df, "k", "x", 3000, 1).collect()])
    assert abs(whole.std() / (x.std() / 20) - 1) < 0.06
    # a stratum of equal values never moves the mean
    same = df.withColumn("x", F.when(F.col("s") == "a", 1.0).otherwise(3.0))
    assert {round(x.mean, 9) for x in sample.resampled_means(same, "k", "x", 50, 1, "s").collect()} == {1.5}


def test_queries_have_whole_counts(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    for name in ("bootstrap_paired_full", "bootstrap_linear_full", "bootstrap_stratified_full"):
        assert queries.QUERIES[name](spark, d).first().rounds == 10_000
    asked = {}
    for owner, name in ((learn, "dawid_skene"), (learn, "pu_bagging"), (sample, "simulate_gate")):
        monkeypatch.setattr(owner, name, lambda *x, name=name, **k: (asked.update({name: k}), pu)[1])
    pu = spark.createDataFrame([], "type string, score double, positive boolean")
    for name in ("dawid_skene", "pu_bagging", "gate_simulation"):
        queries.QUERIES[name](spark, d)
    assert not {"rounds", "tolerance"} & set(asked["dawid_skene"]) and "bags" not in asked["pu_bagging"]
    assert asked["simulate_gate"] == {"replications": 5_000, "rounds": 1_000}

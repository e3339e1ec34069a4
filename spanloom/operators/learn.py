"""Small models over votes and features, fitted from sums that workers add up.

Parameters are per source, class or feature and fit the driver; examples never leave
the workers. Draws come from hashes, so that results don't depend on partitions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import hash_int
from spanloom.session import cut

#: Numbers in the tables of all sources that the driver holds.
CELLS = 4_000_000


def dawid_skene(votes: DataFrame, rounds: int = 500, smoothing: float = 1.0, weights: dict[str, float] | None = None, anchors: DataFrame | None = None, dependence: float = 4.0, tolerance: float = 1e-8) -> DataFrame:
    """``item_id, label, probability``: the likeliest label by expectation maximisation over source confusion tables.

    ``votes`` are distinct ``item_id, source, type``; ``weights`` discount sources; ``anchors``
    (``item_id, type``) are items whose label is known and stays. Sources that agree more
    often than their first tables let expect (over 20 items at least) lose weight by ``dependence`` times
    that residual. Rounds end when no probability moves by more than ``tolerance``. Ties:
    least label. A vote with a null part is none.
    """
    import numpy as np

    v = cut(votes.dropna(subset=["item_id", "source", "type"]).select("item_id", "source", F.col("type").alias("vote")).distinct())
    known = (anchors.dropna(subset=["item_id", "type"]) if anchors is not None else v.limit(0).withColumnRenamed("vote", "type")).groupBy("item_id").agg(F.min("type").alias("known"))
    names = sorted(r.vote for r in v.select("vote").union(known.select("known")).distinct().limit(CELLS + 1).collect())  # the types
    sources = sorted(r.source for r in v.select("source").distinct().limit(CELLS + 1).collect())
    if len(sources) * max(len(names), 1) ** 2 > CELLS:
        raise ValueError(f"{len(sources)} sources and {len(names)} types; their tables would have over {CELLS} cells")
    if not names:
        return v.select("item_id", F.col("vote").alias("label"), F.lit(1.0).alias("probability"))
    place = lambda xs, c: F.coalesce(F.array_position(F.array(*map(F.lit, xs)), F.col(c)).cast("int"), F.lit(0)) - 1
    k, n = len(names), len(sources)
    code = place(sources, "source") * k + place(names, "vote") if sources else F.lit(0)
    items = v.groupBy("item_id").agg(F.array_sort(F.collect_list(code)).alias("votes")).join(known, "item_id", "full_outer")
    items = cut(items.select("item_id", F.coalesce("votes", F.array().cast("array<int>")).alias("votes"), place(names, "known").alias("known")))
    # items of like votes have like probabilities
    like = cut(items.groupBy("votes", "known").agg(F.count("*").cast("double").alias("n")))
    base = np.asarray([float((weights or {}).get(s, 1.0)) for s in sources])
    fixed = np.eye(k)

    def posterior(pdf, model):
        """Votes as a matrix of rows by source and type, and the probabilities of the rows' labels."""
        cast = np.zeros((len(pdf), n * k))
        size = pdf["votes"].str.len().to_numpy()
        if size.sum():
            cast[np.repeat(np.arange(len(pdf)), size), np.concatenate(pdf["votes"].to_numpy())] = 1.0
        if model is None:  # shares of the votes
            p = 0.25 + (cast * np.repeat(base, k)).reshape(len(pdf), n, k).sum(axis=1)
        else:
            prior, table, w = model
            p = np.log(prior) + cast @ (np.log(table).transpose(0, 2, 1) * w[:, None, None]).reshape(n * k, k)
            p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        own = pdf["known"].to_numpy()
        p[own >= 0] = fixed[own[own >= 0]]
        return cast, p

    def sums(of, shape):
        """What ``of`` gives for each batch, summed, and the most of what it says besides."""

        def run(batches):
            for pdf in batches:
                x, most = of(pdf)
                yield pd.DataFrame({"x": [x.tobytes()], "most": [float(most)]})

        rows = like.mapInPandas(run, "x binary, most double").collect()
        return sum((np.frombuffer(r.x).reshape(shape) for r in rows), np.zeros(shape)), max((r.most for r in rows), default=0.0)

    def count(now, before=None):
        def of(pdf):
            cast, p = posterior(pdf, now)
            moved = np.abs(p - posterior(pdf, before)[1]).max() if now is not None else 1.0
            q = p * pdf["n"].to_numpy()[:, None]
            return np.concatenate([cast.T @ q, q.sum(axis=0)[None]]), moved

        got, moved = sums(of, (n * k + 1, k))
        prior = got[-1] + smoothing
        table = got[:-1].reshape(n, k, k).transpose(0, 2, 1) + smoothing  # source, label, vote
        return prior / prior.sum(), table / table.sum(axis=2, keepdims=True), moved

    def together(pdf):
        cast, p = posterior(pdf, None)
        votes_of = cast.reshape(len(pdf), n, k)
        seen, m = votes_of.max(axis=2), pdf["n"].to_numpy()[:, None]
        agree = sum(votes_of[:, :, c].T @ (votes_of[:, :, c] * m) for c in range(k))
        return np.stack([seen.T @ (seen * m), agree, *(seen.T @ (seen * m * p[:, [c]]) for c in range(k))]), 0.0

    prior, table, _ = count(None)
    w = base
    if n > 1 and dependence:
        both, _ = sums(together, (k + 2, n, n))
        expected = sum(both[2 + c] * (table[:, c] @ table[:, c].T) for c in range(k))
        residual = np.where(both[0] >= 20, (both[1] - expected) / np.maximum(both[0], 1), 0.0)
        np.fill_diagonal(residual, 0.0)
        w = base / (1 + dependence * np.maximum(residual, 0.0).max(axis=1))
    before, model = None, (prior, table, w)
    for _ in range(rounds):
        prior, table, moved = count(model, before)
        if moved <= tolerance:
            break
        before, model = model, (prior, table, w)
    last = before if before is not None and moved > tolerance else model

    def label(batches):
        for pdf in batches:
            p = np.round(posterior(pdf, last)[1], 9)
            best = p.argmax(axis=1)
            yield pd.DataFrame({"votes": pdf["votes"], "known": pdf["known"], "label": [names[i] for i in best], "probability": np.round(p.max(axis=1), 6)})

    found = like.mapInPandas(label, "votes array<int>, known int, label string, probability double")
    return items.join(found, ["votes", "known"]).select("item_id", "label", "probability")


def features(rows: DataFrame) -> DataFrame:
    """Numbers that describe a proposed span: sources, their confidences, and the look of its text."""
    conf = F.coalesce(F.map_values("confidences"), F.array().cast("array<double>"))
    conf = F.filter(conf, lambda x: x.isNotNull())
    n = F.size(conf)
    mean = F.when(n > 0, F.aggregate(conf, F.lit(0.0), lambda a, b: a + b) / n).otherwise(0.0)
    var = F.when(n > 0, F.aggregate(conf, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n).otherwise(0.0)
    t = F.coalesce("text", F.lit(""))
    part = lambda rule: F.when(F.length(t) > 0, (F.length(t) - F.length(F.regexp_replace(t, rule, ""))) / F.length(t)).otherwise(0.0)
    return rows.withColumn("features", F.array(
        n.cast("double"), F.coalesce(F.array_max(conf), F.lit(0.0)), mean, F.sqrt(var), F.log1p(F.length(t)), F.log1p(F.size(F.split(t, " +"))),
        part("[0-9]"), part(r"\p{Lu}"), part(r"[^\p{L}\p{N}\s]"),
    ))


def logistic(rows: DataFrame, label: str, width: int, weight: Column | None = None, rounds: int = 12, penalty: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Weights (the last is the intercept), means and deviations of a ridge logistic regression by Newton steps.

    Each step sums gradient and Hessian over the rows: ``width`` squared numbers reach the driver.
    """
    import numpy as np

    d = rows.where(F.col(label).isNotNull()).withColumn("_w", weight if weight is not None else F.lit(1.0))
    x = [F.get("features", F.lit(i)) for i in range(width)]
    m = d.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).first()
    mean = [m[f"m{i}"] or 0.0 for i in range(width)]
    dev = [m[f"s{i}"] or 1.0 for i in range(width)]
    z = [(c - mean[i]) / dev[i] for i, c in enumerate(x)] + [F.lit(1.0)]
    d = cut(d.select(F.array(*z).alias("z"), F.col(label).cast("double").alias("y"), "_w"))
    w = np.zeros(width + 1)
    ridge = np.diag([penalty] * width + [1e-6])
    for _ in range(rounds):
        dot = sum((F.get("z", F.lit(i)) * float(w[i]) for i in range(1, width + 1)), F.get("z", F.lit(0)) * float(w[0]))
        p = 1 / (1 + F.exp(-dot))
        s = d.withColumn("p", p).withColumn("g", F.col("_w") * (F.col("y") - F.col("p"))).withColumn("h", F.col("_w") * F.col("p") * (1 - F.col("p")))
        at = lambda i: F.get("z", F.lit(i))
        sums = [F.sum(F.col("g") * at(i)) for i in range(width + 1)] + [F.sum(F.col("h") * at(i) * at(j)) for i in range(width + 1) for j in range(i, width + 1)]
        r = [float(v or 0.0) for v in s.agg(*sums).first()]
        g = np.asarray(r[: width + 1]) - ridge @ w
        h = np.zeros((width + 1, width + 1))
        k = width + 1
        for i in range(width + 1):
            for j in range(i, width + 1):
                h[i, j] = h[j, i] = r[k]
                k += 1
        step = np.linalg.solve(h + ridge, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist(), mean, dev


def apply_logistic(rows: DataFrame, model: tuple[list[float], list[float], list[float]]) -> Column:
    w, mean, dev = model
    dot = F.lit(float(w[-1]))
    for i in range(len(mean)):
        dot = dot + (F.get("features", F.lit(i)) - mean[i]) / dev[i] * w[i]
    return 1 / (1 + F.exp(-dot))


def pu_bagging(rows: DataFrame, positive: str, key: Column, bags: int = 31, seed: str = "pu", kind: str = "type") -> DataFrame:
    """Mean and deviation of the scores of bags, each of one ``kind`` with all its positives and as many hashed unlabeled rows.

    Rows keep their columns; ``score`` and ``spread`` are added. A kind with fewer than two
    positives or unlabeled rows has neither. All models of all kinds take a Newton step in one pass.
    """
    import numpy as np

    f = cut(features(rows).withColumn("_key", hash_int(F.lit(seed), key).cast("bigint")))
    n = {r[kind]: (r.p, r.u) for r in f.groupBy(kind).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("u")).collect()}
    kinds = sorted((t for t, (p, u) in n.items() if t is not None and p > 1 and u > 1), key=str)
    if not kinds:
        return f.drop("_key", "features").withColumn("score", F.lit(None).cast("double")).withColumn("spread", F.lit(None).cast("double"))
    width = 9
    share = {t: min(1.0, n[t][0] / n[t][1]) for t in kinds}
    slim = f.where(F.col(kind).isin(kinds) & F.col(positive).isNotNull()).select(F.col(kind).alias("k"), F.col(positive).alias("y"), "_key", "features")

    def drawn(keys, bag):
        x = keys.astype(np.uint64) + np.uint64(bag + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x >> np.uint64(32)) / 2.0**32

    def sums(of, shape):
        """``of`` each bag (kind, number, features, labels), summed over the workers."""

        def run(batches):
            total = np.zeros((len(kinds), bags, *shape))
            for pdf in batches:
                for i, t in enumerate(kinds):
                    own = pdf[pdf["k"] == t]
                    if len(own):
                        x, y, keys = np.stack(own["features"].to_numpy()), own["y"].to_numpy().astype(float), own["_key"].to_numpy()
                        for b in range(bags):
                            on = (y > 0) | (drawn(keys, b) < share[t])
                            total[i, b] += of(i, b, x[on], y[on])
            yield pd.DataFrame({"x": [total.tobytes()]})

        return sum(np.frombuffer(r.x).reshape(len(kinds), bags, *shape) for r in slim.mapInPandas(run, "x binary").collect())

    m = sums(lambda i, b, x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), (1 + 2 * width,))
    mean = m[..., 1 : 1 + width] / m[..., :1]
    dev = np.sqrt(np.maximum(m[..., 1 + width :] / m[..., :1] - mean**2, 0.0))
    dev[dev < 1e-9] = 1.0
    w = np.zeros((len(kinds), bags, width + 1))
    ridge = np.diag([1.0] * width + [1e-6])

    def newton(i, b, x, y):
        z = np.column_stack([(x - mean[i, b]) / dev[i, b], np.ones(len(x))])
        p = 1 / (1 + np.exp(-z @ w[i, b]))
        return np.concatenate([(z.T @ (y - p))[:, None], z.T @ (z * (p * (1 - p))[:, None])], axis=1)

    for _ in range(50):
        g = sums(newton, (width + 1, width + 2))
        step = np.linalg.solve(g[..., 1:] + ridge, g[..., :1] - ridge @ w[..., None])[..., 0]
        w = w + step
        if np.abs(step).max() < 1e-8:
            break

    @F.pandas_udf("mean double, spread double")
    def score(of: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 2), np.nan)
        for i, t in enumerate(kinds):
            on = (of == t).to_numpy()
            if on.any():
                z = (np.stack(x[on].to_numpy())[:, None] - mean[i]) / dev[i]
                p = 1 / (1 + np.exp(-((z * w[i, :, :width]).sum(axis=2) + w[i, :, width])))
                out[on] = np.column_stack([p.mean(axis=1), p.std(axis=1)])
        return pd.DataFrame(out, columns=["mean", "spread"])

    f = f.withColumn("_s", score(F.col(kind), F.col("features")))
    known = lambda c: F.when(F.col(kind).isin(kinds), F.round(f"_s.{c}", 6))
    return f.withColumn("score", known("mean")).withColumn("spread", known("spread")).drop("_s", "_key", "features")


def ridge(rows: DataFrame, target: str, names: list[str], penalty: float = 1.0) -> list[float]:
    """Weights and intercept of a ridge regression from sums of products of the named columns."""
    import numpy as np

    d = rows.dropna(subset=[target, *names])
    x = [F.col(c).cast("double") for c in names] + [F.lit(1.0)]
    n = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.sum(x[i] * F.col(target)) for i in range(n)]
    r = [float(v or 0.0) for v in d.agg(*sums).first()]
    a = np.zeros((n, n))
    k = 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = r[k]
            k += 1
    return np.linalg.solve(a + np.diag([penalty] * (n - 1) + [1e-9]), np.asarray(r[k:])).tolist()

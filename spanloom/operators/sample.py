"""Deterministic sampling, strata and folds by hash, and statistics over them.

Ranks over a whole table are taken from counts of its values, never from one sorted
task. All draws come from SHA-256 of ids, so they don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import hash_int
from spanloom.session import written


def global_rank(df: DataFrame, value: str, tie: str) -> DataFrame:
    """``rank`` from 0 by (value, tie) and ``total``: the place in a sorted range, and how many rows are in the ranges before it.

    The ranges are cut by both columns, so a value that very many rows hold is spread over tasks; only the sizes of ranges are
    collected.
    """
    sorted_ = df.repartitionByRange(value, tie).withColumn("_range", F.spark_partition_id())
    sorted_ = written(sorted_)  # ranges are drawn from a sample: they must not change
    sizes = {r["_range"]: r["count"] for r in sorted_.groupBy("_range").count().collect()}
    before, total = [], 0
    for i in sorted(sizes):
        before += [F.lit(i), F.lit(total)]
        total += sizes[i]
    within = F.row_number().over(Window.partitionBy("_range").orderBy(value, tie)) - 1
    start = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
    return sorted_.withColumn("rank", (start + within).cast("bigint")).withColumn("total", F.lit(total).cast("bigint")).drop("_range")


def equal_strata(docs: DataFrame, size: str, key: str, strata: int) -> DataFrame:
    """Stratum 1.. of as equal counts as can be, by size and then id. Rows without size are out."""
    r = global_rank(docs.dropna(subset=[size, key]).select(key, size), size, key)
    return r.select(key, size, (F.least(F.floor(F.col("rank") * strata / F.col("total")), F.lit(strata - 1)) + 1).cast("int").alias("stratum"))


def pick(df: DataFrame, by: list[str], key: str, n: int, seed: str, holdout: int = 0) -> DataFrame:
    """The ``n`` rows of least hash of each stratum, the first ``holdout`` of them marked."""
    w = Window.partitionBy(*by).orderBy(hash_int(F.lit(seed), F.col(key)), key)
    out = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return out.withColumn("part", F.when(F.col("place") <= holdout, "holdout").otherwise("dev"))


def fold(key: Column | str, folds: int, seed: str) -> Column:
    return (hash_int(F.lit(seed), F.col(key) if isinstance(key, str) else key) % folds).cast("int")


def bootstrap_means(df: DataFrame, key: str, value: str, rounds: int, seed: str) -> DataFrame:
    """Mean of ``value`` in each round of a bootstrap, ``round`` from 0.

    Each row's count in a round is a Poisson draw from the hash of (seed, round, key): a
    resample of any size in one pass of partial sums, without an index join.
    """
    cuts, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    r = df.dropna(subset=[key, value]).select(key, F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = hash_int(F.lit(seed), F.col("round"), F.col(key)) / float(2**32)
    times = F.lit(0)
    for c in cuts:
        times = times + F.when(u >= c, 1).otherwise(0)
    return r.withColumn("times", times).groupBy("round").agg((F.sum(F.col("times") * F.col("x")) / F.sum("times")).alias("mean"))


def order_interval(rounds: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Order statistics of the rounds at both ends, and their mean; a round without rows counts as none."""
    a = (1 - level) / 2
    s = F.array_sort(F.collect_list(value))
    at = lambda p: F.get(s, F.floor(F.lit(p) * (F.count(value) - 1)).cast("int"))
    return rounds.agg(F.count(value).alias("rounds"), F.round(at(a), 6).alias("low"), F.round(F.avg(value), 6).alias("mean"), F.round(at(1 - a), 6).alias("high"))


def linear_interval(rounds: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return rounds.agg(F.count(value).alias("rounds"), F.round(F.percentile(value, F.lit(a)), 6).alias("low"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(1 - a)), 6).alias("high"))


def stratified_means(df: DataFrame, stratum: str, key: str, value: str, rounds: int, seed: str) -> DataFrame:
    """Per round the means of the strata, weighted by their size; strata are resampled each by itself."""
    d = df.dropna(subset=[stratum, key, value])
    per = d.groupBy(stratum).agg(F.count("*").alias("n"))
    r = d.select(stratum, key, F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    # two draws decide with which weight a row counts: exponential weights, by hash
    u = (hash_int(F.lit(seed), F.col("round"), F.col(key)) + 1) / float(2**32 + 1)
    m = r.withColumn("w", -F.log(u)).groupBy(stratum, "round").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    return m.join(per, stratum).groupBy("round").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


def resampled_means(df: DataFrame, key: str, value: str, rounds: int, seed: int, stratum: str | None = None, most: int = 4096) -> DataFrame:
    """Mean of each round of a resample with replacement, of each stratum as many rows as it has (their means weighted by size).

    Rows are dealt to blocks of about ``most``; how many draws a block has in a round follows from the
    seed and the blocks' sizes alone, so that the blocks draw apart from each other.
    """
    d = df.dropna(subset=[key, value]).select(F.col(stratum).cast("string").alias("s") if stratum else F.lit("").alias("s"), F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("s is not null")
    per = {r.s: r.n for r in d.groupBy("s").agg(F.count("*").alias("n")).collect()}
    if not per:
        return df.sparkSession.createDataFrame([], "round int, mean double")
    blocks = F.create_map(*(c for s, n in per.items() for c in (F.lit(s), F.lit(-(-n // most)))))
    d = d.withColumn("b", (hash_int(F.lit(f"block{seed}"), F.col("k")) % F.get(F.array(blocks[F.col("s")]), F.lit(0))).cast("int"))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in d.groupBy("s", "b").agg(F.count("*").alias("n")).orderBy("s", "b").collect():
        sizes.setdefault(r.s, []).append((r.b, r.n))
    order = {s: i for i, s in enumerate(sorted(sizes))}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, b = pdf["s"].iloc[0], int(pdf["b"].iloc[0])
        x = pdf.sort_values("k", kind="stable")["x"].to_numpy()
        n = np.asarray([m for _, m in sizes[s]])
        place = [i for i, _ in sizes[s]].index(b)
        shared, own = np.random.default_rng([seed, order[s]]), np.random.default_rng([seed, order[s], b + 1])
        out = np.empty(rounds)
        for at in range(0, rounds, 500):
            m = shared.multinomial(n.sum(), n / n.sum(), size=min(500, rounds - at))[:, place]
            drawn = np.concatenate(([0.0], np.cumsum(x[own.integers(0, len(x), m.sum())])))
            ends = np.cumsum(m)
            out[at : at + len(m)] = drawn[ends] - drawn[ends - m]
        return pd.DataFrame({"round": np.arange(rounds, dtype=np.int32), "x": out})

    total = sum(per.values())
    return d.groupBy("s", "b").applyInPandas(run, "round int, x double").groupBy("round").agg((F.sum("x") / total).alias("mean"))


def bounds(df: DataFrame, value: str, delta: float = 0.05, width: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Lower bounds of a mean of values in a range of ``width``: Hoeffding and empirical Bernstein. One row a group."""
    n, m, v = F.count(value), F.avg(value), F.var_samp(value)
    log = math.log(2 / delta)
    s = df.groupBy(*(by or [])).agg(n.alias("n"), m.alias("mean"), F.coalesce(v, F.lit(0.0)).alias("var")).where("n > 0")
    h = F.col("mean") - width * F.sqrt(F.lit(math.log(1 / delta)) / (2 * F.col("n")))
    b = F.when(F.col("n") > 1, F.col("mean") - F.sqrt(2 * F.col("var") * log / F.col("n")) - 7 * width * log / (3 * (F.col("n") - 1)))
    return s.select(*(by or []), "n", F.round("mean", 6).alias("mean"), F.round(h, 6).alias("hoeffding"), F.round(b, 6).alias("bernstein"))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the regularised incomplete beta function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)

    def tail(t: float) -> float:
        x = df / (df + t * t)
        return 0.5 * _beta(df / 2, 0.5, x)

    low, high = 0.0, 1.0
    while tail(high) > 1 - p and high < 1e8:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
    return (low + high) / 2


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    c, d, f = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


NOISE = ("normal", "uniform", "laplace", "skewed", "t5")


def _noise(rng: np.random.Generator, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    """Draws with mean 0 and variance 1."""
    if kind == "uniform":
        return rng.uniform(-math.sqrt(3), math.sqrt(3), shape)
    if kind == "laplace":
        return rng.laplace(0, 1 / math.sqrt(2), shape)
    if kind == "skewed":
        return rng.exponential(1.0, shape) - 1
    if kind == "t5":
        return rng.standard_t(5, shape) / math.sqrt(5 / 3)
    return rng.standard_normal(shape)


def simulate_gate(spark, clusters: tuple[int, ...], effects: tuple[float, ...], correlation: tuple[float, ...], kinds: tuple[str, ...] = ("normal",), members: int = 3, replications: int = 2000, rounds: int = 200, tasks: int = 8, seed: int = 1) -> DataFrame:
    """How often a gate "lower bound over 0" passes, by an interval that takes members as independent and one that doesn't.

    Per cell of the grid (clusters, effect, correlation, noise): promotion rates of the
    naive and the clustered percentile bootstrap and of the t interval over clusters. The
    replications of a cell are dealt out to tasks by number; each has a generator of its own.
    """
    grid = [(n, float(e), float(r), k, t) for n in clusters for e in effects for r in correlation for k in kinds for t in range(tasks)]
    cells = spark.createDataFrame(grid, "clusters int, effect double, rho double, noise string, task int").repartition(min(len(grid), 200), "clusters", "effect", "rho", "noise", "task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, e, r, k, t in pdf.itertuples(index=False):
                own = replications // tasks + (t < replications % tasks)
                rng = np.random.default_rng([seed, n, int(e * 1e6), int(r * 1e6), NOISE.index(k), t])
                x = e + math.sqrt(r) * _noise(rng, k, (own, n, 1)) + math.sqrt(1 - r) * _noise(rng, k, (own, n, members))
                flat, mean = x.reshape(own, -1), x.mean(axis=2)
                order = int(0.025 * (rounds - 1))
                naive = np.zeros(own)
                clustered = np.zeros(own)
                for i in range(own):
                    pick = rng.integers(0, flat.shape[1], (rounds, flat.shape[1]))
                    naive[i] = np.partition(flat[i][pick].mean(axis=1), order)[order]
                    pick = rng.integers(0, n, (rounds, n))
                    clustered[i] = np.partition(mean[i][pick].mean(axis=1), order)[order]
                bound = mean.mean(axis=1) - t_quantile(0.975, n - 1) * mean.std(axis=1, ddof=1) / math.sqrt(n)
                rows.append((n, e, r, k, own, int((naive > 0).sum()), int((clustered > 0).sum()), int((bound > 0).sum())))
            yield pd.DataFrame(rows, columns=["clusters", "effect", "rho", "noise", "n", "naive", "clustered", "t"])

    out = cells.mapInPandas(run, "clusters int, effect double, rho double, noise string, n long, naive long, clustered long, t long")
    rate = lambda c: F.round(F.sum(c) / F.sum("n"), 6).alias(c)
    return out.groupBy("clusters", "effect", "rho", "noise").agg(F.sum("n").alias("replications"), rate("naive"), rate("clustered"), rate("t"))


def _strata_summary(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values [..., member] per stratum: mean weighted by size, its standard error, and Welch's degrees of freedom."""
    total = sum(g.shape[-1] for g in groups)
    mean, var, low = 0.0, 0.0, 0.0
    for g in groups:
        n = g.shape[-1]
        own = (n / total) ** 2 * g.var(axis=-1, ddof=1) / n
        mean, var, low = mean + n / total * g.mean(axis=-1), var + own, low + own**2 / (n - 1)
    return mean, np.sqrt(var), np.where(low > 0, var**2 / np.where(low > 0, low, 1), np.inf)


def interval_methods(spark, strata: tuple[int, ...] = (3, 5, 7), multipliers: tuple[int, ...] = (1, 2, 3, 4), kinds: tuple[str, ...] = NOISE, effects: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), replications: int = 5_000, rounds: int = 1_000, tasks: int = 8, seed: int = 1) -> DataFrame:
    """How often the lower end of a 95 % interval of a stratified mean is over 0, per size, noise, true effect and method.

    Methods: percentile bootstrap within strata, Welch's t over strata, bootstrap-t within strata. Columns ``n, noise, effect, method, replications, rate``.
    The bounds of effect 0 are drawn once; an effect moves them. Replications are dealt out to tasks, each with a generator of its own.
    """
    grid = [(m, k, t) for m in multipliers for k in kinds for t in range(tasks)]
    cells = spark.createDataFrame(grid, "multiplier int, noise string, task int").repartition(min(len(grid), 200), "multiplier", "noise", "task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, k, t in pdf.itertuples(index=False):
                own = replications // tasks + (t < replications % tasks)
                rng = np.random.default_rng([seed, m, NOISE.index(k), t])
                sizes = [s * m for s in strata]
                bounds: dict[str, list[np.ndarray]] = {"percentile": [], "welch_t": [], "bootstrap_t": []}
                quantiles: dict[float, float] = {}
                for at in range(0, own, 20):
                    count = min(20, own - at)
                    groups = [_noise(rng, k, (count, n)) for n in sizes]
                    mean, error, freedom = _strata_summary(groups)
                    q = [quantiles.setdefault(f, t_quantile(0.975, f)) for f in np.minimum(freedom, 1e6).round(1).tolist()]
                    bounds["welch_t"].append(mean - np.asarray(q) * error)
                    again = [np.take_along_axis(g[:, None, :], rng.integers(0, n, (count, rounds, n)), axis=2) for g, n in zip(groups, sizes)]
                    means, errors, _ = _strata_summary(again)
                    bounds["percentile"].append(np.quantile(means, 0.025, axis=1, method="lower"))
                    apart = means - mean[:, None]
                    stat = np.where(errors > 0, apart / np.where(errors > 0, errors, 1), np.where(apart > 0, np.inf, -np.inf))
                    high = np.quantile(np.where(apart == 0, 0.0, stat), 0.975, axis=1, method="lower")
                    bounds["bootstrap_t"].append(np.where(np.isfinite(high), mean - high * error, -np.inf))
                for method, b in bounds.items():
                    low = np.concatenate(b)
                    rows += [(sum(sizes), k, e, method, own, int((low + e > 0).sum())) for e in effects]
            yield pd.DataFrame(rows, columns=["n", "noise", "effect", "method", "replications", "passed"])

    out = cells.mapInPandas(run, "n int, noise string, effect double, method string, replications long, passed long")
    return out.groupBy("n", "noise", "effect", "method").agg(F.sum("replications").alias("replications"), F.round(F.sum("passed") / F.sum("replications"), 6).alias("rate"))


def power_summary(rates: DataFrame, power: float = 0.8) -> DataFrame:
    """Per noise and method: the least ``n`` that reaches the power for each true effect (``smallest_n``), and the least effect each ``n`` reaches it for
    (``detectable``), null where none does. One row per noise, method and kind of answer (``of``: the effect or the n)."""
    ok = F.col("rate") >= power
    own = rates.where("effect > 0")
    a = own.groupBy("noise", "method", F.col("effect").cast("string").alias("of")).agg(F.min(F.when(ok, F.col("n"))).cast("double").alias("answer")).withColumn("kind", F.lit("smallest_n"))
    b = own.groupBy("noise", "method", F.col("n").cast("string").alias("of")).agg(F.min(F.when(ok, F.col("effect"))).alias("answer")).withColumn("kind", F.lit("detectable"))
    return a.unionByName(b).select("noise", "method", "kind", "of", "answer")

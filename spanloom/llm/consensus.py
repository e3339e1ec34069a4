"""Problem 4: consensus from several annotators' labels.

Minimax conditional entropy: of an item with label c, a vote of source j at confidence
level b is k with probability proportional to exp(source[j, b][c, k] + item[i][c, k]). The
objective is the regularised dual: the log likelihood of the votes less the squares of the
parameters, half ``SOURCE_WEIGHT`` and half ``ITEM_WEIGHT`` of them. It rises with each
step: label posteriors in closed form, then the parameters of an item or a source, each by
the root of a bound of the objective in that coordinate (all cells of a row at once, as the
probabilities of a row sum to 1). A step is a pass over the items. An item's parameters
follow from those of the sources, so they are fitted anew in each pass, and never stored.

Confidences are levels of a source, not weights: what a source says at .4 has a table of its
own. Sources that copy one another (their errors agree far more often than their own
tables make likely) count together as one voter on an item. Agreement is reported apart from
the model, from the votes alone. Source names are compared without case, blanks at the
ends and kind of separator. A vote is a distinct (item, source, type) of both tables with the
mean of its confidences; null sources, types and items are no votes, a null confidence
is a level. An item with no vote at all gets a null label and agreement. Ties go to the
first type by name.

Workers hold the items of a batch and the tables of the sources; the driver gets, per source and level,
two tables of label by label. Their size is checked against ``CELLS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut

#: Passes at most, steps of the item parameters in a pass, and the relative rise at which to stop.
ROUNDS, INNER, TOLERANCE = 20, 2, 3e-4
ITEM_WEIGHT, SOURCE_WEIGHT = 4.0, 1.0
#: Levels of confidence: tenths from .4 to .8 and beyond, and one for null.
LOW, HIGH = 4, 8
LEVELS = HIGH - LOW + 2
#: Share of the errors beyond chance that two sources make alike if one copies, of so many errors at least.
COPY, ERRORS = 0.6, 30
#: Numbers in the tables of all sources, and in the votes of a batch.
CELLS = 4_000_000


def source_name(c: Column) -> Column:
    """One spelling of a source name."""
    return F.lower(F.regexp_replace(F.trim(c), r"[\s\-]+", "_"))


def votes(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct ``item_id, source, type`` of both tables with the mean ``confidence``; what is no vote is one row of its item with null source and type."""
    a = proposals.select("item_id", source_name(F.col("source")).alias("source"), "type", F.col("confidence").cast("double").alias("confidence"))
    each = F.explode_outer(F.arrays_zip(F.col("sources").alias("source"), F.coalesce("confidences", F.array().cast("array<double>")).alias("confidence"))).alias("x")
    b = evidence.select("item_id", "type", each).select("item_id", source_name(F.col("x.source")).alias("source"), "type", F.col("x.confidence").cast("double").alias("confidence"))
    known = F.col("source").isNotNull() & (F.col("source") != "") & F.col("type").isNotNull()
    both = a.unionByName(b).where("item_id is not null").select("item_id", F.when(known, F.col("source")).alias("source"), F.when(known, F.col("type")).alias("type"), "confidence")
    return both.groupBy("item_id", "source", "type").agg(F.round(F.avg(F.nanvl("confidence", F.lit(None).cast("double"))), 6).alias("confidence"))


def level(c: Column) -> Column:
    """Number of the level of a confidence; 0 for null."""
    tenth = F.floor(F.round(c * 10, 5)).cast("int")
    return F.coalesce(F.least(F.greatest(tenth, F.lit(LOW)), F.lit(HIGH)) - LOW + 1, F.lit(0))


def ascend(seen: np.ndarray, due: np.ndarray, value: np.ndarray, weight: float, steps: int = 5) -> np.ndarray:
    """By how much to move parameters: the root of ``seen - due * exp(x) - weight * (value + x)``, within 3."""
    x = np.zeros_like(value)
    for _ in range(steps):
        e = due * np.exp(x)
        x = np.clip(x + (seen - e - weight * (value + x)) / (e + weight), -3, 3)
    return x


class Batch:
    """The votes of some items, one after the other: number of the item, voter (source and level), vote, weight.

    Items of fewer votes come first; ``order`` says which they were.
    """

    def __init__(self, voters: pa.ListArray, votes: pa.ListArray, members: np.ndarray):
        size = np.diff(voters.offsets.to_numpy())
        self.n = len(size)
        self.order = np.argsort(size, kind="stable")
        first = (np.cumsum(size) - size)[self.order]
        size = size[self.order]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(first - begin, size)
        self.item = np.repeat(np.arange(self.n), size)
        cut = np.flatnonzero(np.diff(size, prepend=-1, append=-1))
        self.blocks = [(begin[a], int(size[a]), int(b - a)) for a, b in zip(cut[:-1], cut[1:])]
        self.voter, self.vote = voters.flatten().to_numpy()[at], votes.flatten().to_numpy()[at]
        self.source = self.voter // LEVELS
        # members of a group of copies share one vote on an item
        group = members[self.source]
        _, at, n = np.unique(self.item * (len(members) + 1) + group, return_inverse=True, return_counts=True)
        shared = np.bincount(members, minlength=len(members) + 1)[group] > 1
        self.weight = np.where(shared, 1.0 / n[at], 1.0)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums per item."""
        return np.concatenate([x[a : a + n * k].reshape(k, n, *x.shape[1:]).sum(axis=1) for a, n, k in self.blocks])

    def fit(self, source: np.ndarray, prior: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors, item parameters, weighted probabilities of all votes, and the objective per item without that of the sources."""
        t, m = len(prior), len(self.vote)
        tables = np.exp(source).astype(np.float32)
        weight = self.weight.astype(np.float32)
        item = np.zeros((self.n, t, t), np.float32)
        one = np.zeros((m, t), np.float32)
        one[np.arange(m), self.vote] = self.weight
        cast = self.total(one)
        for step in range(inner + 1):
            p = tables[self.voter] * np.exp(item)[self.item]
            p /= p.sum(axis=2, keepdims=True)
            like = self.total(np.log(p[np.arange(m), :, self.vote].astype(float) + 1e-30) * self.weight[:, None]) + np.log(prior)
            top = like.max(axis=1, keepdims=True)
            q = np.exp(like - top)
            value = np.log(q.sum(axis=1)) + top[:, 0] - ITEM_WEIGHT / 2 * np.square(item, dtype=float).sum(axis=(1, 2))
            q /= q.sum(axis=1, keepdims=True)
            p *= weight[:, None, None]
            if step < inner:
                share = q.astype(np.float32)[:, :, None]
                item += ascend(share * cast[:, None, :], share * self.total(p), item, np.float32(ITEM_WEIGHT), 3)
        return q, item, p, value


def _batches(batches: Iterator[pa.RecordBatch], types: int, members: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("voters").offsets.to_numpy())) * types * types
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CELLS, side="right")))
            part = batch.slice(at, to - at)
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
            yield part, Batch(part.column("voters"), part.column("votes"), members)
            at = to


def _by_row(row: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Adds each row of ``x`` to the row of ``out`` it belongs to."""
    order = np.argsort(row, kind="stable")
    cut = np.flatnonzero(np.diff(row[order], prepend=-1))
    x = x[order]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
        out[row[order[a]]] += x[a:b].sum(axis=0)


class Model:
    """What the driver holds: names, source parameters, prior, groups of copies, the objective after each pass."""

    def __init__(self, sources: list[str], types: list[str]):
        self.sources, self.types = sources, types
        s, t = len(sources), len(types)
        self.source = np.zeros((s * LEVELS, t, t))
        self.source[:, range(t), range(t)] = 1.5  # at first a vote is right more often than not
        self.prior = np.full(t, 1 / max(t, 1))
        self.members = np.arange(s)
        self.objective: list[float] = []

    def pass_over(self, items: DataFrame, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Sums over all items of seen and expected votes, by voter, label and vote, of the posteriors, and the objective."""
        source, prior, members = self.source, self.prior, self.members

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, due, mass, value = np.zeros(source.shape), np.zeros(source.shape), np.zeros(len(prior)), 0.0
            for _, b in _batches(batches, len(prior), members):
                q, _, p, own = b.fit(source, prior, inner)
                each = q[b.item]
                cast = np.zeros((len(source) * len(prior), len(prior)))
                _by_row(b.voter * len(prior) + b.vote, each * b.weight[:, None], cast)
                seen += cast.reshape(source.shape).swapaxes(1, 2)
                _by_row(b.voter, (each[:, :, None] * p).reshape(len(p), -1), due.reshape(len(source), -1))
                mass += q.sum(axis=0)
                value += own.sum()
            cells = np.flatnonzero((seen.ravel() != 0) | (due.ravel() != 0))
            labels = -2 - np.arange(len(prior))  # below the cells: the objective, then the labels
            a = [np.concatenate((cells, [-1], labels)).astype(np.int32), np.concatenate((seen.ravel()[cells], [value], mass)), np.concatenate((due.ravel()[cells], [0.0], 0 * mass))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in a], names=["k", "a", "b"])

        got = items.mapInArrow(run, "k int, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        seen, due, mass, value = np.zeros(source.size), np.zeros(source.size), np.zeros(len(prior)), 0.0
        for r in got.collect():  # CELLS at most
            if r.k == -1:
                value = r.a
            elif r.k < 0:
                mass[-2 - r.k] = r.a
            else:
                seen[r.k], due[r.k] = r.a, r.b
        value += np.log(prior).sum() - SOURCE_WEIGHT / 2 * (source**2).sum()
        return seen.reshape(source.shape), due.reshape(source.shape), mass, float(value)

    def by_source(self, seen: np.ndarray) -> np.ndarray:
        return seen.reshape(len(self.sources), LEVELS, *seen.shape[1:]).sum(axis=1)

    def find_copies(self, items: DataFrame, seen: np.ndarray) -> None:
        """Sources whose shared errors are alike more often than their own tables of errors make likely count as one."""
        source, prior, members, s, t = self.source, self.prior, self.members, len(self.sources), len(self.types)
        wrong = self.by_source(seen)
        wrong[:, range(t), range(t)] = 0
        wrong = wrong / np.maximum(wrong.sum(axis=2, keepdims=True), 1e-9)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both, same, chance = np.zeros((s, s)), np.zeros((s, s)), np.zeros((s, s))
            for _, b in _batches(batches, max(t, s), members):
                q, *_ = b.fit(source, prior)
                best = q.argmax(axis=1)
                err = (b.vote != best[b.item]) & (q.max(axis=1) > 0.6)[b.item]
                label = np.full((b.n, s), -1)
                label[b.item[err], b.source[err]] = b.vote[err]
                for x in range(t):
                    hit = (label == x).astype(float)
                    same += hit.T @ hit
                    hit = (label[best == x] >= 0).astype(float)
                    meet = hit.T @ hit
                    both += meet
                    chance += meet * (wrong[:, x] @ wrong[:, x].T)
            out = [np.arange(s * s, dtype=np.int32), both.ravel(), same.ravel(), chance.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["k", "a", "b", "c"])

        sums = (F.sum(c).alias(c) for c in "abc")
        for r in items.mapInArrow(run, "k int, a double, b double, c double").groupBy("k").agg(*sums).orderBy("k").collect():  # sources squared, CELLS at most
            i, j = divmod(r.k, s)
            if j < i and r.a >= ERRORS and r.b - r.c >= COPY * (r.a - r.c) > 0:
                low, high = sorted((self.members[i], self.members[j]))
                self.members = np.where(self.members == high, low, self.members)

    def fit(self, items: DataFrame) -> Model:
        for step in range(ROUNDS):
            # at first, while labels are from plain sources, items have no parameters of their own
            seen, due, mass, value = self.pass_over(items, INNER if step > 2 else 0)
            self.objective.append(value)
            self.source = self.source + ascend(seen, due, self.source, SOURCE_WEIGHT)
            if step == 2:
                self.find_copies(items, seen)
                self.objective.clear()  # votes weigh otherwise from here on
            elif len(self.objective) > 1 and value - self.objective[-2] < TOLERANCE * abs(value):
                break
            self.prior = (mass + 1) / (mass + 1).sum()
        return self

    def reliability(self, items: DataFrame) -> list[tuple[str, float, float, str]]:
        seen = self.by_source(self.pass_over(items)[0])
        total = seen.sum(axis=(1, 2))
        right = np.trace(seen, axis1=1, axis2=2)
        names = {g: "+".join(s for s, m in zip(self.sources, self.members) if m == g) for g in self.members.tolist()}
        return [(s, float(round(total[j], 3)), float(round(right[j] / max(total[j], 1e-9), 6)), names[self.members[j]]) for j, s in enumerate(self.sources)]


def _prepare(cast: DataFrame) -> tuple[DataFrame, Model]:
    rows = cast.where("source is not null").groupBy("source", "type").count().limit(CELLS + 1).collect()
    sources, types = sorted({r.source for r in rows}), sorted({r.type for r in rows})
    if max(len(sources) * LEVELS * len(types) ** 2, len(sources) ** 2) > CELLS:
        raise ValueError(f"{len(sources)} sources and {len(types)} types; their tables would have over {CELLS} cells")
    number = lambda names, c: F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))[F.col(c)] if names else F.lit(0)
    numbered = F.struct((number(sources, "source") * LEVELS + level(F.col("confidence"))).alias("voter"), number(types, "type").alias("vote"))
    # an item has at most a vote or two a source, or none
    each = F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), numbered)))
    items = cast.groupBy("item_id").agg(each.alias("v")).select(F.col("item_id").cast("bigint"), F.col("v.voter").alias("voters"), F.col("v.vote").alias("votes"))
    return cut(items), Model(sources, types)


def consensus(proposals: DataFrame, evidence: DataFrame, sources: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``item_id, label, confidence, agreement`` of each item, and (if asked for) ``source, votes, reliability, copies`` of each source."""
    spark = proposals.sparkSession
    items, model = _prepare(votes(proposals, evidence))
    if model.sources:
        model.fit(items.where(F.size("voters") > 0))
    source, prior, members, types = model.source, model.prior, model.members, model.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in _batches(batches, len(types), members):
            q = b.fit(source, prior)[0]
            one = np.zeros((len(b.vote), len(types)))
            one[np.arange(len(b.vote)), b.vote] = 1
            each = b.total(one)
            n = each.sum(axis=1)
            pairs = (each * (each - 1)).sum(axis=1)
            agreement = pa.array((pairs / np.maximum(n * (n - 1), 1)).round(6), mask=n < 2)  # one vote has no agreement
            labels = pa.array(types).take(pa.array(q.argmax(axis=1), mask=n == 0))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(b.order)), labels, pa.array(q.max(axis=1).round(6), mask=n == 0), agreement], names=["item_id", "label", "confidence", "agreement"])

    kind = "item_id bigint, label string, confidence double, agreement double"
    found = items.mapInArrow(run, kind) if types else items.select("item_id", *(F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("confidence", "double"), ("agreement", "double"))))
    if not sources:
        return found, None
    rows = model.reliability(items.where(F.size("voters") > 0)) if model.sources else []
    return found, spark.createDataFrame(rows, "source string, votes double, reliability double, copies string")

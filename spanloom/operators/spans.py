"""Interval algebra over spans ``record_id, start, end, type``.

A span without record, bounds or type takes part in no interval join; an empty or
reversed span overlaps nothing. Joins run over distinct spans, and a span is dealt to
bins of its record, so a record with very many spans is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import overlap, overlap_ratio

#: Code points of a bin; spans are mostly shorter.
BIN = 64
KEY = ["record_id", "start", "end", "type"]


def keys(spans: DataFrame, *more: str) -> DataFrame:
    """Distinct complete spans."""
    return spans.select(*KEY, *more).dropna(subset=KEY).where(F.col("start") < F.col("end")).distinct()


def _binned(df: DataFrame) -> DataFrame:
    return df.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {BIN}"), F.expr(f"(`end` - 1) div {BIN}"))))


def overlapping(left: DataFrame, right: DataFrame, same_type: bool = False) -> DataFrame:
    """Each pair of distinct spans of one record that share a code point, as ``l`` and ``r`` columns, once."""
    a = _binned(keys(left)).select("record_id", "bin", *(F.col(c).alias(f"l_{c}") for c in KEY[1:]))
    b = _binned(keys(right)).select("record_id", "bin", *(F.col(c).alias(f"r_{c}") for c in KEY[1:]))
    pairs = a.join(b, ["record_id", "bin"]).where("l_start < r_end and r_start < l_end")
    if same_type:
        pairs = pairs.where("l_type = r_type")
    # a pair shows in each bin that it shares; the bin where the later one begins is its own
    return pairs.where(F.col("bin") == F.expr(f"greatest(l_start, r_start) div {BIN}")).drop("bin")


def relation(left: DataFrame, base: DataFrame) -> DataFrame:
    """Of each distinct span of ``left``, how it stands to all spans of ``base`` it meets, by precedence."""
    hits = overlapping(left, base)
    inside = (F.col("r_start") <= F.col("l_start")) & (F.col("l_end") <= F.col("r_end"))
    around = (F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end"))
    same = F.col("l_type") == F.col("r_type")
    found = hits.groupBy("record_id", *(F.col(f"l_{c}").alias(c) for c in KEY[1:])).agg(
        F.max(same & inside).alias("inside"), F.max(same & around).alias("around"), F.max(same).alias("same")
    )
    kind = (
        F.when(F.col("same").isNull(), "disjoint").when(F.col("inside"), "contained_same_type").when(F.col("around"), "contains_same_type")
        .when(~F.col("same"), "cross_type").otherwise("partial_same_type")
    )
    return keys(left).join(found, KEY, "left").select(*KEY, kind.alias("relation"))


def disjoint(left: DataFrame, base: DataFrame, same_type: bool = False) -> DataFrame:
    """Distinct spans of ``left`` that meet no span of ``base`` (of the same type)."""
    hits = overlapping(left, base, same_type).select("record_id", *(F.col(f"l_{c}").alias(c) for c in KEY[1:])).distinct()
    return keys(left).join(hits, KEY, "left_anti")


def agreeing(left: DataFrame, other: DataFrame, least: float = 0.5, of: str = "shorter") -> DataFrame:
    """Distinct spans of ``left`` that a span of the same type covers to ``least`` of the shorter (longer) one."""
    hits = overlapping(left, other, same_type=True)
    enough = overlap_ratio(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"), of) >= least
    return hits.where(enough).select("record_id", *(F.col(f"l_{c}").alias(c) for c in KEY[1:])).distinct()


def _islands(spans: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """``island`` of each row: rows of a group that a chain of overlaps joins, so that no choice reaches beyond it."""
    w = Window.partitionBy(*by).orderBy(start, end)
    ends = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("island", F.sum(F.when(start < ends, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _in_turn(rows: DataFrame, by: list[str], rank: str, read: list[str], choose: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows that are chosen when those of each group (``by``) come in order of ``rank``, one after the other as sorted partitions stream by.

    ``choose()`` begins a group and gives a function of the columns ``read``; it keeps what it needs of the rows before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        take = choose()
        for batch in batches:
            keys_, values = (list(zip(*(batch.column(c).to_pylist() for c in cs))) for cs in (by, read))
            mask = []
            for key, value in zip(keys_, values):
                if key != last:
                    last, take = key, choose()
                mask.append(take(*value))
            yield batch.filter(pa.array(mask, pa.bool_()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*by).sortWithinPartitions(*by, rank).mapInArrow(run, kind)


def _apart() -> Callable[[int, int], bool]:
    """Takes spans that meet none it took before."""
    starts: list[int] = []
    ends: list[int] = []

    def take(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        if (i and ends[i - 1] > a) or (i < len(starts) and starts[i] < b):
            return False
        starts.insert(i, a)
        ends.insert(i, b)
        return True

    return take


def _unused() -> Callable[[int, int, int, int], bool]:
    """Takes pairs of spans neither of which it took before."""
    left: set[tuple[int, int]] = set()
    right: set[tuple[int, int]] = set()

    def take(a: int, b: int, c: int, d: int) -> bool:
        if (a, b) in left or (c, d) in right:
            return False
        left.add((a, b))
        right.add((c, d))
        return True

    return take


def greedy(spans: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Spans kept when each is taken in ``order`` unless it meets one already taken in its group.

    A group is first cut into islands that no span crosses; the distinct spans of an island stream by in order and meet the taken ones by bisection.
    Repeated spans count once, with their first place.
    """
    s = spans.where(F.col("start") < F.col("end")).withColumn("rank_key", F.struct(*order))
    s = s.groupBy(*by, "start", "end").agg(F.min(F.struct("rank_key", F.struct(*(c for c in s.columns if c not in (*by, "start", "end", "rank_key"))).alias("row"))).alias("x"))
    s = _islands(s, by, F.col("start"), F.col("end"))
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "island").orderBy("x.rank_key", "start", "end"))).select(*by, "island", "rank", "start", "end", "x.row.*")
    return _in_turn(ranked, [*by, "island"], "rank", ["start", "end"], _apart).drop("island", "rank")


def weighted_schedule(spans: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Of each group the spans without overlap whose weights sum to the most; of equal sums the fewest spans, then those that end earlier.

    Weighted interval scheduling within islands that no span crosses, in one pass of sorted
    batches per island, with a pointer per span. Null or negative weights are never taken.
    """
    s = spans.select(*by, "start", "end", weight).where((F.col("start") < F.col("end")) & (F.col(weight) > 0))
    s = s.groupBy(*by, "start", "end").agg(F.max(weight).cast("double").alias(weight))
    s = _islands(s, by, F.col("start"), F.col("end"))

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        rows.sort(key=lambda r: (r[-3], r[-4]))
        finish = [r[-3] for r in rows]
        best = [(0.0, 0)]  # sum and less the spans of the first i rows
        before: list[int] = []
        for i, r in enumerate(rows):
            before.append(bisect_right(finish, r[-4], 0, i))
            x = best[before[i]]
            taken = (x[0] + r[-2], x[1] - 1)
            best.append(taken if (round(taken[0], 9), taken[1]) > (round(best[-1][0], 9), best[-1][1]) else best[-1])
        i, out = len(rows), []
        while i:
            if best[i] == best[i - 1]:
                i -= 1
            else:
                out.append(rows[i - 1])
                i = before[i - 1]
        return reversed(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # islands one after the other, as the sorted rows of a partition come
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        out = []
        for _, island in groupby(rows, key=lambda r: (*r[:-4], r[-1])):
            out += solve(list(island))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = s.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema)
    own = [*by, "island"]
    return s.repartition(*own).sortWithinPartitions(*own).mapInPandas(run, kind).drop("island")


def align(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a true and a found span of the same type that overlap, one to one, and the rest of both sides.

    Pairs are taken greedily per record and type: exact ones, then by overlap over the longer
    span, then by overlap, then the later spans. Columns ``t_start, t_end, f_start, f_end``;
    those of the missing side are null. Pairs stream by in order, island by island.
    """
    pairs = overlapping(truth, found, same_type=True).select(
        "record_id", F.col("l_type").alias("type"), F.col("l_start").alias("t_start"), F.col("l_end").alias("t_end"), F.col("r_start").alias("f_start"), F.col("r_end").alias("f_end")
    )
    shared = overlap(F.col("t_start"), F.col("t_end"), F.col("f_start"), F.col("f_end"))
    longer = F.greatest(F.col("t_end") - F.col("t_start"), F.col("f_end") - F.col("f_start"))
    exact = (F.col("t_start") == F.col("f_start")) & (F.col("t_end") == F.col("f_end"))
    order = [~exact, -(shared / longer), -shared, -F.col("t_start"), -F.col("t_end"), -F.col("f_start"), -F.col("f_end")]
    # pairs of spans far apart don't touch one another's choice
    by = ["record_id", "type"]
    pairs = _islands(pairs, by, F.least("t_start", "f_start"), F.greatest("t_end", "f_end"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "island").orderBy(*order)))
    chosen = _in_turn(ranked, [*by, "island"], "rank", ["t_start", "t_end", "f_start", "f_end"], _unused).drop("island", "rank")
    t = keys(truth).select("record_id", "type", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    f = keys(found).select("record_id", "type", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    left = t.join(chosen, ["record_id", "type", "t_start", "t_end"], "left")
    rest = f.join(chosen, ["record_id", "type", "f_start", "f_end"], "left_anti")
    return left.unionByName(rest, allowMissingColumns=True)


def clip(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans inside each window ``record_id, w_start, w_end`` re-based to it, and a flag on those that cross its edge."""
    w = windows.select("record_id", "w_start", "w_end").dropna().distinct().select("record_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.lit("").alias("type"))
    pairs = overlapping(spans, w)
    crosses = (F.col("l_start") < F.col("r_start")) | (F.col("l_end") > F.col("r_end"))
    return pairs.select(
        "record_id", F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end"), F.col("l_type").alias("type"),
        (F.col("l_start") - F.col("r_start")).alias("start"), (F.col("l_end") - F.col("r_start")).alias("end"), crosses.alias("crosses"),
    )


def merge_islands(tags: DataFrame, by: list[str], at: str, tag: str) -> DataFrame:
    """Runs of neighbouring positions with one tag: first and last position and how many (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(at)
    fresh = (F.lag(tag).over(w).eqNullSafe(F.col(tag)) & (F.lag(at).over(w) == F.col(at) - 1)).cast("int")
    runs = tags.dropna(subset=[at]).dropDuplicates([*by, at]).withColumn("fresh", 1 - F.coalesce(fresh, F.lit(0))).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy(*by, "run", tag).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("run")


"""Interval algebra against brute force and known cases."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from spanloom.operators import spans

SCHEMA = "record_id bigint, start int, `end` int, type string"
S, D = "S", "D"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def some(seed, n=120, records=3):
    r = random.Random(seed)
    out = [(r.randrange(records), a, a + r.randrange(1, 90), r.choice([S, D])) for a in (r.randrange(300) for _ in range(n))]
    return out + out[:5] + [(None, 1, 2, S), (1, None, 5, S), (1, 7, 7, S), (1, 9, 3, D), (1, 4, 8, None)]


def whole(data):
    return sorted({x for x in data if None not in x and x[1] < x[2]})


def test_relation_classes(spark):
    base = table(spark, [(1, 0, 15, S)])
    got = spans.relation(table(spark, [(1, 0, 7, S), (1, 20, 23, S), (1, 0, 7, D), (1, 0, 20, S), (1, 10, 30, S)]), base)
    kinds = {(r.start, r.end, r.type): r.relation for r in got.collect()}
    assert kinds == {(0, 7, S): "contained_same_type", (20, 23, S): "disjoint", (0, 7, D): "cross_type", (0, 20, S): "contains_same_type", (10, 30, S): "partial_same_type"}


def test_overlaps_are_found_once(spark):
    a, b = some(1), some(2)
    got = rows(spans.overlapping(table(spark, a), table(spark, b)), "record_id", "l_start", "l_end", "l_type", "r_start", "r_end", "r_type")
    assert got == sorted((x[0], *x[1:], *y[1:]) for x in whole(a) for y in whole(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_disjoint_and_agreeing(spark):
    a, b = some(3), some(4, 20)
    meets = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    got = rows(spans.disjoint(table(spark, a), table(spark, b)), "record_id", "start", "end", "type")
    assert got == [x for x in whole(a) if not any(meets(x, y) for y in whole(b))]
    half = lambda x, y: meets(x, y) and x[3] == y[3] and (min(x[2], y[2]) - max(x[1], y[1])) >= 0.5 * min(x[2] - x[1], y[2] - y[1])
    assert rows(spans.agreeing(table(spark, a), table(spark, b)), "record_id", "start", "end", "type") == [x for x in whole(a) if any(half(x, y) for y in whole(b))]


def test_greedy_is_the_sequential_rule_at_any_partitioning(spark):
    data = whole(some(5))
    want = []
    first = {}
    for x in sorted(data, key=lambda x: (x[1] - x[2], x[1], x[3])):
        first.setdefault(x[:3], x)
    for x in sorted(first.values(), key=lambda x: (x[1] - x[2], x[1], x[3])):
        if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in want):
            want.append(x)
    order = lambda: [(F.col("start") - F.col("end")).alias("n"), F.col("start").alias("a"), F.col("type").alias("t")]
    for n in (1, 7):
        got = spans.greedy(table(spark, data).repartition(n), ["record_id"], order())
        assert rows(got, "record_id", "start", "end", "type") == sorted(want)


def test_weighted_schedule_is_best(spark):
    r = random.Random(6)
    data = [(i, a, a + r.randrange(1, 12), round(r.random(), 2)) for i in range(4) for a in (r.randrange(30) for _ in range(9))]
    df = spark.createDataFrame(data + [(9, 1, 1, 0.5), (9, 1, 4, None)], "record_id bigint, start int, `end` int, w double")
    got = {}
    for x in spans.weighted_schedule(df, ["record_id"], "w").collect():
        got.setdefault(x.record_id, []).append((x.start, x.end, x.w))
    for i in range(4):
        own = list({(a, b): max(w for j, p, q, w in data if (j, p, q) == (i, a, b)) for j, a, b, _ in data if j == i}.items())
        best = max(
            sum(w for _, w in c) for n in range(len(own) + 1) for c in combinations(own, n) if all(x[1] <= y[0] or y[1] <= x[0] for (x, _), (y, _) in combinations(c, 2))
        )
        assert abs(sum(w for *_, w in got[i]) - best) < 1e-9
        assert all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(got[i], 2))
    assert 9 not in got


def test_align_is_greedy_and_complete(spark):
    a, b = some(7, 40), some(8, 40)
    pairs = [(x, y) for x in whole(a) for y in whole(b) if x[0] == y[0] and x[3] == y[3] and x[1] < y[2] and y[1] < x[2]]
    shared = lambda p: min(p[0][2], p[1][2]) - max(p[0][1], p[1][1])
    pairs.sort(key=lambda p: (p[0][1:3] != p[1][1:3], -shared(p) / max(p[0][2] - p[0][1], p[1][2] - p[1][1]), -shared(p), -p[0][1], -p[0][2], -p[1][1], -p[1][2]))
    used, want = set(), []
    for x, y in pairs:
        if ("t", x) not in used and ("f", y) not in used:
            used |= {("t", x), ("f", y)}
            want.append((x[0], x[3], x[1], x[2], y[1], y[2]))
    want += [(x[0], x[3], x[1], x[2], None, None) for x in whole(a) if ("t", x) not in used] + [(y[0], y[3], None, None, y[1], y[2]) for y in whole(b) if ("f", y) not in used]
    got = [tuple(r[c] for c in ("record_id", "type", "t_start", "t_end", "f_start", "f_end")) for r in spans.align(table(spark, a), table(spark, b)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none, one = table(spark, []), table(spark, [(1, 0, 5, S)])
    assert spans.relation(one, none).first().relation == "disjoint"
    assert spans.overlapping(none, one).count() == spans.disjoint(none, one).count() == spans.align(none, none).count() == 0
    assert rows(spans.align(one, none), "t_start", "t_end") == [(0, 5)]


def test_islands_of_tags(spark):
    df = spark.createDataFrame([(1, 0, "B"), (1, 1, "B"), (1, 2, "O"), (1, 4, "O"), (1, 5, "B"), (2, 0, None), (2, 1, None), (2, None, "B")], "record_id bigint, pos int, tag string")
    assert rows(spans.merge_islands(df.na.fill("-", ["tag"]), ["record_id"], "pos", "tag"), "record_id", "first", "last", "n") == [(1, 0, 1, 2), (1, 2, 2, 1), (1, 4, 4, 1), (1, 5, 5, 1), (2, 0, 1, 2)]

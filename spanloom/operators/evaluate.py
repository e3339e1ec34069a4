"""Scores of predictions against a reference, calibration, thresholds and gates.

Keys with a null part are out on both sides; repeated keys count once. What an empty
side scores is a parameter, since conventions differ.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import jaccard, tokens, word_distance, word_error_rate, words
from spanloom.operators.spans import align

KEY = ["record_id", "start", "end", "type"]
ASSERTED = ("TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC")
CODED = ("CHẨN_ĐOÁN", "THUỐC")


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def prf(gold: DataFrame, found: DataFrame, by: list[str] | None = None, key: list[str] = KEY, empty: float = 0.0) -> DataFrame:
    """Counts, precision, recall and F1 of exact keys, per ``by`` or over all."""
    g = gold.dropna(subset=key).select(*key).distinct().withColumn("g", F.lit(1))
    f = found.dropna(subset=key).select(*key).distinct().withColumn("f", F.lit(1))
    both = g.join(f, key, "full_outer").groupBy(*(by or [])).agg(
        F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count("f").alias("n_found"), F.count("g").alias("n_gold")
    )
    p, r = ratio(F.col("tp"), F.col("n_found"), empty), ratio(F.col("tp"), F.col("n_gold"), empty)
    f1 = F.when(F.col("n_found") + F.col("n_gold") > 0, 2 * F.col("tp") / (F.col("n_found") + F.col("n_gold"))).otherwise(F.lit(empty))
    return both.select(*(by or []), "tp", "n_found", "n_gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _details(spans: DataFrame, side: str) -> DataFrame:
    """One row per key: of several rows the one with the least text, then assertions, then candidates."""
    flat = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    row = F.struct(F.coalesce("text", F.lit("")).alias("text"), flat(F.col("assertions")).alias("assertions"), flat(F.col("candidates")).alias("candidates"))
    out = spans.dropna(subset=KEY).where("start < `end`").groupBy(*KEY).agg(F.min(row).alias("x"))
    return out.select("record_id", "type", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), *(F.col(f"x.{c}").alias(f"{side}_{c}") for c in ("text", "assertions", "candidates")))


def score_pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Each aligned pair and each rest with its text similarity and the Jaccard of assertions and candidates."""
    pairs = align(gold, found)
    t = pairs.join(_details(gold, "t"), ["record_id", "type", "t_start", "t_end"], "left").join(_details(found, "f"), ["record_id", "type", "f_start", "f_end"], "left")
    a, b = words(F.coalesce("t_text", F.lit(""))), words(F.coalesce("f_text", F.lit("")))
    similar = F.when(F.size(a) > 0, 1 - word_distance(a, b) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))
    both = F.col("t_start").isNotNull() & F.col("f_start").isNotNull()
    of = lambda c: F.when(both, c).otherwise(0.0)  # noqa: E731 (a span of one side alone scores nothing)
    return t.select(
        "record_id", "type", "t_start", "f_start", F.round(of(similar), 6).alias("text_score"),
        F.when(F.col("type").isin(*ASSERTED), of(jaccard("t_assertions", "f_assertions"))).alias("assertion_score"),
        F.when(F.col("type").isin(*CODED), of(jaccard("t_candidates", "f_candidates"))).alias("candidate_score"),
        F.when(F.col("type").isin(*CODED), F.size(F.coalesce("t_candidates", F.array())) + 1).alias("candidate_weight"),
    )


def score_records(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per record: mean text and assertion score, weighted candidate score; 1 where there is nothing to score."""
    s = score_pairs(gold, found).groupBy("record_id").agg(
        F.count("*").alias("pairs"), F.avg("text_score").alias("text"), F.avg("assertion_score").alias("assertions"),
        F.sum(F.col("candidate_score") * F.col("candidate_weight")).alias("cs"), F.sum("candidate_weight").alias("cw"),
    )
    one = F.lit(1.0)
    return s.select("record_id", "pairs", F.round(F.coalesce("text", one), 6).alias("text"), F.round(F.coalesce("assertions", one), 6).alias("assertions"), F.round(F.coalesce(F.col("cs") / F.col("cw"), one), 6).alias("candidates"), "cs", "cw")


def score_corpus(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: text and assertions as means over records, candidates weighted over the corpus, final of .3, .3 and .4."""
    r = score_records(gold, found).agg(
        F.count("*").alias("records"), F.avg("text").alias("text"), F.avg("assertions").alias("assertions"), F.coalesce(F.sum("cs") / F.sum("cw"), F.lit(1.0)).alias("candidates")
    )
    final = 0.3 * F.col("text") + 0.3 * F.col("assertions") + 0.4 * F.col("candidates")
    return r.select("records", *(F.round(c, 4).alias(c) for c in ("text", "assertions", "candidates")), F.round(final, 4).alias("final"))


def pair_in_order(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a true and a found span of one type and record, wherever they stand, and the rest of both sides.

    True spans choose one after the other, by position: the found span of the same position, else the one of the least word error rate, then
    the nearest start, then the earlier one; a found span is chosen once. Columns as ``align`` has them. A group is the distinct
    spans of a type in a record; its choice is a fold in one task, over error rates of different texts only.
    """

    def choose(a: pd.Series, b: pd.Series) -> pd.Series:
        def rate(x: list[str], y: list[str]) -> float:
            if not x:
                return float(bool(y))
            last = list(range(len(y) + 1))
            for i, v in enumerate(x, 1):
                row = [i]
                for j, w in enumerate(y, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (v != w)))
                last = row
            return last[-1] / len(x)

        out = []
        for trues, founds in zip(a, b):
            trues, founds = (sorted(((r["start"], r["end"], r["text"], tuple(r["words"])) for r in ([] if x is None else x)), key=lambda r: r[:2]) for x in (trues, founds))
            free, at, known, rows = dict.fromkeys(range(len(founds))), {r[:2]: i for i, r in enumerate(founds)}, {}, []
            for t in trues:
                best = at.get(t[:2])
                if best not in free:
                    def cost(i: int, t: tuple = t) -> tuple:
                        key = (t[3], founds[i][3])
                        if key not in known:
                            known[key] = rate(*key)
                        return known[key], abs(t[0] - founds[i][0]), i

                    best = min(free, key=cost, default=None)
                if best is None:
                    rows.append((t[0], t[1], None, None))
                else:
                    del free[best]
                    rows.append((t[0], t[1], founds[best][0], founds[best][1]))
            rows += [(None, None, founds[i][0], founds[i][1]) for i in free]
            out.append([dict(zip(("t_start", "t_end", "f_start", "f_end"), r)) for r in rows])
        return pd.Series(out)

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = _details(df, "x").select("record_id", "type", F.struct(F.col("x_start").alias("start"), F.col("x_end").alias("end"), F.col("x_text").alias("text"), tokens("x_text").alias("words")).alias("r"))
        return rows.groupBy("record_id", "type").agg(F.collect_list("r").alias(name))

    both = side(gold, "a").join(side(found, "b"), ["record_id", "type"], "full_outer")
    fold = F.pandas_udf(choose, "array<struct<t_start:int,t_end:int,f_start:int,f_end:int>>")
    return both.select("record_id", "type", F.explode(fold("a", "b")).alias("p")).select("record_id", "type", "p.*")


def internal_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per record over pairs taken in order: mean of 1 less the word error rate (0 at least), mean Jaccard of assertions, Jaccard of candidates weighted by
    the true ones and one, and .3, .3 and .4 of them. Spans of one side alone score nothing; records without spans on both sides have no row."""
    pairs = pair_in_order(gold, found)
    t = pairs.join(_details(gold, "t"), ["record_id", "type", "t_start", "t_end"], "left").join(_details(found, "f"), ["record_id", "type", "f_start", "f_end"], "left")
    both = F.col("t_start").isNotNull() & F.col("f_start").isNotNull()
    of = lambda c: F.when(both, c).otherwise(0.0)
    weight = F.size(F.coalesce("t_candidates", F.array())) + 1
    r = t.groupBy("record_id").agg(
        F.count("*").alias("pairs"), F.avg(of(F.greatest(1 - word_error_rate("t_text", "f_text"), F.lit(0.0)))).alias("text"),
        F.avg(of(jaccard("t_assertions", "f_assertions"))).alias("assertions"), (F.sum(of(jaccard("t_candidates", "f_candidates")) * weight) / F.sum(weight)).alias("candidates"),
    )
    final = 0.3 * F.col("text") + 0.3 * F.col("assertions") + 0.4 * F.col("candidates")
    return r.select("record_id", "pairs", *(F.round(c, 6).alias(c) for c in ("text", "assertions", "candidates")), F.round(final, 6).alias("final"))


def internal_macro(scores: DataFrame, records: DataFrame) -> DataFrame:
    """One row: means over all ``records`` (``record_id``) of their scores; a record without spans on either side scores 1."""
    j = records.dropna(subset=["record_id"]).select("record_id").distinct().join(scores, "record_id", "left")
    return j.agg(F.count("*").alias("records"), *(F.round(F.avg(F.coalesce(c, F.lit(1.0))), 4).alias(c) for c in ("text", "assertions", "candidates", "final")))


def threshold_grid(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: taken, right, precision, recall, F1. ``scored`` has ``score`` and ``positive``; nulls are out.

    Scores are counted per step of the grid first, so the sums over thresholds are over a few rows.
    """
    edges = sorted(thresholds)
    step = F.lit(0)
    for t in edges:
        step = step + F.when(F.col("score") >= t, 1).otherwise(0)
    n = scored.dropna(subset=["score", "positive"]).withColumn("step", step).groupBy("step").agg(F.count("*").alias("n"), F.count_if("positive").alias("good"))
    spark = scored.sparkSession
    grid = spark.createDataFrame([(i + 1, t) for i, t in enumerate(edges)], "k int, threshold double")
    total = n.agg(F.sum("good").alias("positives"))
    per = F.broadcast(grid).join(n, n["step"] >= grid["k"], "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"), F.coalesce(F.sum("good"), F.lit(0)).alias("right"))
    per = per.crossJoin(F.broadcast(total))
    p, r = ratio(F.col("right"), F.col("taken"), 0.0), ratio(F.col("right"), F.col("positives"), 0.0)
    f1 = ratio(2 * F.col("right"), F.col("taken") + F.col("positives"), 0.0)
    return per.select("threshold", "taken", "right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def select_threshold(grid: DataFrame, precision: float) -> DataFrame:
    """The best row that keeps the precision: by F1, then precision, then the higher threshold. None: no row."""
    key = F.struct("f1", "precision", "threshold", "taken", "right", "recall")
    out = grid.where(F.col("precision") >= precision).agg(F.max(key).alias("x")).where("x is not null")
    return out.select("x.threshold", "x.taken", "x.right", "x.precision", "x.recall", "x.f1")


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin: rows, mean score, share of positives; the weighted difference is the expected calibration error."""
    s = scored.dropna(subset=["score", "positive"]).where("score between 0 and 1")
    b = F.least(F.floor(F.round(F.col("score") * bins, 9)), F.lit(bins - 1)).cast("int")
    per = s.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg(F.col("positive").cast("int")).alias("rate"))
    total = F.sum("n").over(Window.partitionBy())  # of at most `bins` rows
    return per.select("bin", "n", F.round("score", 6).alias("score"), F.round("rate", 6).alias("rate"), F.round(F.col("n") / total * F.abs(F.col("score") - F.col("rate")), 6).alias("gap"))


def recall_at(ranked: DataFrame, by: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with a gold id among the first k, over all and per ``by``. ``ranked``: ``top`` and ``gold`` arrays."""
    hit = lambda k: F.arrays_overlap(F.slice("top", 1, k), "gold").cast("int")
    sets = ranked.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("queries"), *(F.round(F.avg(hit(k)), 6).alias(f"recall_{k}") for k in ks), F.grouping(by).alias("over_all"))
    return sets


def seen_recall(ranked: DataFrame, seen: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per fold, and within it by whether one of a query's gold ids is ``seen`` (``id``): queries and the share with a gold id among the first k.

    ``ranked``: ``query_id, fold, top, gold``. ``status`` is seen, unseen or all; a status without queries has no row.
    """
    known = ranked.select("query_id", F.explode("gold").alias("id")).join(seen.select("id").dropna().distinct(), "id", "left_semi").select("query_id").distinct().withColumn("known", F.lit(True))
    j = ranked.join(known, "query_id", "left").withColumn("status", F.explode(F.array(F.lit("all"), F.when(F.col("known"), "seen").otherwise("unseen"))))
    hit = lambda k: F.arrays_overlap(F.slice("top", 1, k), "gold").cast("int")
    return j.groupBy("fold", "status").agg(F.count("*").alias("queries"), *(F.round(F.avg(hit(k)), 6).alias(f"recall_{k}") for k in ks))


def prefix_utility(ranked: DataFrame, most: int = 10) -> DataFrame:
    """Mean Jaccard of the first k with the gold set, for each k; ``best`` marks the greatest, the smaller k on ties."""
    k = ranked.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "top", "gold")
    per = k.groupBy("k").agg(F.round(F.avg(jaccard(F.slice("top", F.lit(1), F.col("k")), F.col("gold"))), 6).alias("utility"))
    first = F.row_number().over(Window.partitionBy().orderBy(F.desc("utility"), "k"))  # of `most` rows
    return per.withColumn("best", first == 1)


def reviewer_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: span F1 of two reviewers, and their mean assertion Jaccard over keys of either (a missing side scores 0)."""
    # a key that was delivered very often has few different assertions
    each = lambda s: s.dropna(subset=KEY).select(*KEY, F.explode_outer("assertions").alias("z")).distinct()
    x, y = (each(s).groupBy(*KEY).agg(F.collect_list("z").alias(n)) for s, n in ((a, "x"), (b, "y")))
    j = x.join(y, KEY, "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(
        F.count_if(both).alias("shared"), F.count("x").alias("first"), F.count("y").alias("second"),
        F.round(2 * F.count_if(both) / F.greatest(F.count("x") + F.count("y"), F.lit(1)), 6).alias("span_f1"),
        F.round(F.avg(F.when(both, jaccard("x", "y")).otherwise(0.0)), 6).alias("assertion_jaccard"),
    )


def gates(checks: dict[str, Column], measured: DataFrame) -> DataFrame:
    """Each named check on a one-row table, and whether all passed; a check of nothing (null) fails."""
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))
    out = measured.select(F.explode(rows).alias("x")).select("x.gate", "x.passed")
    return out.withColumn("all_passed", F.min("passed").over(Window.partitionBy()))  # of as many rows as there are checks

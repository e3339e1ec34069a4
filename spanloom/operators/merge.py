"""Merging of annotation snapshots, linking by staged lookups, and tables of decisions.

Spans come as ``record_id, start, end, type`` with further columns; incomplete spans take
no part. Every choice has a full tie-break, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import places as P
from spanloom.functions.text import route as route_of
from spanloom.functions.text import strength as strength_of
from spanloom.operators.spans import KEY, disjoint, keys, overlapping


def _complete(spans: DataFrame) -> DataFrame:
    return spans.dropna(subset=KEY).where(F.col("start") < F.col("end"))


def route(learned: DataFrame, legacy: DataFrame, learned_types: tuple[str, ...]) -> DataFrame:
    """Spans of the learned types from one snapshot and of the other types from the other.

    A learned span that the legacy snapshot has exactly keeps the legacy candidates; other
    learned spans have none. Legacy spans that meet a learned one go. ``source`` says whose.
    """
    a = keys(learned).where(F.col("type").isin(*learned_types))
    b = _complete(legacy).select(*KEY, "candidates").groupBy(*KEY).agg(F.max("candidates").alias("candidates"))
    new = a.join(b, KEY, "left").withColumn("source", F.lit("learned"))
    rest = disjoint(b.where(~F.col("type").isin(*learned_types)), a)
    return new.unionByName(b.join(rest, KEY, "left_semi").withColumn("source", F.lit("legacy")))


def add_disjoint(base: DataFrame, more: DataFrame, same_type: bool = False) -> DataFrame:
    """The base and those further spans that meet none of it."""
    b = keys(base).withColumn("source", F.lit("base"))
    return b.unionByName(disjoint(more, base, same_type).withColumn("source", F.lit("added")))


def three_way(rules: DataFrame, teacher: DataFrame, student: DataFrame, rule_ratio: float = 0.7, teacher_ratio: float = 0.65) -> DataFrame:
    """Student spans with a span of the same type in both other snapshots at the given overlaps, and who agrees.

    ``support`` is 0 to 2; what few support is for review.
    """
    from spanloom.operators.spans import agreeing

    k = keys(student)
    r = agreeing(student, rules, rule_ratio).withColumn("r", F.lit(1))
    t = agreeing(student, teacher, teacher_ratio).withColumn("t", F.lit(1))
    j = k.join(r, KEY, "left").join(t, KEY, "left")
    return j.select(*KEY, (F.coalesce("r", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("support"))


def integrate_boundaries(base: DataFrame, queue: DataFrame) -> DataFrame:
    """Verified spans put into a base: they replace spans of their type that hold or are held by them,
    are added where nothing is, and are skipped where they clash. ``action`` says which: replace, add, keep.
    """
    hits = overlapping(queue, base)
    same = F.col("l_type") == F.col("r_type")
    nested = ((F.col("r_start") <= F.col("l_start")) & (F.col("l_end") <= F.col("r_end"))) | ((F.col("l_start") <= F.col("r_start")) & (F.col("r_end") <= F.col("l_end")))
    left = [F.col(f"l_{c}").alias(c) for c in KEY[1:]]
    state = hits.groupBy("record_id", *left).agg(F.min(same & nested).alias("fits"))
    q = keys(queue).join(state, KEY, "left").withColumn("action", F.when(F.col("fits").isNull(), "add").when(F.col("fits"), "replace").otherwise("skip"))
    gone = hits.where(same & nested).join(q.where("action = 'replace'").select("record_id", *(F.col(c).alias(f"l_{c}") for c in KEY[1:])), ["record_id", *(f"l_{c}" for c in KEY[1:])], "left_semi")
    gone = gone.select("record_id", *(F.col(f"r_{c}").alias(c) for c in KEY[1:])).distinct()
    kept = keys(base).join(gone, KEY, "left_anti").withColumn("action", F.lit("keep"))
    return kept.unionByName(q.where("action <> 'skip'").select(*KEY, "action")).dropDuplicates(KEY)


def split_results(spans: DataFrame, pairs: DataFrame, compound: tuple[str, ...], name: str, value: str) -> DataFrame:
    """Compound results replaced by the name and value spans inside them; other spans stay.

    ``pairs``: ``record_id, name_start, name_end, value_start, value_end``.
    """
    p = pairs.select("record_id", F.explode(F.array(
        F.struct(F.col("name_start").alias("start"), F.col("name_end").alias("end"), F.lit(name).alias("type"), F.col("name_start").alias("a"), F.col("value_end").alias("b")),
        F.struct(F.col("value_start").alias("start"), F.col("value_end").alias("end"), F.lit(value).alias("type"), F.col("name_start").alias("a"), F.col("value_end").alias("b")),
    )).alias("x")).select("record_id", "x.*")
    k = keys(spans)
    whole = p.select("record_id", F.least("a", "start").alias("start"), F.greatest("b", "end").alias("end"), F.lit("").alias("type"))
    inside = overlapping(k.where(F.col("type").isin(*compound)), whole).where("l_start <= r_start and r_end <= l_end and not (l_start = r_start and l_end = r_end and l_type = '')")
    gone = inside.select("record_id", *(F.col(f"l_{c}").alias(c) for c in KEY[1:])).distinct()
    parts = p.select(*KEY).distinct()
    return k.join(gone, KEY, "left_anti").withColumn("source", F.lit("kept")).unionByName(parts.join(k, KEY, "left_anti").withColumn("source", F.lit("split")))


def staged_lookup(mentions: DataFrame, key: str, stages: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Each mention with the codes of the first stage that has its key: ``codes, stage``; ``none`` if no stage has.

    A stage is (name, table ``key, code``, expression of the mention's key at that stage).
    Several codes of a key come sorted. Stages are equi-joins; hot keys are split by the engine.
    """
    m = mentions.select(key).where(F.col(key).isNotNull()).distinct()
    codes, stage = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for i, (name, table, expr) in enumerate(stages):
        t = table.dropna(subset=["key", "code"]).groupBy(F.col("key").alias(f"_k{i}")).agg(F.array_sort(F.collect_set("code")).alias(f"_c{i}"))
        m = m.withColumn(f"_k{i}", expr).join(t, f"_k{i}", "left")
        codes, stage = F.coalesce(codes, F.col(f"_c{i}")), F.coalesce(stage, F.when(F.col(f"_c{i}").isNotNull(), F.lit(name)))
    found = m.select(key, codes.alias("codes"), F.coalesce(stage, F.lit("none")).alias("stage"))
    return mentions.join(found, key, "left")


def best_product(mentions: DataFrame, products: DataFrame) -> DataFrame:
    """Of the products of a mention's ingredient the one with its strength, then most words in common, then least id.

    ``mentions``: ``mention, ingredient, strength``; ``products``: ``ingredient, product, strength, term``.
    A mention with a strength that no product has abstains (null).
    """
    m = mentions.dropna(subset=["mention", "ingredient"]).dropDuplicates(["mention"])
    j = m.join(products.select("ingredient", "product", F.col("strength").alias("p_strength"), "term"), "ingredient")
    exact = F.coalesce(F.col("strength") == F.col("p_strength"), F.lit(False))
    w = lambda c: F.array_distinct(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"))
    common = F.size(F.array_intersect(w(F.col("mention")), w(F.col("term")))) / F.size(F.array_union(w(F.col("mention")), w(F.col("term"))))
    j = j.where(F.col("strength").isNull() | exact)
    best = j.groupBy("mention").agg(F.min(F.struct((~exact).alias("e"), (-F.round(common, 6)).alias("c"), "product")).alias("x"))
    return m.join(best, "mention", "left").select("mention", F.col("x.product").alias("product"))


#: Of names for one drug which comes first, and what a product's kind adds to its score (fixed values).
NAME_RANK = {"IN": 4, "PIN": 3, "MIN": 2, "BN": 1}
PRODUCT_BONUS = {"SCD": 8, "SBD": 7, "SCDF": 5, "SBDF": 4, "SCDG": 3, "SBDG": 2}
_WORDS = r"([a-z0-9'-]+)"


def _runs(df: DataFrame, text: str, most: int = 5) -> DataFrame:
    """Each run of up to ``most`` words of a folded text, as ``run``."""
    words = df.withColumn("_w", F.regexp_extract_all(text, F.lit(_WORDS), F.lit(1)))
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("_w") - i + 1)), lambda n: F.array_join(F.slice("_w", i, n), " ")))))
    return words.where(F.size("_w") > 0).withColumn("run", at).drop("_w").distinct()


def _look_up(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(0))


def product_strengths(products: DataFrame) -> DataFrame:
    """``product, strength``: doses in a product's folded name, and the whole dose of a volume of a concentration ("4 ml x 10 mg/ml" is also 40 mg)."""
    each = F.regexp_extract_all("norm", F.lit(r"(\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|unit))(?:/ml)?\b"), F.lit(1))
    plain = products.select("product", F.explode(each).alias("s")).select("product", F.regexp_replace("s", r"^([0-9.]+)\s*", "$1 ").alias("strength"))
    rule = r"(\d+(?:\.\d+)?)\s*ml\s+.*?(\d+(?:\.\d+)?)\s*(mg|g|mcg)/ml\b"
    of = lambda i: F.regexp_extract("norm", rule, i)
    total = F.regexp_replace(F.round(of(1).try_cast("double") * of(2).try_cast("double"), 6).cast("string"), r"\.0$", "")
    whole = products.where(F.col("norm").rlike(rule)).select("product", F.concat_ws(" ", total, of(3)).alias("strength"))
    return plain.unionByName(whole).distinct()


def resolve_drugs(mentions: DataFrame, names: DataFrame, products: DataFrame, brands: DataFrame, index: DataFrame, strict: bool = False) -> DataFrame:
    """``mention, around, code, stage`` of each distinct folded ``mention`` with what stands ``around`` it (where a route may be), by stages:

    ``index`` where curated or indexed for the ingredient and strength; ``name`` of a mention without a strength; ``product`` of the ingredient with that
    strength and route (by kind and words in common, then the least number); ``name`` again, unless a route is given or ``strict``. The ingredient is the longest
    listed name in the mention, then by kind of name; with a route a brand is its generic. No stage: null.

    ``names``: ``name, code, tty``; ``products``: ``product, tty, norm``; ``brands``: ``code, generic``; ``index``: ``ingredient, strength, code`` (empty strength: none
    given), of which the least code counts. All folded.
    """
    m = mentions.dropna(subset=["mention"]).select("mention", F.coalesce("around", "mention").alias("around")).distinct()
    m = m.withColumn("strength", strength_of("mention")).withColumn("route", route_of("around"))
    listed = names.dropna().withColumn("k", _look_up(F.col("tty"), NAME_RANK))
    best = _runs(m.select("mention").distinct(), "mention").join(listed, F.col("run") == F.col("name")).groupBy("mention").agg(
        F.max(F.struct(F.length("name").alias("n"), "k", "name", "code", "tty")).alias("x")
    )
    j = m.join(best.select("mention", F.col("x.name").alias("name"), F.col("x.code").alias("code"), F.col("x.tty").alias("tty")), "mention", "left")
    j = j.join(brands.dropna().groupBy("code").agg(F.min("generic").alias("generic")), "code", "left")
    j = j.withColumn("ingredient", F.when((F.col("tty") == "BN") & (F.col("route") != ""), F.coalesce("generic", "name")).otherwise(F.col("name")))
    i = index.dropna().groupBy("ingredient", "strength").agg(F.min("code").alias("indexed"))
    j = j.join(i, ["ingredient", "strength"], "left")
    indexed = F.when(F.col("route") == "", F.col("indexed"))
    # products: those whose name has the ingredient as words
    p = _runs(products.dropna().select("product", "tty", "norm"), "norm").withColumnRenamed("run", "ingredient").join(product_strengths(products), "product")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9.]+)"), F.lit(1)))
    also = F.array_compact(F.array(*(F.when(F.array_contains(words(F.col("mention")), k), v) for k, v in (("po", "oral"), ("xl", "extended"), ("xr", "extended"), ("er", "extended"), ("sr", "extended"), ("iv", "injection")))))
    said = F.array_union(words(F.col("mention")), also)
    common = F.size(F.array_intersect(said, words(F.col("norm")))) / F.greatest(F.size(F.array_union(said, words(F.col("norm")))), F.lit(1))
    want = j.where("strength <> '' and ingredient is not null").select("mention", "around", "ingredient", "strength", "route")
    near = want.join(p.withColumnRenamed("tty", "p_tty"), ["ingredient", "strength"]).where((F.col("route") == "") | F.expr("contains(norm, route)"))
    ranked = near.groupBy("mention", "around").agg(F.min(F.struct((-F.round(100 + _look_up(F.col("p_tty"), PRODUCT_BONUS) + 20 * common, 6)).alias("s"), F.col("product").try_cast("bigint").alias("n"), "product")).alias("x"))
    j = j.join(ranked.select("mention", "around", F.col("x.product").alias("product")), ["mention", "around"], "left")
    bare = F.when(F.col("strength") == "", F.col("code"))
    rest = F.when((F.col("route") == "") & (F.lit(not strict) | (F.col("strength") == "")), F.col("code"))
    stage = F.when(indexed.isNotNull(), "index").when(bare.isNotNull(), "name").when(F.col("product").isNotNull(), "product").when(rest.isNotNull(), "name")
    return j.select("mention", "around", F.coalesce(indexed, bare, F.col("product"), rest).alias("code"), stage.alias("stage"))


def longest_contained(mentions: DataFrame, phrases: DataFrame, most: int = 12) -> DataFrame:
    """Of each mention the longest listed phrase that stands in it on word bounds (least on ties): word runs joined to the list."""
    words = F.split(F.trim("mention"), " +")
    m = mentions.where("mention is not null").select("mention").distinct().withColumn("w", words)
    g = m.select("mention", "w", F.posexplode("w").alias("at", "_")).drop("_")
    g = g.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("at")))))
    g = g.select("mention", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("phrase"))
    j = g.join(phrases.where("phrase is not null").select("phrase").distinct(), "phrase")
    return j.groupBy("mention").agg(F.min(F.struct((-F.length("phrase")).alias("n"), "phrase")).alias("x")).select("mention", F.col("x.phrase").alias("phrase"))


def apply_reviews(spans: DataFrame, reviews: DataFrame) -> DataFrame:
    """``span_id, candidates`` without the codes that a review of (type, mention, code) drops; order stays."""
    s = spans.where("span_id is not null").select("span_id", "type", F.lower(F.trim("text")).alias("mention"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    bad = reviews.where("decision = 'drop'").groupBy("type", "mention").agg(F.collect_set("code").alias("bad"))
    j = s.join(bad, ["type", "mention"], "left")
    return j.select("span_id", F.array_except("candidates", F.coalesce("bad", F.array().cast("array<string>"))).alias("candidates"))


def lineage(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """How many keys both snapshots have, and how many one alone: one row."""
    a, b = before.dropna(subset=by).select(*by).distinct().withColumn("a", F.lit(1)), after.dropna(subset=by).select(*by).distinct().withColumn("b", F.lit(1))
    j = a.join(b, by, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("b").isNull()).alias("only_before"), F.count_if(F.col("a").isNull()).alias("only_after"), F.count("*").alias("all"))


def leave_one_out(units: DataFrame, passage: str, record: str, key: list[str]) -> DataFrame:
    """Of each passage's keys that two records or more have, the share of leave-one-record-out views that still give two.

    From counts: without one of its n records a key keeps n - 1.
    """
    n = units.dropna(subset=[passage, record, *key]).groupBy(passage, *key).agg(F.countDistinct(record).alias("n"))
    size = units.dropna(subset=[passage, record]).groupBy(passage).agg(F.countDistinct(record).alias("records"))
    j = n.where("n >= 2").join(size, passage)
    stable = F.when(F.col("n") - 1 >= 2, F.col("records")).otherwise(F.col("records") - F.col("n"))
    return j.groupBy(passage).agg(F.count("*").alias("keys"), F.sum("records").alias("views"), F.sum(stable).alias("stable"))


def folds(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``key, fold, role``: in round i fold i is held out, fold i + 1 validates, the others train."""
    from spanloom.operators.sample import fold

    d = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("fold", fold(key, n, seed))
    r = d.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    role = F.when(F.col("fold") == F.col("round"), "test").when(F.col("fold") == (F.col("round") + 1) % n, "validate").otherwise("train")
    return r.select(key, "round", "fold", role.alias("role"))


def router(queries: DataFrame, by_type: dict[str, DataFrame], default: DataFrame) -> DataFrame:
    """The ranking ``query_id, base_id, rank`` of the table that a query's type names, else the default one."""
    out = default.join(queries.where(~F.col("type").isin(*by_type) | F.col("type").isNull()).select("query_id"), "query_id", "left_semi")
    for kind, ranking in by_type.items():
        out = out.unionByName(ranking.join(queries.where(F.col("type") == kind).select("query_id"), "query_id", "left_semi"))
    return out


def score_shape(scores: Column) -> Column:
    """Struct of what a sorted list of scores looks like: greatest, mean, deviation, first margins, entropy of its softmax."""
    n = F.size(scores)
    s = F.sort_array(scores, asc=False)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    e = F.transform(s, lambda x: F.exp(x - F.get(s, F.lit(0))))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    entropy = -F.aggregate(e, F.lit(0.0), lambda a, x: a + x / z * F.log(x / z))
    margin = lambda i: F.coalesce(F.get(s, F.lit(i)) - F.get(s, F.lit(i + 1)), F.lit(0.0))
    return F.when(n > 0, F.struct(F.round(F.get(s, F.lit(0)), 6).alias("top"), F.round(mean, 6).alias("mean"), F.round(dev, 6).alias("dev"), F.round(margin(0), 6).alias("margin_1"), F.round(margin(1), 6).alias("margin_2"), F.round(entropy, 6).alias("entropy")))


def span_choices(spans: DataFrame, docs: DataFrame, reach: int = 4, most: int = 10) -> DataFrame:
    """Per seed span every run of up to ``most`` words of its line that holds it and goes at most ``reach`` words beyond: count and widest.

    Word bounds come from the line's own words; a seed whose bounds cut words is held by the words it cuts.
    """
    s = spans.dropna(subset=["span_id", "record_id", "start", "end"]).where("start < `end` and start >= 0").select("span_id", "record_id", "start", "end")
    # the places of a record come to its text, not the text to each of its spans
    places = s.groupBy("record_id").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    j = docs.where("text is not null").select(F.col("doc_id").alias("record_id"), "text").join(places, "record_id")
    # choices by what is left of ``most`` after the seed, words before and words after
    table = np.array([[[sum(a + b <= left for a in range(p + 1) for b in range(q + 1)) for q in range(reach + 1)] for p in range(reach + 1)] for left in range(2 * reach + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.utf8_length(whole.column("text")).to_numpy(zero_copy_only=False) + pc.list_value_length(whole.column("places")).to_numpy(zero_copy_only=False)
            for x, y in P.slices(sizes):
                batch = whole.slice(x, y - x)
                points, base, size = P.flat(batch.column("text").to_pylist())
                n = pc.list_value_length(batch.column("places")).to_numpy(zero_copy_only=False)
                found = batch.column("places").flatten()
                at = np.repeat(np.arange(len(n)), n)
                start, end = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                inside = np.flatnonzero(end <= size[at])
                at, start, end = at[inside], start[inside], end[inside]
                a, b = base[at] + start, base[at] + end
                blank = np.append(P.among(points, " \t"), True)
                fresh = ~blank
                fresh[1:] &= blank[:-1]
                begun = np.concatenate(([0], np.cumsum(fresh)))

                def count(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                    """Words in [p, q), parts of words at its ends too."""
                    return begun[q] - begun[p] + ((q > p) & ~blank[p] & ~fresh[p])

                ends = np.concatenate(([-1], np.flatnonzero(points == 10), [len(points)]))
                line = ends[np.searchsorted(ends, a) - 1] + 1
                stop = ends[np.searchsorted(ends, b)]
                # what is left of a word that the seed cuts belongs to the seed
                left = np.minimum(count(line, a) - ((a > line) & ~blank[a - 1] & ~blank[a]), reach)
                right = np.minimum(count(b, stop) - ((b < stop) & ~blank[b] & ~blank[b - 1]), reach)
                own = count(a, b)
                rest = most - own
                choices = np.where(rest < 0, 0, table[np.clip(rest, 0, 2 * reach), left, right])
                widest = np.where(rest < 0, 0, np.minimum(own + left + right, most))
                keep = own > 0
                kept = [pa.array(v[keep]) for v in (at, start.astype(np.int32), end.astype(np.int32), choices, widest)]
                yield pa.RecordBatch.from_arrays([batch.column("record_id").take(kept[0]), *kept[1:]], names=["record_id", "start", "end", "choices", "widest"])

    counted = j.mapInArrow(run, f"record_id {j.schema['record_id'].dataType.simpleString()}, start int, `end` int, choices bigint, widest bigint")
    return s.join(counted, ["record_id", "start", "end"]).select("span_id", "choices", "widest")


def calibrate_per_fold(scored: DataFrame, thresholds: list[float], precision: float) -> DataFrame:
    """Per ``fold`` the threshold with the best F1 that keeps the precision (higher on ties); folds without one are out."""
    from spanloom.operators.evaluate import ratio

    # counted per fold and step of the grid first, so that thresholds are summed over a few rows
    edges = sorted(thresholds)
    step = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in edges), F.lit(0))
    n = scored.dropna(subset=["fold", "score", "positive"]).groupBy("fold", step.alias("step")).agg(F.count("*").alias("n"), F.count_if("positive").alias("good"))
    t = n.select("*", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(edges)))).alias("x"))
    over = lambda c: F.sum(F.when(F.col("step") >= F.col("x.k"), F.col(c)).otherwise(0))
    g = t.groupBy("fold", F.col("x.threshold").alias("threshold")).agg(over("n").alias("taken"), over("good").alias("right"), F.sum("good").alias("positives"))
    p, f1 = ratio(F.col("right"), F.col("taken"), 0.0), ratio(2 * F.col("right"), F.col("taken") + F.col("positives"), 0.0)
    g = g.withColumn("precision", F.round(p, 6)).withColumn("f1", F.round(f1, 6)).where(F.col("precision") >= precision)
    best = g.groupBy("fold").agg(F.max(F.struct("f1", "precision", "threshold")).alias("x"))
    return best.select("fold", "x.threshold", "x.precision", "x.f1")


def clusters(proposals: DataFrame, passages: DataFrame) -> DataFrame:
    """Per (passage, mention, type) that two records or more give: how many. ``passages``: ``passage, record_id, w_start, w_end``."""
    from spanloom.operators.spans import clip

    w = passages.select("record_id", "w_start", "w_end", "passage").distinct()
    c = clip(proposals, w).where("not crosses").join(w, ["record_id", "w_start", "w_end"])
    n = c.groupBy("passage", "start", "end", "type").agg(F.countDistinct("record_id").alias("records"))
    return n.where("records >= 2")


def ranked_window(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a full order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def compatible_before(spans: DataFrame) -> DataFrame:
    """Of each distinct span how many of its record end at or before its start: its last compatible place by end (0: none)."""
    from spanloom.operators.generate import latest_before

    k = spans.dropna(subset=["record_id", "start", "end"]).where("start < `end`").select("record_id", "start", "end").distinct()
    ends = k.groupBy(F.col("record_id").alias("doc_id"), F.col("end").alias("at")).agg(F.count("*").alias("n"))
    marks = ends.withColumn("before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("at"))).select("doc_id", "at", "before")
    found = latest_before(k.withColumnRenamed("record_id", "doc_id").withColumn("at", F.col("start")), marks, "at", "before")
    return found.select(F.col("doc_id").alias("record_id"), "start", "end", F.coalesce("before", F.lit(0)).cast("bigint").alias("before"))


def leave_family_out(family_labels: DataFrame, labels: int) -> DataFrame:
    """Per family the mean loss of its labels under the smoothed votes of the other families. ``item_id, family, label``."""
    f = family_labels.dropna(subset=["item_id", "family", "label"])
    own, total = Window.partitionBy("item_id", "label"), Window.partitionBy("item_id")  # as many rows as families
    share = F.count("*").over(own) / (F.count("*").over(total) - 1 + labels)  # without its own vote, with one for smoothing
    s = f.withColumn("loss", -F.log(share)).groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))
    return s


def two_pass(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, default: str) -> DataFrame:
    """``key, decision, passes``: the decision that both reviews of a key give, else the default; how many reviewed it."""
    one = lambda df, name: df.dropna(subset=[key, "decision"]).groupBy(key).agg(F.min("decision").alias(name))
    j = rows.where(F.col(key).isNotNull()).select(key).distinct().join(one(first, "_a"), key, "left").join(one(second, "_b"), key, "left")
    passes = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    return j.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.lit(default)).alias("decision"), passes.alias("passes"))


def passage_means(scores: DataFrame, passage: str, value: str) -> DataFrame:
    """One row: the mean over passages of the means within them, so that a passage found often counts once. ``times``, if there, says how often a row stands."""
    own = scores.dropna(subset=[passage, value])
    times = F.col("times") if "times" in scores.columns else F.lit(1)
    m = own.groupBy(passage).agg((F.sum(F.col(value) * times) / F.sum(times)).alias("m"), F.sum(times).alias("n"))
    return m.agg(F.count("*").alias("passages"), F.sum("n").alias("rows"), F.round(F.avg("m"), 6).alias("mean"))

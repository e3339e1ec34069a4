"""Aggregation of what several sources say: evidence, ensembles, snapshots, rollups.

Null sources, items or keys say nothing. A source counts once per key, with its
greatest confidence; a null confidence is kept as null unless another one is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import context, hash_int, phrase_key
from spanloom.operators.spans import overlapping

KEY = ["record_id", "start", "end", "type", "text"]


def source_key(c: Column | str) -> Column:
    """One spelling of a source name."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.trim(c), r"[ \-]+", "_"))


def by_source(proposals: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per key and source the greatest confidence."""
    p = proposals.dropna(subset=[*by, "source"]).withColumn("source", source_key("source"))
    return p.groupBy(*by, "source").agg(F.max("confidence").alias("confidence"))


def evidence(proposals: DataFrame, baseline: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per key: sorted sources, their confidences in that order, count, mean and greatest, and whether the baseline has it."""
    per = by_source(proposals, by)
    rows = F.array_sort(F.collect_list(F.struct("source", "confidence")))
    out = per.groupBy(*by).agg(rows.alias("x"), F.count("*").alias("source_count"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"))
    base = baseline.dropna(subset=by).select(*by).distinct().withColumn("baseline_exact", F.lit(True))
    out = out.join(base, by, "left").withColumn("baseline_exact", F.coalesce("baseline_exact", F.lit(False)))
    return out.select(*by, F.col("x.source").alias("sources"), F.col("x.confidence").alias("confidences"), "source_count", F.round(F.col("mean_confidence") + 1e-9, 6).alias("mean_confidence"), "max_confidence", "baseline_exact")  # + 1e-9: ties go up, in whatever order the sum came


def overlap_flag(evidence_: DataFrame, baseline: DataFrame) -> DataFrame:
    """``evidence`` with ``baseline_overlap_same_type``: whether a span of the baseline of the same type meets the key's."""
    hits = overlapping(evidence_, baseline, same_type=True).select("record_id", *(F.col(f"l_{c}").alias(c) for c in ("start", "end", "type"))).distinct()
    j = evidence_.join(hits.withColumn("baseline_overlap_same_type", F.lit(True)), ["record_id", "start", "end", "type"], "left")
    return j.withColumn("baseline_overlap_same_type", F.coalesce("baseline_overlap_same_type", F.lit(False)))


def ensemble(proposals: DataFrame, baseline: DataFrame, least: int, floor: float = 0.0, by: list[str] = KEY) -> DataFrame:
    """Keys that ``least`` sources propose with mean confidence of ``floor`` or more, and the baseline lacks."""
    e = evidence(proposals, baseline, by)
    return e.where((F.col("source_count") >= least) & ~F.col("baseline_exact") & (F.coalesce("mean_confidence", F.lit(0.0)) >= floor)).withColumn("support", F.concat_ws("+", "sources"))


def support_combinations(proposals: DataFrame, by: list[str] = KEY) -> DataFrame:
    """How many keys each combination of sources supports."""
    per = by_source(proposals, by).groupBy(*by).agg(F.concat_ws("+", F.array_sort(F.collect_set("source"))).alias("support"))
    return per.groupBy("support").agg(F.count("*").alias("n"))


def pairs_of_sources(proposals: DataFrame, floors: dict[str, float], by: list[str] = KEY) -> DataFrame:
    """Keys with exactly two sources, both at or over the floor of the key's type (no floor: not eligible)."""
    per = by_source(proposals, by)
    floor = F.create_map(*(x for k, v in floors.items() for x in (F.lit(k), F.lit(v))))[F.col("type")]
    out = per.groupBy(*by).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("confidence").alias("least"), F.count("*").alias("n"), F.count("confidence").alias("known"))
    return out.where((F.col("n") == 2) & (F.col("known") == 2) & (F.col("least") >= floor)).select(*by, F.concat_ws("+", "sources").alias("sources"), "least")


def snapshot_diff(before: DataFrame, after: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Distinct keys that are ``new`` or ``removed``; keys with a null part are out."""
    a, b = before.dropna(subset=by).select(*by).distinct(), after.dropna(subset=by).select(*by).distinct()
    return b.join(a, by, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, by, "left_anti").withColumn("change", F.lit("removed")))


def cohort(before: DataFrame, after: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Per type: novel keys, and how many of them carry an assertion."""
    base = before.dropna(subset=by).select(*by).distinct()
    new = after.dropna(subset=by).groupBy(*by).agg(F.max(F.coalesce(F.size("assertions") > 0, F.lit(False))).alias("asserted")).join(base, by, "left_anti")
    return new.groupBy("type").agg(F.count("*").alias("novel"), F.count_if("asserted").alias("asserted"))


def transition(before: DataFrame, after: DataFrame, by: list[str], value: Column) -> DataFrame:
    """How often each value before became each value after, over keys that both have."""
    a = before.dropna(subset=by).groupBy(*by).agg(F.max(value).alias("was"))
    b = after.dropna(subset=by).groupBy(*by).agg(F.max(value).alias("became"))
    return a.join(b, by).groupBy("was", "became").agg(F.count("*").alias("n"))


def vote_matrix(proposals: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Every key with every source that speaks in its record: VOTE, DROP (it has an overlapping span), or ABSTAIN."""
    from spanloom.operators.spans import overlapping

    per = by_source(proposals, by)
    speaks = per.select("record_id", "source").distinct()
    keys = per.select(*by).distinct()
    voted = per.select(*by, "source").withColumn("vote", F.lit("VOTE"))
    every = keys.join(speaks, "record_id")
    tagged = per.select("record_id", "start", "end", F.col("source").alias("type"))
    hits = overlapping(keys.select("record_id", "start", "end", F.lit("").alias("type")), tagged).select(
        "record_id", F.col("l_start").alias("start"), F.col("l_end").alias("end"), F.col("r_type").alias("source"), F.lit(True).alias("meets")
    ).distinct()
    out = every.join(voted, [*by, "source"], "left").join(hits, ["record_id", "start", "end", "source"], "left")
    return out.select(*by, "source", F.coalesce("vote", F.when(F.col("meets"), F.lit("DROP")).otherwise(F.lit("ABSTAIN"))).alias("vote"))


def family(source: Column | str, families: dict[str, str]) -> Column:
    """Family of a source: of the first part of a name that it contains; else its own name."""
    c = source_key(source)
    out = F.coalesce(*(F.when(c.contains(k), F.lit(v)) for k, v in families.items()), c)
    return out


def family_votes(votes: DataFrame, families: dict[str, str]) -> DataFrame:
    """Per item and family its label if its sources agree; a family at odds abstains."""
    v = votes.dropna(subset=["item_id", "source", "type"]).withColumn("family", family("source", families))
    return v.groupBy("item_id", "family").agg(F.min("type").alias("label"), F.max("type").alias("other")).where("label = other").drop("other")


def smoothed_majority(family_labels: DataFrame, labels: int) -> DataFrame:
    """Per item and label the smoothed share of families that vote for it."""
    n = family_labels.groupBy("item_id", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("item_id"))
    return n.select("item_id", "label", F.round((F.col("n") + 1) / (total + labels), 6).alias("share"))


def alias_consensus(spans: DataFrame) -> DataFrame:
    """Per type and text the candidate codes, where all that have any have the same ones."""
    s = spans.where("type is not null and text is not null and size(candidates) > 0")
    codes = F.concat_ws("|", F.array_sort(F.array_distinct("candidates")))
    k = F.lower(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")))
    return s.groupBy("type", k.alias("mention")).agg(F.min(codes).alias("codes"), F.max(codes).alias("other")).where("codes = other and codes <> ''").drop("other")


def mention_rollup(spans: DataFrame) -> DataFrame:
    """Per type and mention: uses, records, most frequent surface (least on ties), least record."""
    k = F.lower(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")))
    s = spans.where("type is not null and text is not null").withColumn("mention", k)
    per = s.groupBy("type", "mention", "text").agg(F.count("*").alias("n"))
    top = per.groupBy("type", "mention").agg(F.min_by("text", F.struct((-F.col("n")).alias("n"), "text")).alias("surface"), F.sum("n").alias("uses"))
    records = s.groupBy("type", "mention").agg(F.countDistinct("record_id").alias("records"), F.min("record_id").alias("first_record"))
    return top.join(records, ["type", "mention"])


def distil_lexicon(spans: DataFrame, least: int) -> DataFrame:
    """Mentions of one type only that ``least`` records or more have."""
    k = F.lower(F.trim(F.regexp_replace("text", "[ \t\r\n]+", " ")))
    s = spans.where("type is not null and text is not null and record_id is not null").withColumn("mention", k)
    out = s.groupBy("mention").agg(F.min("type").alias("type"), F.max("type").alias("other"), F.countDistinct("record_id").alias("records"))
    return out.where((F.col("type") == F.col("other")) & (F.col("records") >= least)).drop("other")


def concentration(df: DataFrame, unit: str) -> DataFrame:
    """Rows, distinct units, inverse Simpson index, and the shares of the top one, five and ten; one row."""
    n = df.dropna(subset=[unit]).groupBy(unit).agg(F.count("*").alias("n"))
    # ranks of the ten greatest only: each task keeps ten
    top = n.orderBy(F.desc("n"), unit).limit(10).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), unit)))
    part = top.agg(*(F.sum(F.when(F.col("k") <= k, F.col("n"))).alias(f"top{k}") for k in (1, 5, 10)))
    total = n.agg(F.sum("n").alias("rows"), F.count("*").alias("units"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("squares"))
    share = lambda k: F.round(F.col(f"top{k}") / F.col("rows"), 6).alias(f"top{k}_share")
    # two rows of one line each
    return total.crossJoin(F.broadcast(part)).select("rows", "units", F.round(F.col("rows").cast("double") * F.col("rows") / F.col("squares"), 4).alias("effective"), share(1), share(5), share(10))


def passage_units(entities: DataFrame) -> DataFrame:
    """Per passage and relative entity: distinct occurrences, families, and pairs of both."""
    by = ["passage", "start", "end", "type"]
    return entities.groupBy(*by).agg(
        F.countDistinct("record_id").alias("records"), F.countDistinct("family").alias("families"), F.countDistinct("record_id", "family").alias("units")
    )


def eligible(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entities in at least half of a passage's records (two at least) and of two families, no two types tied at the top."""
    x = units.join(sizes, "passage").where((F.col("records") >= F.greatest(F.lit(2), F.ceil(F.col("n_records") / 2))) & (F.col("families") >= 2))
    w = Window.partitionBy("passage", "start", "end").orderBy(F.desc("records"), F.desc("units"))
    x = x.withColumn("place", F.rank().over(w)).where("place = 1")
    return x.withColumn("tied", F.count("*").over(Window.partitionBy("passage", "start", "end"))).where("tied = 1").drop("place", "tied", "n_records")


def weak_links(spans: DataFrame, docs: DataFrame, nodes: DataFrame, width: int = 40, contexts: int = 3) -> DataFrame:
    """Mentions of coded types with the listed codes they carry, as training pairs: uses, records, up to ``contexts`` contexts, and a fold of the mention.

    A span counts if its text is what stands at its place and one of its codes at least is listed. Mentions that fold to one phrase with the same codes are
    one row, in one fold (a tenth test, a tenth dev). Contexts are those of the first places by record and start.
    """
    listed = nodes.select(F.col("identifier").alias("code")).where("code is not null").distinct()
    s = spans.dropna(subset=["record_id", "start", "end", "text", "type"]).where(F.size("candidates") > 0).select("record_id", "start", "end", "text", "type", F.array_distinct("candidates").alias("candidates"))
    codes = s.select(F.explode("candidates").alias("code")).distinct().join(listed, "code", "left_semi")
    known = s.select("*", F.explode("candidates").alias("code")).join(codes, "code").groupBy("record_id", "start", "end", "text", "type").agg(F.array_join(F.sort_array(F.collect_set("code")), "|").alias("codes"))
    j = known.join(docs.where("text is not null").select(F.col("doc_id").alias("record_id"), F.col("text").alias("body")), "record_id")
    j = j.where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")))
    key = ["type", "mention", "codes"]
    rows = j.select("type", phrase_key("text").alias("mention"), "codes", "record_id", "start", "text", context("body", "start", "end", width).alias("context"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("record_id", "start", "text"))
    # a mention that is used very often: the first places of each block of its records, then the first of these
    block = F.pmod(F.xxhash64("record_id"), F.lit(64))
    near = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, block).orderBy("record_id", "start", "text"))).where(F.col("_n") <= contexts).withColumn("_n", first).where(F.col("_n") <= contexts)
    shown = near.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]), " ¦ ").alias("contexts"))
    used = rows.groupBy(*key).agg(F.count("*").alias("uses"), F.countDistinct("record_id").alias("records"))
    bucket = hash_int(F.col("mention")) % 10
    fold = F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")
    return used.join(shown, key).select(*key, "uses", "records", "contexts", fold.alias("fold"))


def category_examples(rows: DataFrame, category: Column, example: Column, most: int = 5) -> DataFrame:
    """Per category how many rows there are, and the first ``most`` examples in order, from the first of each value only."""
    r = rows.select(category.alias("category"), example.alias("example")).where("category is not null")
    values = r.where("example is not null").groupBy("category", "example").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("example"), F.lit(64))
    first = values.withColumn("_k", F.row_number().over(Window.partitionBy("category", block).orderBy("example"))).where(F.col("_k") <= most)
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("category").orderBy("example"))).where(F.col("_k") <= most)
    shown = first.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("example")), "|").alias("examples"))
    return r.groupBy("category").agg(F.count("*").alias("n")).join(shown, "category", "left").select("category", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def resolution_diff(before: DataFrame, names: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per type how many spans keep, gain, lose or change their codes if each takes those of the names it spells (``key``, ``code``; case and blanks aside)."""
    listed = names.dropna().groupBy("key").agg(F.sort_array(F.collect_set("code")).alias("found"))
    empty = F.array().cast("array<string>")
    s = before.where(F.col("type").isin(*types) & F.col("text").isNotNull()).select("type", phrase_key("text").alias("key"), F.sort_array(F.array_distinct(F.array_compact(F.coalesce("candidates", empty)))).alias("had"))
    j = s.join(listed, "key", "left").withColumn("found", F.coalesce("found", empty))
    change = F.when(F.col("had") == F.col("found"), "same").when(F.size("had") == 0, "gained").when(F.size("found") == 0, "lost").otherwise("changed")
    return j.groupBy("type", change.alias("change")).agg(F.count("*").alias("n"))

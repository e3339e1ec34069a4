"""Checks of spans and of changes; bad rows are put apart, never dropped in silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = ("TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "THÔNG_TIN_BỆNH_NHÂN")
ASSERTIONS = ("isNegated", "isHistorical", "isFamily")
CODED = ("CHẨN_ĐOÁN", "THUỐC")


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """Of rows delivered more than once under a key the last one; rows without the key are out."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def violations(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Each span with the names of the checks it fails, in fixed order (none: empty)."""
    d = docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("body"))
    s = spans.select("span_id", "record_id", "text", "type", "start", "end", "assertions", "candidates")
    j = s.join(d, "record_id", "left")
    known = lambda c, names: F.size(F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, names)))) == 0
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("body"))
    slice_ = F.substring("body", F.col("start") + 1, F.col("end") - F.col("start"))
    checks: list[tuple[str, Column]] = [
        ("no_text", F.col("text").isNull()),
        ("unknown_type", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))),
        ("no_position", F.col("start").isNull() | F.col("end").isNull()),
        ("no_record", F.col("body").isNull()),
        ("out_of_bounds", F.coalesce(~inside, F.lit(False))),
        ("other_text", F.coalesce(inside & (slice_ != F.col("text")), F.lit(False))),
        ("unknown_assertion", ~known(F.col("assertions"), ASSERTIONS)),
        ("codes_on_uncoded", F.coalesce(~F.col("type").isin(*CODED) & (F.size("candidates") > 0), F.lit(False))),
    ]
    return j.select("span_id", "record_id", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks))).alias("violations"))


def order_violations(spans: DataFrame) -> DataFrame:
    """Per record: spans out of order by position, and keys that stand more than once.

    Neighbours are compared within sorted ranges of (record, ord, span_id, position), and the ends of ranges with one another, so a
    record of very many spans is spread over tasks.
    """
    s = spans.where("record_id is not null and start is not null and `end` is not null and ord is not null")
    order = ["record_id", "ord", "span_id", "start", "end"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[list] = []  # record, spans, late ones, first and last position
        for pdf in batches:
            record, at = pdf["record_id"].to_numpy(), list(zip(pdf["start"].tolist(), pdf["end"].tolist()))
            a, b = pdf["start"].to_numpy(), pdf["end"].to_numpy()
            late = np.zeros(len(pdf), bool)
            late[1:] = (record[1:] == record[:-1]) & ((a[:-1] > a[1:]) | (a[:-1] == a[1:]) & (b[:-1] > b[1:]))
            cut = np.flatnonzero(np.diff(record, prepend=record[:1] - 1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(pdf)]):
                if kept and kept[-1][0] == record[i]:
                    kept[-1][1] += j - i
                    kept[-1][2] += int(late[i:j].sum()) + (kept[-1][4] > at[i])
                    kept[-1][4] = at[j - 1]
                    continue
                if len(kept) > 20_000:
                    yield pd.DataFrame([(r, n, k, *x, *y) for r, n, k, x, y in kept[:-1]], columns=names)
                    kept = kept[-1:]
                kept.append([record[i], j - i, int(late[i:j].sum()), at[i], at[j - 1]])
        yield pd.DataFrame([(r, n, k, *x, *y) for r, n, k, x, y in kept], columns=names)

    names = ["record_id", "n", "late", "s1", "e1", "s2", "e2"]
    kind = "record_id bigint, n bigint, late bigint, s1 int, e1 int, s2 int, e2 int"
    # a range holds a record in one stretch; a record has a row a range
    ranges = s.select(F.col("record_id").cast("bigint"), *order[1:]).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(compare, kind).withColumn("range", F.spark_partition_id())
    before = F.lag(F.struct("s2", "e2")).over(Window.partitionBy("record_id").orderBy("range"))
    p = ranges.withColumn("late", F.col("late") + F.coalesce(before > F.struct("s1", "e1"), F.lit(False)).cast("int"))
    late = p.groupBy("record_id").agg(F.sum("late").alias("out_of_order"), F.sum("n").alias("spans"))
    k = s.where("type is not null").groupBy("record_id", "start", "end", "type").agg(F.count("*").alias("n"))
    twice = k.groupBy("record_id").agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return late.join(twice, "record_id", "left").select("record_id", "spans", "out_of_order", F.coalesce("repeated", F.lit(0)).alias("repeated"))


def census(checked: DataFrame) -> DataFrame:
    """How many spans fail each check; ``ok`` for those that fail none."""
    names = F.when(F.size("violations") == 0, F.array(F.lit("ok"))).otherwise(F.col("violations"))
    return checked.select(F.explode(names).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows."""
    return checked.where(F.size("violations") == 0), checked.where(F.size("violations") > 0)


def id_sets(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: records with text only, with spans only, and with both."""
    a = docs.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct().withColumn("a", F.lit(1))
    b = spans.where("record_id is not null").select(F.col("record_id").alias("id")).distinct().withColumn("b", F.lit(1))
    j = a.join(b, "id", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("b").isNull()).alias("only_docs"), F.count_if(F.col("a").isNull()).alias("only_spans"))


def frozen(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column how many rows of the same key differ in it (nulls are equal to one another)."""
    a = before.select(key, *(F.col(c).alias(f"a_{c}") for c in columns))
    b = after.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    j = a.join(b, key).agg(*(F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns))
    return j.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns))).alias("x")).select("x.column", "x.changed")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def fingerprint(docs: DataFrame, by: str, content: str) -> DataFrame:
    """Per group: rows, and a digest that doesn't depend on order and can be added up (sum of parts of SHA-256)."""
    h = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce(content, F.lit("\x1e"))), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(38,0)"))
    return docs.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(F.count("*").alias("rows"), part(1).cast("string").alias("digest_a"), part(9).cast("string").alias("digest_b"))


def occurrence_coverage(entities: DataFrame, occurrences: DataFrame, passage: str = "passage") -> DataFrame:
    """Per passage: occurrences, different entities (at their place in it), how many entities its occurrences have in all, and how many they lack.

    Every occurrence should have every entity; the pairs that are missing are counted, not made. ``entities``: ``passage, record_id, start, end, type``,
    ``occurrences``: ``passage, record_id``.
    """
    o = occurrences.select(passage, "record_id").dropna().distinct().groupBy(passage).agg(F.count("*").alias("occurrences"))
    held = entities.select(passage, "record_id", "start", "end", "type").dropna().distinct()
    e = held.groupBy(passage, "start", "end", "type").agg(F.count("*").alias("n")).groupBy(passage).agg(F.count("*").alias("entities"), F.sum("n").alias("present"))
    return o.join(e, passage).select(passage, "occurrences", "entities", "present", (F.col("occurrences") * F.col("entities") - F.col("present")).alias("missing"))

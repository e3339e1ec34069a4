"""Queries of this subpackage, by name; each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.llm import consensus, linking, lookalike, overlap, packing, private, shared, tokenize
from spanloom.llm.oracle import ORACLE  # noqa: F401 (read with QUERIES)
from spanloom.session import table


def p1_found(spark, d):
    return lookalike.same_looking(table(spark, d, "spans"), table(spark, d, "raw_texts"), table(spark, d, "nodes"))


def p1_forms(spark, d):
    own = lambda name, key, text: table(spark, d, name, key, text).select(F.lit(name).alias("origin"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    both = own("spans", "span_id", "text").unionByName(own("raw_texts", "raw_id", "raw"))
    return lookalike.normalise(both, "text", lookalike.vocabulary(table(spark, d, "nodes")))


def p2_found(spark, d):
    return linking.link(table(spark, d, "spans"), table(spark, d, "nodes"))


def p2_unmatched(spark, d):
    spans = table(spark, d, "spans")
    return linking.unmatched(linking.link(spans, table(spark, d, "nodes")), spans)


def p3_found(spark, d):
    return shared.shared_spans(table(spark, d, "documents", "doc_id", "text"))


def p3_amount(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return shared.shared_amount(docs, shared.shared_spans(docs))


def p4_found(spark, d):
    return consensus.consensus(table(spark, d, "proposals"), table(spark, d, "evidence"), sources=False)[0].select("item_id", "label")


def p4_agreement(spark, d):
    return consensus.consensus(table(spark, d, "proposals"), table(spark, d, "evidence"), sources=False)[0]


def p4_reliability(spark, d):
    return consensus.consensus(table(spark, d, "proposals"), table(spark, d, "evidence"))[1]


def p5_found(spark, d):
    return overlap.cross_split_pairs(table(spark, d, "documents", "doc_id", "text", "split"))


def p5_report(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "split", "source")
    return overlap.overlap_report(docs, overlap.cross_split_pairs(docs))


def p6_ids(spark, d):
    return tokenize.encode(table(spark, d, "documents", "doc_id", "text"))


def p7_packing(spark, d):
    return packing.pack(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark, d):
    return private.find_private(table(spark, d, "documents", "doc_id", "text"))


def p8_redacted(spark, d):
    return private.redact_private(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {q.__name__: q for q in (
    p1_found, p1_forms, p2_found, p2_unmatched, p3_found, p3_amount, p4_found, p4_agreement, p4_reliability,
    p5_found, p5_report, p6_ids, p7_packing, p8_found, p8_redacted,
)}

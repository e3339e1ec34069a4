"""Disguises without an at sign or brackets, and forms of both tables."""

import pytest

from spanloom.llm import private, queries


@pytest.mark.parametrize(
    "text, want, kind",
    [("thư: thoai.trung at hopthu.vn nhé", "thoai.trung at hopthu.vn", "EMAIL"), ("thư: thoai.trung at hopthu chấm vn", "thoai.trung at hopthu chấm vn", "EMAIL"),
     ("gọi không ba một hai ba bốn năm sáu một hai nhé", "không ba một hai ba bốn năm sáu một hai", "PHONE"), ("call zero six one two three four five six nine nine now", "zero six one two three four five six nine nine", "PHONE")],
)
def test_plain_disguises(text, want, kind):
    a = text.index(want)
    assert private.Finder()(text) == [(a, a + len(want), kind)]


def test_forms_of_both_tables(spark):
    d = "/root/testdata/sf0.001"
    got = queries.p1_forms(spark, d).groupBy("origin").count().collect()
    assert {r.origin: r["count"] for r in got} == {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("spans", "raw_texts")}

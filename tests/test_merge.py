"""Merging, lookups, streams and small models on cases with known results."""

import random
import re

from pyspark.sql import functions as F

from spanloom.operators import learn, merge, sample
from spanloom.streaming import increment

SPAN = "record_id bigint, start int, `end` int, type string, candidates array<string>"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_route_keeps_legacy_codes_of_exact_spans_only(spark):
    learned = spark.createDataFrame([(1, 0, 8, "S", None), (1, 0, 8, "D", ["R07.9"]), (1, 20, 25, "D", None)], SPAN)
    legacy = spark.createDataFrame([(1, 9, 19, "M", ["6918"]), (1, 20, 25, "D", ["K21"]), (1, 4, 9, "M", ["1"]), (None, 1, 2, "M", None)], SPAN)
    got = merge.route(learned, legacy, ("S", "D"))
    assert {(r.start, r.end, r.type): r.candidates for r in got.collect()} == {(0, 8, "S"): None, (0, 8, "D"): None, (20, 25, "D"): ["K21"], (9, 19, "M"): ["6918"]}


def test_boundaries_replace_add_or_skip(spark):
    base = spark.createDataFrame([(1, 0, 15, "S", None), (1, 24, 31, "D", None)], SPAN)
    queue = spark.createDataFrame([(1, 0, 7, "S", None), (1, 17, 20, "S", None), (1, 24, 31, "S", None), (1, None, 3, "S", None)], SPAN)
    assert rows(merge.integrate_boundaries(base, queue), "start", "end", "type", "action") == [(0, 7, "S", "replace"), (17, 20, "S", "add"), (24, 31, "D", "keep")]
    assert merge.integrate_boundaries(base.limit(0), queue.limit(0)).count() == 0


def test_split_results(spark):
    spans = spark.createDataFrame([(1, 0, 18, "R", None), (1, 30, 35, "R", None)], SPAN)
    pairs = spark.createDataFrame([(1, 0, 7, 9, 18)], "record_id bigint, name_start int, name_end int, value_start int, value_end int")
    assert rows(merge.split_results(spans, pairs, ("R",), "T", "R"), "start", "end", "type", "source") == [(0, 7, "T", "split"), (30, 35, "R", "kept"), (9, 18, "R", "split")]


def test_stages_and_products(spark):
    m = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "x"), (4, None), (5, "a b")], "id bigint, mention string")
    t = spark.createDataFrame([("a b", "2"), ("a b", "1"), ("c", "3"), (None, "9")], "key string, code string")
    got = merge.staged_lookup(m, "mention", [("exact", t, F.col("mention")), ("word", t, F.substring_index("mention", " ", 1))])
    assert {r.id: (r.codes, r.stage) for r in got.collect()} == {1: (["1", "2"], "exact"), 2: (["3"], "word"), 3: (None, "none"), 4: (None, None), 5: (["1", "2"], "exact")}
    ask = spark.createDataFrame([("tek 10 mg", "tek", "10 mg"), ("tek 5 mg", "tek", "5 mg"), ("tek uống", "tek", None)], "mention string, ingredient string, strength string")
    have = spark.createDataFrame([("tek", "P2", "10 mg", "tek 10 mg viên"), ("tek", "P1", "1 g", "tek uống")], "ingredient string, product string, strength string, term string")
    assert {r.mention: r.product for r in merge.best_product(ask, have).collect()} == {"tek 10 mg": "P2", "tek 5 mg": None, "tek uống": "P1"}


def test_longest_phrase(spark):
    m = spark.createDataFrame([("theo dõi sốt cao",), ("sốtcao",), (None,)], "mention string")
    p = spark.createDataFrame([("sốt",), ("sốt cao",), ("cao",), (None,)], "phrase string")
    assert rows(merge.longest_contained(m, p), "mention", "phrase") == [("theo dõi sốt cao", "sốt cao")]


def test_folds_and_leave_one_out(spark):
    d = spark.range(50).withColumnRenamed("id", "doc_id")
    f = merge.folds(d, "doc_id", 5, "s")
    assert f.where("role = 'test'").count() == 50 and f.where("role = 'validate'").count() == 50 and f.count() == 250
    u = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, "a"), ("p", 1, "b"), ("p", 2, "b"), ("p", 3, "c")], "passage string, record bigint, key string")
    assert rows(merge.leave_one_out(u, "passage", "record", ["key"]), "keys", "views", "stable") == [(2, 6, 4)]


def test_score_shape(spark):
    df = spark.createDataFrame([([0.1, 0.9],), ([0.5],), ([],)], "s array<double>").select(merge.score_shape(F.col("s")).alias("x"))
    a, b, c = (r.x for r in df.collect())
    assert (a.top, a.mean, a.margin_1, a.margin_2) == (0.9, 0.5, 0.8, 0.0) and b.entropy == 0.0 and c is None


def test_choices_stay_on_the_line(spark):
    s = spark.createDataFrame([(1, 7, 8, 11), (2, 7, 0, 2), (3, 9, 0, 1), (4, 7, 5, 99)], "span_id bigint, record_id bigint, start int, `end` int")
    d = spark.createDataFrame([(7, "một hai ba bốn\nnăm")], "doc_id bigint, text string")
    # seed 1 is "ba": none or one word on either side; seed 2 is cut out of "một", the first word
    assert rows(merge.span_choices(s, d, 1), "span_id", "choices", "widest") == [(1, 4, 3), (2, 2, 2)]


def test_span_choices_take_no_text_to_a_span(spark):
    r = random.Random(7)
    text = "".join(r.choice(["ho ", "đau", "\n", "sốt\t", "x", "𝒳", " ", "a\n"]) for _ in range(20_000))
    at = [(a, a + r.randrange(1, 25)) for a in (r.randrange(len(text) - 30) for _ in range(100))]
    # one record of very many spans: the text is read once, not once a span
    rows = [(i, 7, *at[i % 100]) for i in range(50_000)]
    s = spark.createDataFrame([*rows, (-1, 7, -1, 3), (-2, 7, 5, 10**6)], "span_id bigint, record_id bigint, start int, `end` int")
    d = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    df = merge.span_choices(s, d)
    got = {r.span_id: (r.choices, r.widest) for r in df.collect()}
    for i, (a, b) in enumerate(at):
        before, after, seed = text[:a].rpartition("\n")[2], text[b:].partition("\n")[0], text[a:b]
        parts = lambda x: [w for w in re.split("[ \t]+", x) if w]
        left = min(4, len(parts(before if seed[0] in " \t" else re.sub("[^ \t]+$", "", before))))
        right = min(4, len(parts(after if seed[-1] in " \t" else re.sub("^[^ \t]+", "", after))))
        fits = [p + q + len(parts(seed)) for p in range(left + 1) for q in range(right + 1) if p + q + len(parts(seed)) <= 10]
        assert {got.get(k) for k in range(i, 50_000, 100)} == ({(len(fits), max(fits, default=0))} if parts(seed) else {None})
    assert not {-1, -2} & set(got)
    assert "mapinarrow" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_ridge_and_logistic(spark):
    r = random.Random(1)
    x = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, 2 * a - b + 3, [a, b], bool(2 * a - b > 0)) for a, b in x], "a double, b double, y double, features array<double>, hit boolean")
    w = learn.ridge(df, "y", ["a", "b"], 1e-6)
    assert all(abs(p - q) < 1e-3 for p, q in zip(w, (2, -1, 3)))
    model = learn.logistic(df, "hit", 2)
    assert df.where((learn.apply_logistic(df, model) > 0.5) == F.col("hit")).count() > 390


def test_pu_bagging_without_positives_abstains(spark):
    kind = "record bigint, text string, type string, start int, `end` int, confidences map<string,double>, positive boolean"
    df = spark.createDataFrame([(1, None, "S", 0, 1, {"a": 0.5}, False), (2, "x", "S", 0, 1, None, False)], kind)
    assert [r.score for r in learn.pu_bagging(df, "positive", F.col("record"), bags=2).collect()] == [None, None]


def test_simulated_gate_is_fair_only_with_clusters(spark):
    got = {r.rho: r for r in sample.simulate_gate(spark, (10,), (0.0,), (0.0, 0.9), replications=400, rounds=60, tasks=4).collect()}
    assert got[0.9].replications == 400 and got[0.9].naive > got[0.9].clustered >= got[0.9].t


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    d.write.parquet(src)
    go = lambda: increment.run_stream(spark, "doc_id bigint, text string", src, out, mark, lambda b: b.withColumn("n", F.length("text"))).awaitTermination()
    go()
    go()
    done = spark.read.parquet(out)
    assert done.count() == 3
    assert increment.missing(d.union(spark.createDataFrame([(5, "e")], d.schema)), done).select("doc_id").collect() == [(5,)]


def test_small_pieces(spark):
    from spanloom.functions import text as T

    t = "đau (đầu), sốt"
    df = spark.createDataFrame([(t, 6, 8), (t, 3, 5), (t, 4, 10), (None, 0, 1), (t, None, 2), (t, 0, 99)], "text string, start int, `end` int")
    got = [None if r.x is None else t[r.x.start : r.x.end] for r in df.select(T.whole_words("text", "start", "end").alias("x")).collect()]
    assert got == ["đầu", None, "đầu", None, None, None]
    s = spark.createDataFrame([("a b", "a c"), ("", ""), ("", "x"), ("a", "x y z"), (None, None)], "a string, b string").select(T.text_similarity("a", "b").alias("x"))
    assert [r.x for r in s.collect()] == [0.5, 1.0, 0.0, -2.0, 1.0]
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 7), (1, 2, 7), (1, None, 3)], "record_id bigint, start int, `end` int")
    assert rows(merge.compatible_before(spans), "start", "end", "before") == [(0, 5, 0), (2, 7, 0), (5, 9, 1)]
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id bigint")
    a = spark.createDataFrame([(1, "keep"), (2, "keep")], "id bigint, decision string")
    b = spark.createDataFrame([(1, "keep"), (2, "drop"), (9, "keep")], "id bigint, decision string")
    assert rows(merge.two_pass(ids, a, b, "id", "unsure"), "id", "decision", "passes") == [(1, "keep", 2), (2, "unsure", 2), (3, "unsure", 0)]


def test_drugs_by_stages(spark):
    names = spark.createDataFrame([("warfarin", "11", "IN"), ("coumadin", "12", "BN"), ("insulin glargine", "13", "IN"), ("insulin", "14", "IN"), (None, "15", "IN")], "name string, code string, tty string")
    products = spark.createDataFrame(
        [("101", "SCD", "warfarin 3 mg oral tablet"), ("102", "SBD", "warfarin 3 mg oral tablet [coumadin]"), ("99", "SCDG", "warfarin 3 mg oral tablet"), ("103", "SCD", "4 ml warfarin 10 mg/ml injection"), (None, "SCD", "x 3 mg")],
        "product string, tty string, norm string",
    )
    brands = spark.createDataFrame([("12", "warfarin")], "code string, generic string")
    index = spark.createDataFrame([("insulin", "10 ml", "55"), ("insulin", "10 ml", "54")], "ingredient string, strength string, code string")
    want = {
        ("warfarin", None): ("11", "name"), ("warfarin 3,0 mg", None): ("101", "product"), ("coumadin 3mg", "po"): ("102", "product"), ("warfarin 40 mg", "tiem"): ("103", "product"), ("warfarin 40 mg", "po"): (None, None),
        ("warfarin 7 mg", None): ("11", "name"), ("insulin glargine", None): ("13", "name"), ("insulin 10 ml", None): ("54", "index"), ("insulin 10 ml", "iv"): (None, None), ("", None): (None, None), ("la 5 mg", None): (None, None),
    }
    m = spark.createDataFrame([*want, *want, (None, "x")], "mention string, around string")
    got = {(r.mention, r.around): (r.code, r.stage) for r in merge.resolve_drugs(m, names, products, brands, index).collect()}
    assert got == {(k, a or k): v for (k, a), v in want.items()}
    strict = {r.mention: r.code for r in merge.resolve_drugs(m, names, products, brands, index, strict=True).collect()}
    assert strict["warfarin 7 mg"] is None and strict["warfarin"] == "11"
    assert merge.resolve_drugs(m.limit(0), names, products.limit(0), brands.limit(0), index).count() == 0

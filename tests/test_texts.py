"""Texts, generators, quality, votes, evaluation, sampling, sources: small cases with known results."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import evaluate, generate, learn, quality, retrieve, sample, scope, votes
from spanloom.sources import files


def one(spark, column, **values):
    kinds = {"text": "string", "start": "int", "end": "int", "a": "array<string>", "b": "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[k]}" for k in values))
    return df.select(column.alias("x")).first().x


def test_offsets_are_code_points(spark):
    assert one(spark, T.context("text", "start", "end", 3), text="a😀bđau đầu", start=3, end=6) == "a😀b⟦đau⟧ đầ"
    assert one(spark, T.crlf_offset("text", "start"), text="a\nb\n😀c", start=5) == 7


@pytest.mark.parametrize("raw, key", [("  Thiếu   MEN ", "thieu men"), ("đ", "đ"), ("Straße", "strasse"), ("ﬁ", "fi"), ("é", "e"), ("", "")])
def test_fold(raw, key):
    assert T.fold_key(raw) == key


def test_fold_map_goes_back(spark):
    value, places = T.fold_with_map("ﬁ Ế😀")
    assert value == "fi e😀" and places == [0, 0, 1, 2, 3]
    df = spark.createDataFrame([("ﬁ Ế😀",), (None,)], "text string").select(T.normalize_with_map("text").alias("m"))
    got = df.select(T.raw_span("m.norm_to_raw", F.lit(1), F.lit(4)).alias("s"), "m.value").collect()
    assert (got[0].s.start, got[0].s.end) == (0, 3) and got[1].s is None


def test_word_distance_and_jaccard(spark):
    r = random.Random(1)

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    pairs = [([r.choice("abc") for _ in range(r.randrange(6))], [r.choice("abc") for _ in range(r.randrange(6))]) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [x.d for x in df.select(T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [slow(a, b) for a, b in pairs]
    assert one(spark, T.jaccard("a", "b"), a=[], b=None) == 1.0 and one(spark, T.jaccard("a", "b"), a=[], b=["x"]) == 0.0


def test_codes(spark):
    assert one(spark, T.display_code("text"), text="K219") == "K21.9" and one(spark, T.compact_code("text"), text="K21.9") == "K219"


LONG = "dòng này dài hơn bốn mươi ký tự và lặp lại"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_lines_and_passages(spark):
    d = docs(spark, f" {LONG} \r\n😀\n{LONG}", f"x\n{LONG}", LONG[:30], None, "")
    assert [(r.doc_id, r.line, r.start, r.end) for r in generate.lines(d).where("doc_id < 2").orderBy("doc_id", "line").collect()] == [
        (0, 0, 1, 1 + len(LONG)), (0, 1, len(LONG) + 4, len(LONG) + 5), (0, 2, len(LONG) + 6, 2 * len(LONG) + 6), (1, 0, 0, 1), (1, 1, 2, 2 + len(LONG)),
    ]
    g = generate.passage_groups(d).collect()
    assert len(g) == 1 and (g[0].records, g[0].occurrences) == (2, 3)


def test_sentences_cover_the_text(spark):
    t = "Một. Hai?! Ba\nbốn; năm"
    got = generate.sentences(docs(spark, t)).orderBy("sentence").collect()
    assert "".join(t[r.start : r.end] for r in got) == t and len(got) == 5


def test_dictionary_keeps_duplicates_and_bounds(spark):
    got = generate.dictionary_spans(docs(spark, "ho; ho; không ho. hoa HỒNG cầu", None), ["ho", "hồng cầu"]).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 2), (4, 6), (14, 16), (22, 30)]
    assert generate.dictionary_spans(docs(spark, "x"), []).count() == 0


def test_numeric_pairs(spark):
    t = "glucose: 120 mg/dL; cấy máu âm tính\n80 neutrophil"
    got = generate.numeric_pairs(docs(spark, t, "creatinine 2.0 -> 3.2\n- lactate 1.1-->0.8\n- spo2 100ra", None), ["glucose", "cấy máu", "neutrophil", "creatinine", "lactate", "spo2"])
    assert sorted((t[r.name_start : r.name_end], t[r.value_start : r.value_end]) for r in got.collect()) == [("glucose", "120 mg/dL"), ("neutrophil", "80")]


@pytest.mark.parametrize("text, pairs", [
    ("bổ sung kali 80\nkali: 3,5 - 5.0 mmol/L", [("kali", "3,5 - 5.0 mmol/L")]), ("rr 14 spo2", []), ("- 14 spo2; spo2 -2,5", [("spo2", "14"), ("spo2", "-2,5")]),
    ("kali  máu là 4 g", [("kali  máu", "4")]), ("KALI máu = 4.2→5", []), ("kali 4a", []), ("kali" + " " * 60 + "4", []), ("kali 4 %", [("kali", "4 %")]), ("", []),
])
def test_numeric_pairs_of_lines(spark, text, pairs):
    got = generate.numeric_pairs(docs(spark, text, None), ["kali", "kali máu", "spo2", None, ""]).collect()
    assert sorted((text[r.name_start : r.name_end], text[r.value_start : r.value_end]) for r in got) == sorted(pairs)


def test_dictionary_spans_before_a_capital(spark):
    t = "chuyển dạBệnh sử: chuyển dạng"
    assert [(r.start, r.end) for r in generate.dictionary_spans(docs(spark, t), ["chuyển dạ"]).collect()] == [(0, 9)]


def said(spark, text, mentions):
    """What is said of each mention (text, type, and which one of them)."""
    at = [(0, (i := [m for m in range(len(text)) if text.startswith(x, m)][n]), i + len(x), k) for x, k, n in mentions]
    df = spark.createDataFrame(at, "record_id bigint, start int, `end` int, type string")
    got = scope.assertions(df, docs(spark, text, None), ("S", "D", "T"), ("D", "T"), "S").collect()
    return {(text[r.start : r.end], r.type): r.assertions for r in got}


@pytest.mark.parametrize("text, mentions", [
    ("Khó chịu không do chấn thương, không đặc hiệu. Hiện không đau ngực nhưng có khó thở.", {"đau ngực": ["isNegated"], "khó thở": [], "không do chấn thương, không đặc hiệu": []}),
    ("Mẹ đã tử vong\nNgười nhà nhận thấy bệnh nhân mất định hướng\nbối cảnh ho", {"tử vong": ["isFamily"], "mất định hướng": [], "ho": []}),
    ("1. Tiền sử bệnh\n- ngất xỉu\n\n2. Bệnh sử hiện tại\n- khó thở", {"ngất xỉu": ["isHistorical"], "khó thở": []}),
    ("Tiền sử gia đình: phủ nhận đái tháo đường", {"đái tháo đường": ["isHistorical", "isFamily", "isNegated"]}),
    ("không (sốt), chưa  ho; âm tính lao. không khó nuốt", {"sốt": [], "ho": ["isNegated"], "lao": ["isNegated"], "không khó nuốt": ["isNegated"]}),
])
def test_assertion_scope(spark, text, mentions):
    assert said(spark, text, [(m, "S", 0) for m in mentions]) == {(m, "S"): v for m, v in mentions.items()}


def test_history_of_coded_types_and_indications(spark):
    t = "Đã từng điều trị đau lưng bằng aspirin. Đỡ\nThuốc trước nhập viện:\n- amlodipin; lao phổi\nBệnh sử hiện tại: dùng digoxin. Ho"
    want = {("đau lưng", "S"): [], ("aspirin", "T"): ["isHistorical"], ("amlodipin", "T"): ["isHistorical"], ("lao phổi", "D"): ["isHistorical"], ("digoxin", "T"): [], ("Ho", "S"): [], ("Đỡ", "X"): []}
    assert said(spark, t, [(m, k, 0) for m, k in want]) == want


def test_violations_and_quarantine(spark):
    s = spark.createDataFrame(
        [(1, 0, "đau", "TRIỆU_CHỨNG", 0, 3, None, None), (2, 0, "đau", "THUỐC", 1, 4, ["isOdd"], []), (3, 7, None, "X", None, None, [], ["A"]), (4, 0, "đ", "TRIỆU_CHỨNG", 0, 99, [], ["A"])],
        "span_id bigint, record_id bigint, text string, type string, start int, `end` int, assertions array<string>, candidates array<string>",
    )
    v = quality.violations(s, docs(spark, "đau đầu"))
    assert {r.span_id: r.violations for r in v.collect()} == {1: [], 2: ["other_text", "unknown_assertion"], 3: ["no_text", "unknown_type", "no_position", "no_record", "codes_on_uncoded"], 4: ["out_of_bounds", "codes_on_uncoded"]}
    good, bad = quality.quarantine(v)
    assert (good.count(), bad.count()) == (1, 3)


PROPOSALS = "item_id bigint, record_id bigint, start int, `end` int, type string, text string, source string, confidence double"


def test_evidence_counts_a_source_once(spark):
    p = spark.createDataFrame([(1, 1, 0, 8, "S", "x", "model-a", 0.8), (1, 1, 0, 8, "S", "x", " MODEL_A", 0.9), (1, 1, 0, 8, "S", "x", "model_b", 0.7), (1, 1, 0, 8, "S", "x", None, 1.0)], PROPOSALS)
    e = votes.evidence(p, p.where("source = 'model_b'")).first()
    assert (e.sources, e.confidences, e.source_count, e.baseline_exact) == (["model_a", "model_b"], [0.9, 0.7], 2, True)
    assert votes.ensemble(p, p.limit(0), 2).count() == 1 and votes.ensemble(p, p, 2).count() == 0


def test_scores_and_empty_sides(spark):
    kind = "record_id bigint, start int, `end` int, type string"
    gold = spark.createDataFrame([(0, 0, 1, "A"), (0, 2, 3, "A")], kind)
    assert evaluate.prf(gold, gold.limit(1)).first().f1 == pytest.approx(2 / 3, abs=1e-6)
    assert evaluate.prf(gold.limit(0), gold.limit(0), empty=1.0).first().f1 == 1.0
    full = gold.withColumns({"text": F.lit("a b"), "assertions": F.array().cast("array<string>"), "candidates": F.lit(None).cast("array<string>")})
    assert evaluate.score_corpus(full, full).first().final == 1.0


def test_prefix_utility_takes_the_smaller_on_ties(spark):
    top = [chr(65 + i) for i in range(10)]
    df = spark.createDataFrame([(top, ["A"]), (top, ["B"])], "top array<string>, gold array<string>")
    assert [r.k for r in evaluate.prefix_utility(df).where("best").collect()] == [1]


def test_strata_are_even_and_stable(spark):
    df = spark.createDataFrame([(i, (i * 7) % 13) for i in range(100)] + [(200, None)], "doc_id bigint, n int")
    want = {k: min(5, i * 6 // 100) + 1 for i, (_, k) in enumerate(sorted(((i * 7) % 13, i) for i in range(100)))}
    for n in (1, 7):
        assert {r.doc_id: r.stratum for r in sample.equal_strata(df.repartition(n), "n", "doc_id", 6).collect()} == want


def test_t_quantile():
    for p, df, t in ((0.975, 10, 2.228139), (0.95, 3, 2.353363), (0.5, 7, 0.0), (0.025, 1, -12.706205)):
        assert sample.t_quantile(p, df) == pytest.approx(t, abs=1e-5)


def test_dense_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [])], "id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.base_id for r in retrieve.dense_top(df, df, 3, block=16).collect()}
    s = np.round(u @ u.T, 6)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(sorted(range(60), key=lambda j: (-s[i, j], j))[:3])}


def test_dawid_skene_learns_who_errs(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        t = r.choice("AB")
        for s, p in (("good", 0.95), ("fair", 0.8), ("liar", 0.1), ("fine", 0.85)):
            rows.append((i, s, t if r.random() < p else "AB"[t == "A"], t))
    df = spark.createDataFrame(rows, "item_id bigint, source string, type string, truth string")
    got = {x.item_id: x.label for x in learn.dawid_skene(df, rounds=5).collect()}
    assert sum(got[i] == t for i, t in {(a, d) for a, _, _, d in rows}) > 280
    assert learn.dawid_skene(df.limit(0)).count() == 0


def test_hedge_and_siblings(spark):
    n = spark.createDataFrame([("A00", "W"), ("A00.0", "W"), ("A00.1", "W"), ("B01.1", "W")], "identifier string, ontology string")
    e = retrieve.textual_edges(n)
    assert {r.source: r.siblings for r in retrieve.siblings(e).collect()} == {"A00.0": 1, "A00.1": 1}
    s = spark.createDataFrame([(1, "D", ["A00.0"]), (2, "D", ["A00"]), (3, "D", ["A00.0", "x"]), (4, "M", ["A00.0"]), (5, "D", None), (6, "D", ["B01.1"])], "span_id bigint, type string, candidates array<string>")
    assert {r.span_id: len(r.after) for r in retrieve.parent_hedge(s, n, "D").collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/7.json").write_text('[{"text":"đau","type":"S","position":[0,3],"assertions":["a","a"],"candidates":null}]', encoding="utf-8")
    (tmp_path / "in/8.json").write_text("no", encoding="utf-8")
    (tmp_path / "in/7.txt").write_bytes("đau\r\n".encode())
    assert files.read_texts(spark, str(tmp_path / "in")).first().text == "đau\r\n"
    got = files.read_entities(spark, str(tmp_path / "in")).orderBy("record_id").collect()
    assert (got[0].start, got[0].end, got[0].assertions, got[0].error) == (0, 3, ["a"], None) and got[1].error
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "in/7.json", "7.json")
    assert files.read_zip(spark, str(tmp_path / "a.zip")).first().record_id == 7
    members = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, body string")
    files.package(members, str(tmp_path / "x.zip"))
    files.package(members.orderBy("name"), str(tmp_path / "y.zip"))
    assert (tmp_path / "x.zip").read_bytes() == (tmp_path / "y.zip").read_bytes()
    (tmp_path / "c.conll").write_text("đau B-S\nđầu I-S\nnhẹ O\n\nho B-S\n", encoding="utf-8")
    assert [(r.sentence, r.start, r.end) for r in files.read_conll(spark, str(tmp_path / "c.conll")).orderBy("sentence").collect()] == [(0, 0, 7), (1, 0, 2)]


def test_sql_agrees_on_the_smallest_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    from spanloom.plans import oracle, queries

    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    form = lambda v: round(float(v), 5) if isinstance(v, float) or hasattr(v, "quantize") else v
    for name in ("repeated_passages", "span_relation", "vote_ensemble", "length_strata_sample", "strict_prf", "latest_heading"):
        df = queries.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        cur = con.execute(oracle.ORACLE[name])
        names = [c[0] for c in cur.description]
        want = sorted((tuple(form(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
        assert sorted((tuple(form(r[c]) for c in cols) for r in df.collect()), key=str) == want, name


def test_drug_catalog(spark, tmp_path):
    row = lambda i, tty, name, lang="ENG": "|".join([i, lang, *[""] * 9, "RXNORM", tty, "c" + i, name, "", "", ""]) + "|"
    rel = lambda a, b, r: "|".join([a, "", "", "", b, "", "", r, "", "", "RXNORM", *[""] * 5]) + "|"
    (tmp_path / "c").write_text("\n".join([
        row("2", "BN", "Lasix"), row("1", "PIN", "Furosemide  sodium"), row("1", "IN", "furosemide"), row("3", "IN", "LASIX"), row("4", "BN", "lasix"), row("9", "SCD", "furosemide 20 MG Tablet"),
        row("9", "SCD", "Furosemide 40 mg tablet"), row("9", "SBD", "x 1 mg / 5 ml"), row("5", "IN", "fr", "FRE"),
    ]), encoding="utf-8")
    (tmp_path / "r").write_text("\n".join([rel("3", "2", "tradename_of"), rel("1", "2", "tradename_of"), rel("4", "1", "has_tradename"), rel("7", "8", "tradename_of"), rel("1", "6", "isa")]), encoding="utf-8")
    c, order = files.read_concepts(spark, str(tmp_path / "c")), ["IN", "PIN", "MIN", "BN"]
    aliases = {r.norm: (r.identifier, r.tty) for r in files.concept_aliases(c.where(c.tty.isin(*order)), order).collect()}
    assert aliases == {"lasix": ("3", "IN"), "furosemide sodium": ("1", "PIN"), "furosemide": ("1", "IN")}
    assert {(r["product"], r.tty): r.norm for r in files.concept_products(c, ["SCD", "SBD"]).collect()} == {("9", "SCD"): "furosemide 40 mg tablet", ("9", "SBD"): "x 1 mg / 5 ml"}
    assert {r.code: r.generic for r in files.brand_generics(files.read_relations(spark, str(tmp_path / "r")), c, order).collect()} == {"2": "furosemide", "4": "furosemide"}
    index = {(r.ingredient, r.strength, r.code) for r in files.ingredient_index(c, ["Furosemide", "x"]).collect()}
    assert index >= {("furosemide", "", "1"), ("furosemide", "20 mg", "9"), ("x", "5 ml", "9")} and ("furosemide", "", "9") not in index


def test_codes_take_the_last_line_and_reviews_gate(spark, tmp_path):
    (tmp_path / "k").write_text("\n".join(";".join([*"1234567", "K21.9", t]) for t in ("zeta", "alpha")), encoding="utf-8")
    assert [(r.code, r.title) for r in files.read_codes(spark, str(tmp_path / "k")).collect()] == [("K21.9", "alpha")]
    (tmp_path / "j").write_text('{"record_id": 1, "ok": true}\n{"record_id": 1, "ok": true}\n{"record_id": 2}\n', encoding="utf-8")
    rows, stops = files.read_jsonl(spark, str(tmp_path / "j"), "record_id bigint, ok boolean", "ok")
    assert rows.count() == 3 and {(r.record_id, r.n, r.reason) for r in stops.collect()} == {(1, 2, "repeated id"), (2, 1, "not reviewed")}
    assert files.subset(rows, rows.where("record_id = 2").unionByName(rows.where("record_id = 2"))).count() == 1

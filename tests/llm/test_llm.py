"""The training-data operators against brute force, round trips and known cases, with nulls, empty and long texts, ties and repeats."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import consensus, linking, lookalike, overlap, packing, private, shared, tokenize

WORDS = "Ghi nhận sốt đau đầu khi cúi lúc ngày huyết áp mạch tim phổi bụng mềm thuốc viên uống sáng 120/80 37.5°C β2 ½ 😷".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + (str(r.randrange(1000)) if r.random() < 0.4 else "") for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", {k} string" for k in more))


# ---- 1 ----


@pytest.mark.parametrize("a, b", [("đau đầu", unicodedata.normalize("NFD", "đau đầu")), ("lactat", "lact‌at"), ("Ilmdelru", "Ιlmdеlru"), ("192 ng/mL", "１９２ ng/mL"), ("a-b", "a‑b"), ("62 µg/L", "62 μg/L"), ("ế", "é̂"), ("Đau", "Ðau")])
def test_looks_the_same(a, b):
    trie = lookalike.Trie(["đau", "đầu", "lactat", "Ilmdelru"])
    assert lookalike.canonical(a, trie, {}) == lookalike.canonical(b, trie, {})
    once = lookalike.canonical(b, trie, {})
    assert lookalike.canonical(once, trie, {}) == once == lookalike.by_table(b)


def test_the_list_decides():
    trie, none = lookalike.Trie(["lactat", "Ibu", "TNF-α", "đau", "10", "lO"]), lookalike.Trie([])
    form = lambda x, t=trie, most=0.0: lookalike.canonical(x, t, {}, most)
    # a shape of several letters, another script kept, signs at the ends
    assert form("Іactat") == "lactat" and form("Іactat", none) == "Iactat"
    assert form("Іbu, (Іactat)") == "Ibu, (lactat)" and form("ІZ") == "IZ"
    assert form("TNF-α") == form("TNF-a") == form("ТNF‑а") == "TNF-α" and form("TNF-α", none) == "TNF-a"
    assert all(form(form(x)) == form(x) for x in ("Іactat", "TNF-a", "Іbu,", "ІZ", "x" * 100 + "а"))
    # what costs is taken only within the limit, the cheapest first
    assert form("1actat") == "1actat" and form("1actat", most=0.5) == "lactat"
    assert form("IO", most=0.4) == "lO" and form("lactt", most=0.9) == "lactt" and form("lactt", most=1.0) == "lactat"
    assert form("laxctat", most=1.0) == form("lastat", most=1.0) == "lactat" and trie.walk("", 1.0) is None


def test_long_tokens_and_big_lists():
    words = [f"từ{i}x" for i in range(120_000)] + ["α" * 80]
    trie = lookalike.Trie(words)
    assert trie.walk("a" * 80) == "α" * 80 and trie.walk("từ119999х") == "từ119999x"


@pytest.mark.parametrize("a, b", [("Ho", "ho"), ("m²", "m2"), ("½", "1/2"), ("sốt", "sổt"), ("136 ng", "136ng"), ("ho.", "ho"), ("µ", "u")])
def test_looks_different(a, b):
    assert lookalike.by_table(a) != lookalike.by_table(b)


def test_pairs_of_one_record(spark):
    spans = spark.createDataFrame([(1, 5, "lactat", "x"), (1, 5, "lactat", "x"), (2, 5, None, "x"), (3, None, "lactat", "x"), (4, 6, "lactat", "x"), (5, 5, "", "x")], "span_id bigint, record_id bigint, text string, raw string")
    raws = spark.createDataFrame([(10, 5, "lасtat", "y"), (10, 5, "lасtat", "y"), (11, 5, "lactat", "y"), (12, 5, None, "y"), (13, 7, "lасtat", "y")], "raw_id bigint, record_id bigint, raw string, text string")
    nodes = spark.createDataFrame([("lactat", None), (None, ["x", None])], "canonical string, aliases array<string>")
    assert [tuple(r) for r in lookalike.same_looking(spans, raws, nodes).collect()] == [(1, 10)]
    assert lookalike.same_looking(spans.limit(0), raws, nodes.limit(0)).count() == 0


# ---- 2 ----

NAMES = [("K21.0", "WHO_ICD10_2019", "thoái hóa cuống thận mạn tính", ["THCTMT", None]), ("K21.1", "WHO_ICD10_2019", "sốt Hulbridun", ["Hulbridun fever"]), ("K21.2", "WHO_ICD10_2019", "sốt Hulbridan", None), ("91", "RXNORM_CPC_2026_07", "tekiivane", ["rubo forte"])]


@pytest.mark.parametrize(
    "typed, kind, want",
    [("Thoai hoa cuong thận mạn tính", "CHẨN_ĐOÁN", "K21.0"), ("theo dõi thoáihóacuốngthậnmạntính (?)", "CHẨN_ĐOÁN", "K21.0"), ("mạn tính thoái hóa cuống thận", "CHẨN_ĐOÁN", "K21.0"), ("thct mt", "CHẨN_ĐOÁN", "K21.0"),
     ("sốt hulbriduun", "CHẨN_ĐOÁN", "K21.1"), ("sot hulbridann", "CHẨN_ĐOÁN", "K21.2"), ("sốt khác hẳn", "CHẨN_ĐOÁN", "UNMATCHED"), ("???", "CHẨN_ĐOÁN", "UNMATCHED"), ("", "THUỐC", "UNMATCHED"),
     ("viên tekivane 0,5 mg uống sáng", "THUỐC", "91"), ("tеkiivane 1/2 viên po bid", "THUỐC", "91"), ("sốt Hulbridun", "THUỐC", "UNMATCHED"), ("x" * 5000, "THUỐC", "UNMATCHED")],
)
def test_links(linked, typed, kind, want):
    assert linked[typed, kind] == want


@pytest.fixture(scope="module")
def linked(spark):
    mark = next(m for m in test_links.pytestmark if m.name == "parametrize")
    cases = [(t, k) for t, k, _ in mark.args[1]]
    rows = [(i, t, k, None if i % 2 else [], 1) for i, (t, k) in enumerate(cases)] * 2 + [(900, None, "THUỐC", None, 1), (901, "tekiivane", "THUỐC", ["91"], 1), (902, "tekiivane", "KHÁC", None, 1)]
    spans = spark.createDataFrame(rows, "span_id bigint, text string, type string, candidates array<string>, identifier int")
    nodes = spark.createDataFrame(NAMES, "identifier string, ontology string, canonical string, aliases array<string>")
    got = linking.link(spans, nodes).collect()
    assert len(got) == len(cases)
    return {cases[r.span_id]: r.identifier for r in got}


def test_keys_miss_nothing_within_two_slips():
    r = random.Random(1)
    for _ in range(400):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 16)))
        x = list(w)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.choice((0, 1))] = r.choice(("", "a", "b"))
        x = "".join(x)
        if x and linking.distance(x, w, 2) <= 2:
            assert linking.listed_keys(w) & linking.typed_keys(x), (w, x)


def test_links_of_a_list_in_blocks(spark, linked, monkeypatch):
    monkeypatch.setattr(linking, "MOST_NAMES", 2)
    rows = [(i, t, k, None, "a") for i, (t, k) in enumerate(sorted(linked))] + [(0, "cũ", "THUỐC", None, "0")]
    spans = spark.createDataFrame(rows, "span_id bigint, text string, type string, candidates array<string>, ingested_at string").withColumn("extracted_at", F.col("ingested_at"))
    nodes = spark.createDataFrame([(a, b, c, d) for a, b, c, d in NAMES], "identifier string, ontology string, canonical string, aliases array<string>")
    got = {r.span_id: r.identifier for r in linking.link(spans, nodes).collect()}
    assert got == {i: linked[x] for i, x in enumerate(sorted(linked))}
    shown = {r.text: r.entities for r in linking.unmatched(linking.link(spans, nodes), spans).collect()}
    assert shown == {t: sum(1 for x in linked if x[0] == t and linked[x] == "UNMATCHED") for (t, _), v in linked.items() if v == "UNMATCHED"}


# ---- 3 ----


def brute_shared(texts, k):
    own = {}
    for i, t in texts.items():
        for j in range(len(t) - k + 1):
            own.setdefault(t[j : j + k], set()).add(i)
    out = set()
    for i, t in texts.items():
        on = np.zeros(len(t) + 2, bool)
        for j in range(len(t) - k + 1):
            if len(own[t[j : j + k]]) > 1:
                on[j + 1 : j + k + 1] = True
        edge = np.flatnonzero(np.diff(on.astype(int)))
        out |= {(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return out


@pytest.mark.parametrize("strings", [400, 1])
def test_shared_spans(spark, monkeypatch, strings):
    monkeypatch.setattr(shared, "BUCKET_STRINGS", strings)
    r = random.Random(2)
    passage = text(r, 80)
    texts = {i: text(r, 60) for i in range(12)}
    for i in range(2, 9):
        a = r.randrange(len(passage) - 200)
        texts[i] += passage[a : a + r.randrange(100, 260)] + text(r, 5)
    texts |= {20: texts[3], 21: "ab" * 300, 22: "ab" * 200, 23: passage * 2, 24: "", 25: "😷" * 149}
    rows = [(i, t, 1) for i, t in texts.items()] + [(30, None, 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h int")
    assert {tuple(x) for x in shared.shared_spans(df).collect()} == brute_shared(texts, 150)
    assert shared.shared_spans(df.limit(0)).count() == 0


# ---- 4 ----


def test_consensus_beats_votes(spark):
    r = random.Random(4)
    types = ["A", "B", "C"]
    swap = {"A": "B", "B": "A", "C": "C"}
    truth, rows = {}, []
    for i in range(600):
        t = truth[i] = r.choice(types)
        rows += [(i, "always_a", "A"), (i, "swap" if i % 2 else "SWAP ", swap[t] if r.random() < 0.95 else t)]
        for s, p in (("n-1", 0.85), ("n-2", 0.8), ("weak", 0.5)):
            rows.append((i, s, t if r.random() < p else r.choice(types)))
    rows += [(0, None, "A"), (1, "n-1", None), (9999, None, None)]
    df = spark.createDataFrame([(*x, None) for x in rows], "item_id bigint, source string, type string, confidence double")
    none = spark.createDataFrame([], "item_id bigint, sources array<string>, confidences array<double>, type string")
    found, sources = consensus.consensus(df, none)
    got = {x.item_id: x.label for x in found.collect()}
    assert got.pop(9999) is None and len(got) == 600
    right = sum(got[i] == t for i, t in truth.items())
    votes = {i: [x[2] for x in rows if x[0] == i and x[1] and x[2]] for i in truth}
    assert right > 540 and right > sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items())
    rel = {x.source: x.reliability for x in sources.collect()}
    assert set(rel) == {"always_a", "swap", "n_1", "n_2", "weak"} and rel["n_1"] > rel["weak"] > rel["swap"]
    assert consensus.consensus(df.limit(0), none)[0].count() == 0


def test_consensus_objective_rises_and_items_matter(spark):
    r = random.Random(40)
    types, rows = ["A", "B", "C"], []
    for i in range(400):
        t, odd = r.choice(types), r.random() < 0.3  # an odd item draws one wrong answer
        for s in range(6):
            rows.append((i, f"s{s}", r.choice(types) if r.random() < 0.3 else "C" if odd and r.random() < 0.5 else t, r.choice((None, 0.4, 0.75, 0.95, 7.0, float("nan")))))
    cast = consensus.votes(
        spark.createDataFrame(rows[1000:], "item_id bigint, source string, type string, confidence double"),
        spark.createDataFrame([(i, t, [s, None], [c]) for i, s, t, c in rows[:1000]] + [(1, None, None, None), (2, "A", ["s1"], None)], "item_id bigint, type string, sources array<string>, confidences array<double>"),
    )
    items, model = consensus._prepare(cast)
    model.fit(items)
    assert len(model.objective) > 2 and all(b >= a - 1e-6 * abs(a) for a, b in zip(model.objective, model.objective[1:]))
    arrow = items.toArrow().combine_chunks().to_batches()[0]
    one = consensus.Batch(arrow.column("voters"), arrow.column("votes"), model.members)
    q, item, _, value = one.fit(model.source, model.prior)
    plain, _, _, before = one.fit(model.source, model.prior, inner=0)
    assert abs(item).max() > 0.3 and (value >= before - 1e-9).all()
    assert (q.argmax(axis=1) != plain.argmax(axis=1)).any()


def test_consensus_finds_copies_only(spark):
    r = random.Random(41)
    types, rows = ["A", "B", "C", "D"], []
    for i in range(500):
        t = r.choice(types)
        own = {s: t if r.random() < 0.7 else r.choice(types) for s in "abcdefgh"}
        own["copy"] = own["a"] if r.random() < 0.95 else r.choice(types)
        own["stuck"], own["stuck2"] = "A", "A"  # alike by their nature, not by copying
        rows += [(i, s, x, None) for s, x in own.items()]
    items, model = consensus._prepare(spark.createDataFrame(rows, "item_id bigint, source string, type string, confidence double"))
    model.fit(items)
    groups = {g: [s for s, m in zip(model.sources, model.members.tolist()) if m == g] for g in model.members.tolist()}
    assert sorted(x for x in groups.values() if len(x) > 1) == [["a", "copy"]]


# ---- 5 ----


def test_common_words_in_order():
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert overlap.common_in_order(a, b) == d[-1][-1]


def test_shard_counts_and_reads_back():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(60, 90))) for _ in range(30)]
    shard = overlap.Shard.load(overlap.Shard(np.arange(30), texts).dump())
    known, flat, sizes = overlap._words(texts)
    number = shard.numbers(known)
    starts = np.cumsum(sizes) - sizes
    read = shard.read(np.arange(30))
    assert all((read[i] == number[flat[starts[i] : starts[i] + sizes[i]]]).all() for i in range(30))
    for _ in range(60):
        pattern = [r.choice(list(number)) for _ in range(r.randrange(1, 5))]
        low, high = shard.first[pattern[-1]], shard.first[pattern[-1] + 1]
        for w in pattern[-2::-1]:
            low, high = (int(x[0]) for x in shard.back(np.array([w]), np.array([low]), np.array([high])))
        seen = sum((x[i : i + len(pattern)] == pattern).all() for x in read.values() for i in range(len(x) - len(pattern) + 1))
        assert high - low == seen


def test_cross_split_pairs(spark):
    r = random.Random(7)
    base = [text(r, r.randrange(60, 200)) for _ in range(20)]
    texts, splits = list(base), ["train"] * 20
    for i in range(12):
        w = base[i].split()
        at = r.randrange(len(w))
        w[at : at + int(len(w) * r.choice((0, 0.1, 0.15, 0.5)))] = ["mới"] * r.randrange(5)
        texts.append(" ".join(w))
        splits.append(r.choice(("dev", "test", "holdout", "train")))
    texts += [base[0], base[0], "ngắn", None, "", base[1]]
    splits += ["test", "train", "test", "test", "test", None]
    got = {tuple(x) for x in overlap.cross_split_pairs(docs(spark, texts, split=splits, h=splits)).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            if a and b and splits[i] and splits[j] and (splits[i] == "train") != (splits[j] == "train"):
                p, q = a.split(), b.split()
                if min(len(p), len(q)) >= 60 and overlap.common_in_order(p, q) >= 0.8 * max(len(p), len(q)):
                    want.add((i, j))
    assert got == want and len(want) > 4


# ---- 6 and 7 ----


def test_ids_are_those_of_the_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import os

    path = os.path.join(tokenize.TOKENIZERS, "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=tokenize.SPLIT, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    texts = [text(r, 50), None, "", "aaaaaaaaaaaa bbbbbbbb", "  \r\n\t x", "<|endoftext|>", "".join(chr(r.randrange(32, 0x3000)) for _ in range(2000)), "đ" * 30000, text(r, 50)]
    got = {x.doc_id: x.ids for x in tokenize.encode(docs(spark, texts, ids=["x"] * len(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t or "") for t in texts]


def test_packing(spark):
    r = random.Random(9)
    df = docs(spark, [text(r, r.randrange(1, 60)) for _ in range(80)] + [None, "", text(r, 900)] + ["ho khan"] * 30)
    rows = packing.pack(df, 256).collect()
    size = {x.doc_id: x.n_tokens for x in tokenize.encode(df, counts=True).collect()}
    total, held = {}, {}
    for x in rows:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
        held.setdefault(x.container_id, []).append(x.n_tokens)
    assert total == size and all(c is None or sum(n) <= 256 for c, n in held.items())
    assert held.pop(None) == [0, 0] and sorted(held) == list(range(len(held)))
    assert all(x.piece == 0 for x in rows if size[x.doc_id] <= 256)
    free = []  # an item at a time into the fullest container that has room, longest first
    for n in sorted((x.n_tokens for x in rows if x.n_tokens), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(256 - n)
    assert len(held) <= len(free)
    assert packing.pack(df.limit(0)).count() == 0


def test_patterns_hold_the_histogram():
    r = random.Random(10)
    h = {n: r.randrange(1, 50) for n in r.sample(range(1, 101), 40)}
    seen = {}
    for pattern, count in packing.pack_histogram(h, 100):
        assert sum(pattern) <= 100
        for n in pattern:
            seen[n] = seen.get(n, 0) + count
    assert seen == h and packing.pack_histogram({}, 10) == []


# ---- 8 ----

CASES = [
    ("Gửi qua ⟦EMAIL:thoai.trung+bv@hopthu.example⟧.", None), ("hộp thư ⟦EMAIL:d-halda [at] thu [dot] example⟧ / ⟦PHONE:067 058 4251⟧", None), ("email: ⟦EMAIL:n_vong(at)nha.example.org⟧", None), ("email: không có", None),
    ("ĐT ⟦PHONE:061-492-9161⟧ hoặc ⟦PHONE:0084 40977 2640⟧", None), ("Tel: ⟦PHONE:(061) 120 4965⟧", None), ("số ⟦PHONE:+84 60 137 9423⟧", None), ("số không sáu một hai ba bốn năm sáu bảy", None),
    ("gọi ⟦PHONE:không sáu một hai ba bốn năm sáu bảy tám⟧ nhé", None), ("CCCD ⟦ID:XN 2 47 811 867 7886⟧.", None), ("Hộ chiếu số ⟦ID:Q92968517⟧", None), ("Số thẻ BHYT: ⟦ID:088 570 848 361⟧", None), ("mã đơn 261781875388; Lô thuốc 852190732", None),
    ("Độ lọc 114.958.1943", None), ("Địa chỉ: ⟦ADDRESS:39/5/21 Cầu Sậy, xã Trà Hạc, Q.7, TP An Khải⟧ [AB12CD]", None), ("lives at ⟦ADDRESS:787 Tansy Hill St., Lowquay⟧, sample X", None), ("buồng 12 khoa Nội Tân Lộ", None),
    ("Họ tên ⟦NAME:ĐOÀN TIẾN LỘ⟧, CCCD ⟦ID:084572452099⟧", None), ("Mr. ⟦NAME:Halverby, Quenby⟧ consented", None), ("⟦NAME:Corwyn A. Prowdle⟧ - ⟦ID:W13267992⟧", None), ("nhờ chú ⟦NAME:Quýnh⟧ buồng bên", None), ("Hội chứng Rutanpra điển hình, dấu Belmoesk", None),
    ("Mẹ từng mắc sốt; anh trai đau đầu", None), ("theo lời ⟦NAME:Thân Ngọc Lộ⟧, cơn đau giảm", None), ("Mẹ là ⟦NAME:Tạ Diệu Oanh⟧, cha là ⟦NAME:Giáp Ngọc Hanhu⟧", None), ("LÝ DO VÀO VIỆN", None), ("", None),
]


@pytest.mark.parametrize("marked", [c[0] for c in CASES])
def test_private_spans(marked):
    plain, want, at = "", [], 0
    while (i := marked.find("⟦", at)) >= 0:
        plain += marked[at:i]
        kind, body = marked[i + 1 : marked.index("⟧", i)].split(":", 1)
        want.append((len(plain), len(plain) + len(body), kind))
        plain += body
        at = marked.index("⟧", i) + 1
    plain += marked[at:]
    assert sorted(private.Finder()(plain)) == want
    assert sorted(private.Finder()("😷\n" + plain + "\r\nx")) == [(a + 2, b + 2, k) for a, b, k in want]


def test_redaction_keeps_the_rest(spark):
    df = docs(spark, ["ĐT 0612345678;", None, ""], kind=["a", None, "b"])
    assert [r.text for r in private.redact_private(df).orderBy("doc_id").collect()] == ["ĐT [PHONE];", None, ""]
    assert private.find_private(df).select("doc_id", "span_start", "span_end", "kind").collect() == [(0, 3, 13, "PHONE")]
    assert private.find_private(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("text, name", [
    ("BN Nguyễn Thị Kim Ngân Hoàng Anh Thư Lan Chi vào viện", "Nguyễn Thị Kim Ngân Hoàng Anh Thư Lan Chi"), ("theo lời Kowalski, vào lúc 3 giờ", "Kowalski"),
    ("Trần Zelkova khai đau bụng", "Trần Zelkova"), ("Theo dõi Viêm Mạc Treo Trên Thể Khô", None), ("Lê CRP tăng", None),
])
def test_names_of_any_length_and_spelling(text, name):
    got = [text[a:b] for a, b, k in private.Finder()(text) if k == "NAME"]
    assert got == ([name] if name else [])

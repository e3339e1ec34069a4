"""Detection, resolving and the whole of extraction on small texts."""

import pytest

from spanloom.operators import extract
from spanloom.operators.extract import DIAGNOSIS, DRUG, PATIENT, RESULT, SYMPTOM, TEST

LEXICON = extract.Lexicon(["ho", "đau đầu", "đau"], ["lao phổi", "lao"], ["aspirin"], ["lin", "zocor", "glucose"], ["kali", "kali máu"], ["glucose"], {"triệu chứng": SYMPTOM, "chẩn đoán": DIAGNOSIS}, ["bệnh nhân"])


def found(text, sections=False):
    return [(text[a:b], kind) for a, b, kind, *_ in extract.Detector(LEXICON, sections)(text)]


@pytest.mark.parametrize("text, want", [
    ("Đau đầu, ĐAU, hoa", [("Đau đầu", SYMPTOM), ("ĐAU", SYMPTOM)]), ("lao phổi; laoBệnh", [("lao phổi", DIAGNOSIS), ("lao", DIAGNOSIS)]),
    ("aspirin 81 mg uống sáng, ho", [("aspirin 81 mg uống sáng", DRUG), ("ho", SYMPTOM)]), ("Aspirin 2 viên/ngày", [("Aspirin 2 viên", DRUG)]), ("aspirin 81 lần cuối", [("aspirin 81 lần", DRUG)]),
    ("lin đỏ; dùng lin; lin 5 mg", [("lin", DRUG), ("lin 5 mg", DRUG)]), ("Thuốc:\n- lin", [("lin", DRUG)]), ("glucose cao; glucose 5 %", [("glucose 5 %", DRUG)]), ("zocor", [("zocor", DRUG)]),
    ("kali máu: 4,1 mmol/L", [("kali máu", TEST), ("4,1", RESULT)]), ("kali 3 - 5", [("kali", TEST), ("3 - 5", RESULT)]), ("bệnh nhân nam 60 tuổi, 5 năm", [("bệnh nhân nam", PATIENT), ("60 tuổi", PATIENT)]), ("", []), ("x" * 9999, []),
])
def test_generators(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text, want", [
    ("BN Nữ, 7tuổi; 60  tuổi", ["Nữ", "7tuổi", "60  tuổi"]), ("mã bệnh án: AB-12-x. id bệnh nhân 7", ["mã bệnh án: AB-12-x", "id bệnh nhân 7"]), ("bệnh nhân, nam", ["nam"]), ("1234 tuổi; năm; mã bệnh nhân", []), ("", []), ("nam", ["nam"]),
])
def test_patient(text, want):
    assert [text[a:b] for a, b in extract.patient(text)] == want


def test_sections():
    t = "Triệu chứng:\n- mờ mắt (P)\n- bệnh nhân khai khác\n- một hai ba bốn năm sáu bảy\nKhám\n- phù chân\nChẩn đoán:\n• viêm gan: nặng\n2. Khác\n- u"
    assert found(t, sections=True) == [("mờ mắt", SYMPTOM), ("viêm gan", DIAGNOSIS)]


def test_resolve():
    e = lambda a, b, k, c: (a, b, k, c, "s", "")
    assert extract.resolve([e(0, 5, "A", 0.5), e(0, 5, "A", 0.9), e(1, 3, "A", 0.9), e(1, 3, "B", 0.1), e(4, 4, "A", 1.0)]) == [e(0, 5, "A", 0.9), e(1, 3, "B", 0.1)]
    assert extract.resolve([e(0, 9, "A", 0.5), e(2, 4, "A", 0.6), e(5, 6, "A", 0.4)]) == [e(2, 4, "A", 0.6), e(5, 6, "A", 0.4)]


def test_infer(spark):
    t = "Tiền sử: lao phổi. Hiện không đau đầu.\n" + "Khám bình thường. " * 6 + "\nDùng aspirin 81 mg"
    docs = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "", "x"), (4, "lạ", "x")], "doc_id bigint, text string, phrase string")
    codes = spark.createDataFrame([(DIAGNOSIS, "lao phoi", "A15"), (DIAGNOSIS, "lao phoi", "A16"), (DRUG, "aspirin", "1191"), (DRUG, None, "0")], "type string, phrase string, code string")
    got = {r.text: (r.type, r.assertions, r.candidates) for r in extract.infer(docs, LEXICON, codes).collect()}
    assert got == {"lao phổi": (DIAGNOSIS, ["isHistorical"], ["A15", "A16"]), "đau đầu": (SYMPTOM, ["isNegated"], []), "aspirin 81 mg": (DRUG, [], ["1191"])}
    assert extract.infer(docs.limit(0), extract.Lexicon(), codes).count() == 0

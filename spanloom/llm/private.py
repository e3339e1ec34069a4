"""Problem 8: personal information inside free text.

A text is read in three steps. A first transducer brings look-alike letters, widths,
blanks, hyphens and composed accents to one form; a second one rewrites, line by line
and only where a trigger stands, spelled digits and the disguises of ``@`` and ``.``.
Both keep for every output character the source stretch it came from. Detectors run
on the normalised line, triggered by the words that an Aho-Corasick automaton finds;
their spans are mapped back to code points of the source.

Kinds: EMAIL, PHONE, ID, ADDRESS, NAME; where two overlap, the first of these stays.
Null and empty texts have no spans and stay as they are. Whole texts are read. The
order of rows, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.lookalike import TABLE

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
# Vietnamese family names, and words of given names.
SURNAMES = """nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đinh trịnh mai đoàn đào lâm hà
phùng trương tạ bế phí ninh vi giáp âu lục khuất trưng nhữ đàm quản thân cung mạc lường cao châu chu doãn đồng hứa kiều
la lã lại lương lưu mã nghiêm nông ông phó quách quan sầm thái thạch thiều tiêu tôn tống triệu trà từ văn vương viên
ứng uông tăng cầm cấn diệp giang hàn khổng khúc kim lò lỗ lữ mẫn ma mông nhan nhâm nghị phương sử tần thang thi thẩm
tòng trang trình trử tường ung vàng xa yên""".split()
GIVEN = """quang thoại khắc hữu bảo diệu thị văn tiến ngọc như dực uyển sử bích nhạn khiêu oanh kỳ lãm chiêu ngân
tường thuyên vọng duyệt lộ đức minh anh hùng dũng tuấn hải long nam sơn phúc lộc thọ khánh hoa lan huệ cúc
trang thảo linh hương hạnh hiền hòa thu thủy xuân hạ đông mai đào liên nga nhung phương quỳnh vân yến tâm thanh
thành thắng trí trung tùng việt vinh xuyên đình công gia kim mạnh thế viết xuân""".split()
# Words after which a name, a personal number or an address stands.
NAME_CUES = """họ tên|họ và tên|tên bệnh nhân|người liên hệ|liên hệ|theo lời|bệnh nhân|bn|bác sĩ|bác sỹ|bs|điều dưỡng|y tá|đd|bà|ông|anh|chị
cô|chú|bác|dì|cậu|em|cháu|bé|mẹ là|cha là|bố là|vợ là|chồng là|con là|vợ|chồng|mr|mrs|ms|miss|dr|contact|per|spoke with|patient|name
prof|nurse|doctor""".replace("\n", "|").split("|")
ID_CUES = """cccd|cmnd|cmt|căn cước|định danh|giấy tờ tùy thân|giấy tờ tuỳ thân|hộ chiếu|passport|national id|id card|identity card
insurance no|insurance card|bhyt|bảo hiểm y tế|thẻ bảo hiểm""".replace("\n", "|").split("|")
ADDRESS_CUES = """đc|địa chỉ|nhà ở|sống ở|ngụ tại|cư trú|thường trú|tạm trú|trú tại|số nhà|nhà số|address|lives at|living at|resides at
đường|phố|ngõ|ngách|hẻm|đ.|street|st.|road|rd.|lane|avenue|ave.|close|drive|court""".replace("\n", "|").split("|")
NOT_NAMES = {"cccd", "cmnd", "cmt", "bhyt", "đt", "id", "tel", "zalo", "email", "sđt", "bn", "bs", "px", "spo", "crp", "ha", "bp", "hr", "tp", "kt", "pt", "đc", "icu", "nkq", "xn"}
NOT_FIRST = {"cho", "ngưng", "máy", "nội", "dấu", "started", "theo", "tiền", "bệnh", "chẩn", "lúc", "không", "khám", "history", "impression", "exam", "lot", "lô", "mã", "đơn", "seen", "family", "huyết", "nước", "người", "đang", "vào", "sau", "ghi", "tái", "gửi", "hộp", "gọi", "số", "the", "no"}
DIGITS = {w: d for d, ws in enumerate(("không zero", "một mốt one", "hai two", "ba three", "bốn tư four", "năm lăm five", "sáu six", "bảy bẩy seven", "tám eight", "chín nine")) for w in ws.split()}

CAP = rf"(?:[{UPPER}][^\W\d_]*)"
INITIAL = rf"[{UPPER}]\."
RUN = re.compile(rf"{CAP}(?: (?:{INITIAL}|{CAP}))*")
COMMA_GIVEN = re.compile(rf", ({CAP}(?: {INITIAL})?)(?![^\W\d_]| {CAP}| ?\d)")
BEFORE = re.compile(rf"(?<!\w)(?:{CAP}(?: (?:{INITIAL}|{CAP}))+|{CAP}, {CAP}(?: {INITIAL})?)$")
AFTER_CAP = re.compile(rf"(?<![^\W\d_]){CAP} $")
RELATION = re.compile(r"(?:con|cháu|vợ|chồng|bố|cha|mẹ|em|anh|chị|son|daughter|wife|husband|mother|father)\b")
WORDS = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)*")
AFTER_CUE = re.compile(r"\.?[ :]{1,3}")
EMAIL = re.compile(r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9][A-Za-z0-9._+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+")
PHONE = re.compile(r"(?<![\w+.,/\-])(?:(?:\(?\+84\)?|0084)(?:[ .\-]{0,1}\(?\d\)?){9}|\(0\d\d\)(?:[ .\-]?\d){7}|0(?:[ .\-]?\d){9})(?![\w]|[.\-/]\d|[ ]\d{2,4}(?![\d/:]))")
ID_VALUE = r"(?:[A-Z]{2}[ .]?\d(?:[ .]?\d){12}|[A-Z][ .]?\d(?:[ .]?\d){6,7}|\d(?:[ .]?\d){11}|\d(?:[ .]?\d){8})(?!\w|[.]\d|[ ]\d{3})"
ID_AT = re.compile(rf"(?:[ .:#\-]|số|no\.?|number)*[ :]({ID_VALUE})", re.I)
ID_FREE = re.compile(r"(?<![\w.])(?:[A-Z]{2}[ .]?\d(?:[ .]?\d){12}|[A-Z]\d{8})(?!\w|[.]\d)")
ID_DASH = re.compile(rf" ?[\-–] ?({ID_VALUE})", re.I)
HOUSE = r"(?<![\w/.,:])\d{1,5}[A-Da-d]?(?:/\d{1,4}[A-Da-d]?)*"
PLACE = rf"{CAP}(?: (?:{CAP}|\d{{1,3}}(?![\w/:])))*"
STREET = r"(?:đường|phố|ngõ|ngách|hẻm|kiệt|Đ\.|đ\.|Ph\.)"
UNIT = r"(?:phường|xã|thị trấn|ấp|thôn|khóm|khu phố|P\.|X\.|TT\.|quận|huyện|thị xã|thành phố|tỉnh|Q\.|H\.|TX\.|TP\.?|T\.)"
ADDRESS = re.compile(rf"{HOUSE},? (?:({STREET}) ?)?{PLACE}((?:,| -|-) ?(?:{UNIT} ?(?:{PLACE}|\d{{1,2}}(?![\w/:]))|{PLACE}(?! ?\d)))*")
ADDRESS_EN = re.compile(rf"{HOUSE} {CAP}(?: {CAP})*? (?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Drive|Dr\.?|Court|Way|Place|Square)(?![^\W\d_])(?:, {CAP}(?: {CAP})*)?")
ADDRESS_CASELESS = re.compile(rf"{HOUSE},? (?:đường|phố|ngõ|ngách|hẻm|đ\.)[^,;.\n\[#(]*(?:(?:,| -) ?(?:phường|xã|p\.|quận|huyện|q\.|tỉnh|tp\.?) ?[^,;.\n\[#(]*)*", re.I)
AT = re.compile(r"(?<=[A-Za-z0-9]) ?(?:\(at\)|\[at\]|\{at\}|<at>|@) ?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]) (?:at|a còng|a móc) (?=[A-Za-z0-9\-]+(?: ?(?:\[dot\]|\(dot\)) ?| dot | chấm |\.)[A-Za-z])", re.I)
DOT = re.compile(r"(?<=[A-Za-z0-9]) ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>) ?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]) (?:dot|chấm) (?=[A-Za-z])", re.I)
SPELLED = re.compile(rf"(?:\b(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))})\b[ ,.\-]*){{9,}}", re.I)
ODD = re.compile("[ ­̀-ͯΑ-ΩοЀ-ԯ -‒ -  -⁯−　︀-️﻿！-～]")


class Mapped:
    """A text and, for each of its characters, the stretch of the source that it stands for."""

    def __init__(self, text: str, cuts: list[tuple[int, int]] | None = None):
        self.text, self.cuts = text, cuts

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.cuts is None or a >= b else (self.cuts[a][0], self.cuts[b - 1][1])

    def rewrite(self, found: list[tuple[int, int, str]]) -> Mapped:
        """Each ``(start, end, new)`` replaced; what is new stands for the whole stretch it replaces."""
        if not found:
            return self
        out, cuts, at = [], [], 0
        own = self.cuts or [(i, i + 1) for i in range(len(self.text))]
        for a, b, new in found:
            out += (self.text[at:a], new)
            cuts += own[at:a]
            cuts += [(own[a][0], own[b - 1][1])] * len(new)
            at = b
        return Mapped("".join(out) + self.text[at:], cuts + own[at:])


def shapes(text: str) -> Mapped:
    """Look-alikes, widths, blanks, hyphens and composition in one form; line ends stay."""
    if not ODD.search(text):
        return Mapped(text)
    out, cuts = [], []
    for i, c in enumerate(text):
        to = c if c in "\r\n\t" else TABLE.get(ord(c), c)
        if to is None:
            if cuts:
                cuts[-1] = (cuts[-1][0], i + 1)
            continue
        if out and unicodedata.combining(c):
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
                cuts[-1] = (cuts[-1][0], i + 1)
                continue
        out.append(to)
        cuts.append((i, i + 1))
    return Mapped("".join(out), cuts)


def undisguise(line: Mapped) -> Mapped:
    """Spelled digits and the disguises of at and dot, rewritten."""
    spelled = []
    for m in SPELLED.finditer(line.text):
        for w in re.finditer(r"[^\W\d_]+[ ,.\-]*", m[0]):
            word = w[0].rstrip(" ,.-")
            last = w.end() == len(m[0])
            spelled.append((m.start() + w.start(), m.start() + (w.start() + len(word) if last else w.end()), str(DIGITS[word.lower()])))
    line = line.rewrite(spelled)
    line = line.rewrite([(m.start(), m.end(), ".") for m in DOT.finditer(line.text)] if "@" in line.text or AT.search(line.text) else [])
    return line.rewrite([(m.start(), m.end(), "@") for m in AT.finditer(line.text) if m[0] != "@"])


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("đ", "d")


LEXICON = {w for x in SURNAMES + GIVEN for w in (x, _plain(x))}
FAMILY = {w for x in SURNAMES for w in (x, _plain(x))}


GIVEN_FORMS = {w for x in GIVEN for w in (x, _plain(x))}


def _automaton():
    import ahocorasick

    found: dict[str, set[str]] = {}
    for kind, words in (
        ("name", NAME_CUES), ("id", ID_CUES), ("address", ADDRESS_CUES), ("family", FAMILY),
        ("rewrite", ["(at)", "[at]", "{at}", "<at>", "a còng", "a móc", " at ", "dot]", "dot)", " dot "]), ("digit", list(DIGITS)),
        ("mail", ["@"]), ("dash", [" - "]), ("person", ["("]), ("semicolon", ["; "]),
    ):
        for w in words:
            found.setdefault(w, set()).add(kind)
    auto = ahocorasick.Automaton()
    for w, kinds in found.items():
        auto.add_word(w, (len(w), tuple(kinds), w[0].isalpha(), w[-1].isalpha()))
    auto.make_automaton()
    return auto


class Finder:
    """Finds the spans of one text after the other."""

    def __init__(self):
        self.auto = _automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        whole = shapes(text)
        t = whole.text
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        spans = [(m.start(), m.end(), "PHONE") for m in PHONE.finditer(t)] + [(m.start(), m.end(), "ID") for m in ID_FREE.finditer(t)]
        hits: dict[tuple[int, int], set[tuple[str, int, int]]] = {}
        bounds: tuple[int, int] = (0, -1)
        n = len(t)
        for end, (size, kinds, left, right) in self.auto.iter(low):
            a, b = end + 1 - size, end + 1
            if left and a and low[a - 1].isalnum() or right and b < n and low[b].isalpha():
                continue
            if not bounds[0] <= a < bounds[1]:
                bounds = (max(t.rfind("\n", 0, a), t.rfind("\r", 0, a)) + 1, min(x if x >= 0 else n for x in (t.find("\n", b), t.find("\r", b))))
            for k in kinds:
                if k == "family" and not t[a].isupper() and not t[bounds[0] : bounds[1]].islower():
                    continue
                if k == "name" and b < n:
                    x = t[b + 1 : b + 4].lstrip(" :.")
                    if not (x and x[0].isupper()) and not t[bounds[0] : bounds[1]].islower():
                        continue
                hits.setdefault(bounds, set()).add((k, a - bounds[0], b - bounds[0]))
        for (a, b), found in hits.items():
            kinds = {k for k, _, _ in found}
            line = Mapped(t[a:b])
            # a spelled number has nine words at least
            if "rewrite" in kinds or "mail" in kinds or "digit" in kinds and sum(k == "digit" for k, _, _ in found) >= 9:
                line = undisguise(line)
                if line.cuts is not None:  # found again on the rewritten line
                    found = self._hits(line.text)
                    spans += [(*(a + x for x in line.source(m.start(), m.end())), "PHONE") for m in PHONE.finditer(line.text)]
            spans += [(*(a + x for x in line.source(x, y)), k) for x, y, k in self._line(line.text, found)]
        spans = _disjoint(spans)
        return [(*whole.source(a, b), k) for a, b, k in spans]

    def _hits(self, line: str) -> set[tuple[str, int, int]]:
        low = line.lower()
        out = set()
        for end, (size, kinds, left, right) in self.auto.iter(low if len(low) == len(line) else line):
            a, b = end + 1 - size, end + 1
            if not (left and a and low[a - 1].isalnum() or right and b < len(low) and low[b].isalpha()):
                out |= {(k, a, b) for k in kinds}
        return out

    def _line(self, line: str, hits: set[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        kinds = {k for k, _, _ in hits}
        if "@" in line:
            out += [(m.start(), m.end(), "EMAIL") for m in EMAIL.finditer(line)]
        for k, _, b in hits:
            if k == "id" and (m := ID_AT.match(line, b)):
                out.append((*m.span(1), "ID"))
        caseless = line.islower() or line.isupper()
        if "address" in kinds:
            cues = [b for k, a, b in hits if k == "address"]
            for rule in (ADDRESS_EN, ADDRESS) if not caseless else (ADDRESS_CASELESS,):
                for m in rule.finditer(line):
                    # a cue right before it, or a kind of street in it
                    if any(-4 <= m.start() - c <= 4 or m.start() < c <= m.end() for c in cues):
                        out.append((m.start(), m.start() + len(m[0].rstrip(" ,-")), "ADDRESS"))
        taken = [(a, b) for a, b, _ in out]
        names = self._names(line, hits, caseless)
        for a, b in names:
            if not any(a < y and x < b for x, y in taken):
                out.append((a, b, "NAME"))
        if "dash" in kinds:
            for _, b in names:
                if m := ID_DASH.match(line, b):
                    out.append((*m.span(1), "ID"))
        return out

    def _names(self, line: str, hits: set[tuple[str, int, int]], caseless: bool) -> list[tuple[int, int]]:
        out = []
        for k, a, b in hits:
            at = None
            if k == "name":
                m = AFTER_CUE.match(line, b)
                at = m.end() if m else None
                if at is not None and not caseless and (got := self._run(line, at, True)):
                    out.append(got)
                    continue
            elif k == "family":
                at = a
                if not caseless:
                    got = self._run(line, at, False)
                    if got and _family_name(line[slice(*got)], bool(AFTER_CAP.search(line, 0, at))):
                        out.append(got)
                    continue
            if at is not None and caseless and (m := WORDS.match(line, at)):
                words = m[0].split(" ")
                n = 0
                while n < len(words) and words[n].lower() in (FAMILY if n == 0 else GIVEN_FORMS):
                    n += 1
                if n > 1:
                    out.append((at, at + len(" ".join(words[:n]))))
            elif k in ("dash", "semicolon", "person"):
                # the name that ends right before it
                m = BEFORE.search(line[:a].rstrip())
                if not m or m[0].split()[0].rstrip(",").lower() in NOT_FIRST | NOT_NAMES:
                    continue
                rest = line[b:]
                if k == "dash" and re.match(ID_VALUE, rest, re.I) or k == "semicolon" and EMAIL.match(rest) or k == "person" and RELATION.match(rest):
                    out.append(m.span())
        return _widest(out)

    def _run(self, line: str, at: int, cue: bool) -> tuple[int, int] | None:
        """The name that begins at ``at``: capitalised words, initials, and a given name after a comma."""
        m = RUN.match(line, at)
        if not m:
            return None
        words = m[0].split(" ")
        n = 0
        while n < len(words) and words[n].lower() not in NOT_NAMES:
            n += 1
        words = words[:n]
        if not words or cue and words[0].lower() in NOT_FIRST:
            return None
        end = at + len(" ".join(words))
        if line[end : end + 1].isdigit() or line[end : end + 1] == "-" and line[end + 1 : end + 2].isalnum():
            return None
        if len(words) == 1 and cue and (g := COMMA_GIVEN.match(line, end)) and g[1].lower() not in NOT_NAMES | NOT_FIRST:
            end = g.end()
        return at, end


def _family_name(run: str, inside: bool) -> bool:
    """A family name and a word more that is listed as a given name, or spelled as one where the run begins with the family name."""
    words = run.split(" ")
    first = words[1] if len(words) > 1 else ""
    spelled = not inside and len(first) > 1 and first[1:].islower() and first.lower() not in NOT_FIRST and first.lower() not in NAME_CUES
    return words[0].lower() in FAMILY and (first.lower() in LEXICON or spelled)


def _widest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
        if not any(a < y and x < b for x, y in out):
            out.append((a, b))
    return out


def _disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for a, b, k in sorted(set(spans), key=lambda s: (KINDS.index(s[2]), s[0] - s[1], s[0])):
        i = bisect_right(starts, a)
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
            out.insert(i, (a, b, k))
            starts.insert(i, a)
    return out


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in square brackets, the rest as it is."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in spans:
        out += (text[at:a], f"[{k}]")
        at = b
    return "".join(out) + text[at:]


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id, span_start, span_end, kind``, half-open code points of the source; a narrow plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for a, b, k in find(text):
                    for col, x in zip(rows, (doc, a, b, k)):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "span_start", "span_end", "kind"])

    return docs.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, span_start int, span_end int, kind string")


def redact_private(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with typed placeholders; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in batches:
            texts = [redact(t, find(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, text string")

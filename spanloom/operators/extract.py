"""Entities out of texts, end to end: detect, resolve, assert, link, check.

All generators run in one reading of a text: its folded form (case, accents, composition
aside) meets one Aho-Corasick automaton of all listed phrases, and what stands at a phrase
decides the rest (a drug takes its dose along, a test its value). Confidences say which
generator spoke and rank duplicates. Null and empty texts have no entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fold_key, fold_with_map
from spanloom.operators.generate import _automaton, _blank, _decimal, read_value
from spanloom.operators.scope import assertions
from spanloom.session import written

SYMPTOM, DIAGNOSIS, DRUG, TEST, RESULT, PATIENT = "TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "THÔNG_TIN_BỆNH_NHÂN"
#: Of entities that begin and end together, which comes first; and the confidence of each generator.
PRIORITY = {DRUG: 6, DIAGNOSIS: 5, TEST: 4, RESULT: 4, SYMPTOM: 3, PATIENT: 2}
CONFIDENCE = {"symptom": 0.82, "diagnosis": 0.9, "drug": 0.92, "catalog_dose": 0.88, "catalog": 0.68, "test": 0.82, "result": 0.78, "patient": 0.7, "section": 0.56}
# Fixed values, without accents: what may follow a drug's name, and what a line says where drugs are given.
FORMS = "vien ong goi chai lo tab tabs tablet cap caps capsule inj siro xit kem".split()
ROUTES = "po iv im sc uong tiem truyen ngam dat boi tm tb".split()
TIMES = "sang trua chieu toi ngay lan bid tid qid qd od prn hs daily".split()
DOSES = ("mcg", "mg", "g", "ml", "l", "ui", "iu", "%")
GIVES = "thuoc dung uong tiem truyen dieu tri chi dinh toa medication".split()
#: Code points in which a test's value is looked for, words of a heading, of a section's item, and of a catalog name that needs a context.
VALUE_REACH, HEADING_WORDS, ITEM_WORDS, SHORT = 90, 10, 6, 5
# Words of a patient's age, sex and number.
YEARS, SEXES, NUMBERS, WHOSE = "tuổi", ("nam", "nữ"), ("mã", "id"), ("bệnh nhân", "bệnh án")


@dataclass
class Lexicon:
    """Listed phrases. ``catalog`` names are drugs of a large list, held to a dose or a context where they are short or in ``doubtful``."""

    symptoms: list[str] = field(default_factory=list)
    diagnoses: list[str] = field(default_factory=list)
    drugs: list[str] = field(default_factory=list)
    catalog: list[str] = field(default_factory=list)
    tests: list[str] = field(default_factory=list)
    doubtful: list[str] = field(default_factory=list)
    #: Headings (parts of a line, in small letters) under which items are of a type; used with ``sections``.
    headings: dict[str, str] = field(default_factory=dict)
    #: Items, and beginnings of items, that name no entity.
    stop: list[str] = field(default_factory=list)


def dose_tail(s: str, at: int) -> tuple[int, bool]:
    """End of the run of doses, forms, routes and times after a drug's name in a folded text, and whether a dose is in it."""
    end, dose = at, False
    while True:
        i = _blank(s, end)
        if i == end:
            return end, dose
        n = _decimal(s, i)
        if n > i:
            u = _blank(s, n)
            unit = next((d for d in DOSES if s.startswith(d, u) and not s[u + len(d) : u + len(d) + 1].isalnum()), None)
            if unit is None:
                word = re.match(r"[a-z]+", s[u:])
                if not word or word[0] not in (*FORMS, *TIMES):
                    return end, dose
                end = u + len(word[0])
            else:
                end, dose = u + len(unit), True
            continue
        word = re.match(r"[a-z]+(?![^\W_])", s[i:])
        if not word or word[0] not in (*FORMS, *ROUTES, *TIMES):
            return end, dose
        end = i + len(word[0])


def first_value(s: str) -> tuple[int, int] | None:
    """The first number after a colon, an equals sign or a blank."""
    for m in re.finditer(r"[\s:=]", s):
        end = _decimal(s, m.end())
        if end > m.end():
            whole = read_value(s, m.end())
            return m.end(), whole if "-" in s[end:whole] else end
    return None


def patient(text: str) -> list[tuple[int, int]]:
    """Places of an age ("60 tuổi"), of a sex with the patient before it if named, and of a labelled number of a patient or a record."""
    low = text.lower() if len(text.lower()) == len(text) else text
    words = [m.span() for m in re.finditer(r"\w+", low)]
    said = [low[a:b] for a, b in words]
    joined = lambda i: i + 1 < len(words) and low[words[i][1] : words[i + 1][0]].isspace()
    pair = lambda i: f"{said[i]} {said[i + 1]}" if i >= 0 and joined(i) else ""
    out = []
    for i, (word, (a, b)) in enumerate(zip(said, words)):
        if word.isdecimal() and len(word) <= 3 and i + 1 < len(words) and said[i + 1] == YEARS and not low[b : words[i + 1][0]].strip():
            out.append((a, words[i + 1][1]))
        elif word.endswith(YEARS) and word[: -len(YEARS)].isdecimal() and len(word) <= 3 + len(YEARS):
            out.append((a, b))
        elif word in SEXES:
            named = i >= 2 and pair(i - 2) == WHOSE[0] and joined(i - 1)
            out.append((words[i - 2][0] if named else a, b))
        elif word in NUMBERS and joined(i) and pair(i + 1) in WHOSE and i + 3 < len(words):
            end = words[i + 2][1]
            value = words[i + 3][0]
            if low[end:value].strip() in ("", ":", "#"):
                stop = words[i + 3][1]
                while stop < len(low) and (low[stop] == "-" or low[stop].isalnum()):
                    stop += 1
                out.append((a, stop))
    return out


class Detector:
    """Finds the entities of one text after the other: start, end, type, confidence, source, folded phrase."""

    def __init__(self, lexicon: Lexicon, sections: bool):
        self.lexicon, self.sections = lexicon, sections
        self.kinds: dict[str, list[tuple[str, str]]] = {}
        for source, kind, phrases in (
            ("symptom", SYMPTOM, lexicon.symptoms), ("diagnosis", DIAGNOSIS, lexicon.diagnoses), ("drug", DRUG, lexicon.drugs),
            ("catalog", DRUG, lexicon.catalog), ("test", TEST, lexicon.tests),
        ):
            for key in {fold_key(p) for p in phrases if p}:
                if key:
                    self.kinds.setdefault(key, []).append((source, kind))
        self.doubtful = {fold_key(p) for p in lexicon.doubtful}
        self.auto = _automaton(tuple(sorted(self.kinds)))

    def __call__(self, text: str) -> list[tuple[int, int, str, float, str, str]]:
        plain, places = fold_with_map(text)
        kept = [i for i, c in enumerate(plain) if not c.isspace() or not i or not plain[i - 1].isspace()]
        single = "".join(" " if plain[i].isspace() else plain[i] for i in kept)
        out: list[tuple[int, int, str, float, str, str]] = []

        def add(a: int, b: int, kind: str, source: str, phrase: str) -> None:
            x, y = places[a], places[b - 1] + 1
            while y > x and text[y - 1] in " \t,;:":
                y -= 1
            out.append((x, y, kind, CONFIDENCE[source], source, phrase))

        for end, phrase in self.auto.iter(single) if self.kinds else ():
            a, b = kept[end + 1 - len(phrase)], kept[end] + 1
            if a and (plain[a - 1].isalnum() or plain[a - 1] == "_") or b < len(plain) and plain[b].isalnum() and not text[places[b]].isupper():
                continue
            shown = text[places[a] : places[b - 1] + 1]
            for source, kind in self.kinds[phrase]:
                if source in ("symptom", "diagnosis") and len(phrase) <= 3 and phrase.isascii() and shown.casefold() != phrase:
                    continue  # so short a phrase must stand as it is
                if kind == DRUG:
                    tail, dose = dose_tail(plain, b)
                    if source == "catalog":
                        if phrase in self.doubtful and not dose or " " not in phrase and len(phrase) < SHORT and not dose and not self._given(plain, a):
                            continue
                        source = "catalog_dose" if dose else source
                    add(a, tail, kind, source, phrase)
                    continue
                add(a, b, kind, source, phrase)
                if kind == TEST and (v := first_value(plain[b : b + VALUE_REACH])):
                    add(b + v[0], b + v[1], RESULT, "result", phrase)
        out += [(a, b, PATIENT, CONFIDENCE["patient"], "patient", "") for a, b in patient(text)]
        if self.sections:
            out += self._items(text)
        return resolve(out)

    @staticmethod
    def _given(plain: str, at: int) -> bool:
        """Whether the line before, or a short line above it, speaks of drugs."""
        line = plain.rfind("\n", 0, at) + 1
        own = re.sub(r"\W+", " ", f" {plain[max(line, at - 120) : at]} ")
        above = next((x for x in reversed(plain[:line].split("\n")) if x.strip()), "").split()
        return any(f" {w} " in own for w in GIVES) or len(above) <= 8 and ("thuoc" in " ".join(above) or "medication" in above)

    def _items(self, text: str) -> list[tuple[int, int, str, float, str, str]]:
        """Bulleted lines under a heading of a type; a numbered or short line that is no item ends the section."""
        out, kind, at = [], None, 0
        for line in text.split("\n"):
            body = line.strip()
            low = body.casefold()
            item = re.match(r"\s*[-•]\s+(.+)", line)
            wanted = next((k for h, k in self.lexicon.headings.items() if h in low), None)
            if wanted:
                kind = wanted
            elif re.match(r"\d+\.\s", body) or not item and body and len(body.split()) <= HEADING_WORDS and not body.endswith("."):
                kind = None
            if item and kind:
                phrase = re.split(r"[:;(]", item[1], maxsplit=1)[0].strip(" -*\r")
                if 1 <= len(phrase.split()) <= ITEM_WORDS and not any(phrase.casefold().startswith(x) for x in self.lexicon.stop):
                    start = at + line.index(phrase)
                    out.append((start, start + len(phrase), kind, CONFIDENCE["section"], "section", fold_key(phrase)))
            at += len(line) + 1
        return out


def resolve(found: list[tuple[int, int, str, float, str, str]]) -> list[tuple[int, int, str, float, str, str]]:
    """Of equal places and types the most confident; of one type an entity inside another goes, unless it is more confident, when the other goes."""
    best: dict[tuple[int, int, str], tuple] = {}
    for e in found:
        if e[0] < e[1] and (e[:3] not in best or e[3] > best[e[:3]][3]):
            best[e[:3]] = e
    kept: list[tuple] = []
    open_: dict[str, list[tuple]] = {}
    for e in sorted(best.values(), key=lambda e: (e[0], e[0] - e[1], -PRIORITY.get(e[2], 0), e[2])):
        around = [x for x in open_.get(e[2], []) if x[1] > e[0]]
        over = [x for x in around if x[1] >= e[1]]
        if any(x[3] >= e[3] for x in over):
            open_[e[2]] = around
            continue
        kept = [x for x in kept if x not in over] if over else kept
        open_[e[2]] = [x for x in around if x not in over] + [e]
        kept.append(e)
    return sorted(kept)


def detect(docs: DataFrame, lexicon: Lexicon, sections: bool = False) -> DataFrame:
    """``record_id, start, end, text, type, confidence, source, phrase`` of each entity; the lexicon goes to each worker, so its size must be checked before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Detector(lexicon, sections)
        for pdf in batches:
            rows = [(doc, a, b, text[a:b], *rest) for doc, text in zip(pdf["doc_id"], pdf["text"]) if text for a, b, *rest in find(text)]
            yield pd.DataFrame(rows, columns=["record_id", "start", "end", "text", "type", "confidence", "source", "phrase"])

    kind = "record_id bigint, start int, `end` int, text string, type string, confidence double, source string, phrase string"
    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, kind)


def infer(docs: DataFrame, lexicon: Lexicon, codes: DataFrame, sections: bool = False) -> DataFrame:
    """``record_id, start, end, text, type, source, assertions, candidates``: detected entities, what their contexts say, and the codes of their phrases.

    ``codes``: ``type, phrase`` (folded), ``code``; a phrase of a coded type that is not listed takes the codes of none. Candidates are sorted; other types have none.
    """
    found = written(detect(docs, lexicon, sections).distinct())  # read twice below, and much smaller than the texts
    said = assertions(found, docs, (SYMPTOM, DIAGNOSIS, DRUG), (DIAGNOSIS, DRUG), SYMPTOM)
    listed = codes.dropna().groupBy("type", "phrase").agg(F.sort_array(F.collect_set("code")).alias("candidates"))
    j = found.join(said, ["record_id", "start", "end", "type"]).join(listed, ["type", "phrase"], "left")
    none = F.array().cast("array<string>")
    return j.select("record_id", "start", "end", "text", "type", "source", "assertions", F.coalesce("candidates", none).alias("candidates"))

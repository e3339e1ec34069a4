"""Problem 2: freely typed entities mapped to the names of a reference list.

Token-level repair: each distinct token that the reference vocabulary lacks is joined to
it by edit distance of at most two slips, over keys of deleted letters (short words) or
of pieces one of which two slips must leave whole (long words). A whole text without its
blanks is such a token too, against whole names without blanks, so run-together and cut
words are repaired alike. The corrected tokens are combined by soft TF-IDF (inverse
document frequency of the word, times its closeness) to rank complete names, and the
ranked names are held against the text exactly: at most two slips over all letters.

A slip is a letter left out, added, replaced or swapped with its neighbour; letter case,
accents, punctuation, blanks, word order, disguised characters and added words that name
no concept don't count. Of several names the closest is taken, then the one closest with
accents, then the least identifier. Texts without a letter, and those no name fits, come
out as UNMATCHED; a null text is no case. Rows repeated under a span_id give one row, of
its last delivery. Texts are made distinct before any matching. A list of over ``MOST_NAMES``
names is taken in blocks, and the closest name of all blocks stays.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.lookalike import by_table

SLIPS = 2
ONTOLOGY = {"CHẨN_ĐOÁN": "WHO_ICD10_2019", "THUỐC": "RXNORM_CPC_2026_07"}
#: Names of the reference list that workers hold at once.
MOST_NAMES = 100_000
SHORT = 5
# Whole phrases that are taken off at either end, without accents.
BEFORE = ["theo doi", "nghi ngo", "nghi", "td", "kha nang", "k/n", "kn", "bi", "mac", "co the", "chua loai tru", "chan doan", "cd", "r/o", "thuoc", "vien", "ong", "goi", "chai", "inj", "tab", "cap", "siro", "probable", "possible", "suspected"]
AFTER = ["tu truoc", "cu", "da on", "tai kham", "hien tai", "moi", "on dinh", "old"]
DOSE = re.compile(
    r"(?<![^\W_])(?:\d+(?:[.,/]\d+)?\s*(?:mg|mcg|g|ml|l|ui|iu|%|vien|ong|goi|tab|tabs)?(?:\s*/\s*\d*\s*(?:ml|mg|vien|ngay))?(?:\s*x\s*\d+)?)(?![^\W\d_])"
)
USE = re.compile(
    r"\b(?:uong|tiem|truyen|ngam|dat|xit|boi)?\s*(?:sang|trua|chieu|toi|truoc an|sau an|khi dau|khi sot|truoc ngu|ngay\s*\d*\s*lan|(?:po|iv|im|sc)\s*(?:bid|tid|qid|qd|od|prn|hs)?|(?:bid|tid|qid|qd|od|prn|hs)|uong|tiem|truyen)\s*$"
)


@lru_cache(maxsize=200_000)
def _letter(c: str) -> str:
    d = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
    return d.replace("đ", "d")


def plain(s: str) -> str:
    """Letters without accents and case; what disguises them gone."""
    return "".join(map(_letter, by_table(s).casefold()))


def accented(s: str) -> str:
    return re.sub(r"[\W_]+", " ", by_table(s).casefold()).strip()


def squeeze(s: str) -> str:
    return re.sub(r"[\W_]+", " ", s).strip()


@lru_cache(maxsize=100_000)
def core(text: str, names: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """Forms of a text that may be a name: as it is, and without words added before and after."""
    s = plain(text)
    forms = [squeeze(s)]
    if forms[0] in names:
        return tuple(forms)
    s = re.sub(r"\([^()]*\)|[?!]", " ", s).strip(" .,;:-_")
    s = re.sub(r"[_\-]+", " ", s)
    changed = True
    while changed:
        forms.append(squeeze(s))
        changed = False
        for w in BEFORE:
            if re.match(rf"{re.escape(w)}[\s.:]+\S", s):
                s, changed = s[len(w) :].lstrip(" .:"), True
        for w in AFTER:
            if s.endswith(f" {w}"):
                s, changed = s[: -len(w)].rstrip(), True
        for rule in (USE, re.compile(DOSE.pattern + r"\s*$")):
            m = rule.search(s)
            if m and m.start() > 0 and m[0].strip():
                s, changed = s[: m.start()].rstrip(" ,;:"), True
    return tuple(dict.fromkeys(f for f in forms if f))


def distance(a: str, b: str, most: int) -> int:
    """Slips between two words: left out, added, replaced, swapped; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _deletes(w: str, n: int) -> set[str]:
    out = {w}
    for _ in range(n):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def listed_keys(w: str) -> set[str]:
    """Keys of a word of the vocabulary."""
    if len(w) <= SHORT:
        return {f"d{x}" for x in _deletes(w, SLIPS)}
    a, b = len(w) // 3, 2 * len(w) // 3
    return {f"{len(w)}.{i}.{x}" for i, x in enumerate((w[:a], w[a:b], w[b:]))}


def typed_keys(w: str) -> set[str]:
    """Keys of a typed word, one of which each listed word within two slips has."""
    keys = {f"d{x}" for x in _deletes(w, SLIPS)} if len(w) <= SHORT + SLIPS else set()
    for n in range(max(len(w) - SLIPS, SHORT + 1), len(w) + SLIPS + 1):
        a, b = n // 3, 2 * n // 3
        for i, (x, y) in enumerate(((0, a), (a, b), (b, n))):
            for s in range(max(0, x - SLIPS), min(len(w) - (y - x), x + SLIPS) + 1):
                keys.add(f"{n}.{i}.{w[s : s + y - x]}")
    return keys


def _blocks(nodes: DataFrame) -> Iterator[dict[str, list[tuple[str, str]]]]:
    """Identifier and name of every listed name by ontology, MOST_NAMES at most at a time, about."""
    names = nodes.where("identifier is not null").select(
        "ontology", "identifier", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")
    )
    names = names.where("name is not null").distinct()
    blocks = -(-names.count() // MOST_NAMES) or 1
    for i in range(blocks):
        own = names.where(F.pmod(F.xxhash64("identifier", "name"), F.lit(blocks)) == i).collect()
        yield {o: sorted((r.identifier, r.name) for r in own if r.ontology == o and squeeze(plain(r.name))) for o in ONTOLOGY.values()}


class NameIndex:
    """The names of one ontology: whole, without blanks, and by word with its weight."""

    def __init__(self, names: list[tuple[str, str]]):
        self.names = [(i, squeeze(plain(n)), accented(n)) for i, n in names]
        self.exact: dict[str, list[int]] = {}
        self.whole: dict[str, list[int]] = {}
        self.word: dict[str, int] = {}
        self.holders: dict[tuple[int, str], list[int]] = {}
        for k, (_, p, _) in enumerate(self.names):
            words = p.split()
            self.exact.setdefault(p, []).append(k)
            self.whole.setdefault(p.replace(" ", ""), []).append(k)
            for w in set(words):
                self.word[w] = self.word.get(w, 0) + 1
                self.holders.setdefault((len(words), w), []).append(k)
        n = len(self.names)
        self.idf = {w: math.log((1 + n) / (1 + x)) + 1 for w, x in self.word.items()}
        self.norm = [sum(self.idf[w] ** 2 for w in set(p.split())) for _, p, _ in self.names]
        self.keys = frozenset(self.exact)

    def _ranked(self, form: str, words: list[str], repaired: dict[str, list[tuple[str, int]]]) -> list[int]:
        """Names that may be within SLIPS, by soft TF-IDF of the repaired words.

        Either the letters without blanks are near, or there are as many words, each near one of the name.
        """
        joined = form.replace(" ", "")
        score = {k: 2.0 - d / (len(joined) + 1) for w, d in [(joined, 0), *repaired.get(joined, ())] for k in self.whole.get(w, ())}
        near = [dict(reversed([(w, 0), *repaired.get(w, ())])) for w in words]
        each = [{k for w in options for k in self.holders.get((len(words), w), ())} if len(options) < 50 else None for options in near]
        known = [x for x in each if x is not None]
        names = min(known, key=len) if known else {k for w in near[0] for k in self.holders.get((len(words), w), ())}
        for k in names:
            own = set(self.names[k][1].split())
            if all(not own.isdisjoint(options) for options in near):
                close = {w: max((1 - options[w] / (len(w) + 1) for options in near if w in options), default=None) for w in own}
                if None not in close.values():
                    score.setdefault(k, sum(self.idf[w] ** 2 * x for w, x in close.items()) / self.norm[k])
        return sorted(score, key=lambda k: (-score[k], k))

    def _slips(self, form: str, words: list[str], name: int) -> int:
        """Fewest slips: blanks aside, or word by word in any order."""
        p = self.names[name][1]
        d = distance(form.replace(" ", ""), p.replace(" ", ""), SLIPS)
        if d and len(words) > 1:
            a, b = sorted(words), p.split()
            if len(a) == len(b):  # words put to their closest, in order of closeness
                b = list(b)
                total = 0
                pairs = sorted((distance(x, y, SLIPS), i, j) for i, x in enumerate(a) for j, y in enumerate(b))
                left, right = set(range(len(a))), set(range(len(b)))
                for e, i, j in pairs:
                    if i in left and j in right:
                        left.discard(i)
                        right.discard(j)
                        total += e
                d = min(d, total)
        return d

    def find(self, text: str, repaired: dict[str, list[tuple[str, int]]]) -> tuple[int, int, int, str] | None:
        """The closest name: slips, number of the form (of those without slips), slips with accents, identifier."""
        best: tuple[int, int, int, str] | None = None
        typed = accented(text)
        for n, form in enumerate(core(text, self.keys)):
            words = form.split()
            for k in self.exact[form] if form in self.exact else self._ranked(form, words, repaired):
                d = self._slips(form, words, k)
                if d <= SLIPS:
                    i, _, own = self.names[k]
                    got = (d, 0 if d else n, distance(accented_form(typed, form), own, 12), i)
                    best = got if best is None else min(best, got)
            if best is not None and best[0] == 0:
                break
        return best


_INDEXES: dict[str, dict[str, NameIndex]] = {}


def _indexes(names: Broadcast) -> dict[str, NameIndex]:
    """The index of each type, made once by a worker."""
    key, by = names.value
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = {t: NameIndex(by[o]) for t, o in ONTOLOGY.items()}
    return _INDEXES[key]


def accented_form(typed: str, form: str) -> str:
    """The part of the accented text that a form without accents came from."""
    at = "".join(map(_letter, typed)).find(form)
    return typed[at : at + len(form)] if at >= 0 else typed


def _repairs(tokens: DataFrame, by: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``token, near``: for each distinct token, the other words of the vocabulary within two slips."""
    spark = tokens.sparkSession
    words = {w for names in by.values() for _, n in names for p in (squeeze(plain(n)),) for w in (*p.split(), p.replace(" ", ""))}
    listed = spark.createDataFrame(pd.DataFrame([(k, w) for w in sorted(words) for k in sorted(listed_keys(w))], columns=["key", "word"]), "key string, word string")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t) for t in pdf["token"] for k in typed_keys(t)]
            yield pd.DataFrame(rows, columns=["key", "token"])

    typed = tokens.mapInPandas(keys, "key string, token string")
    pairs = typed.join(listed, "key").where("token <> word").select("token", "word").distinct()

    @F.pandas_udf("int")
    def slips(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, SLIPS) for x, y in zip(a, b)], dtype="int32")

    near = pairs.withColumn("d", slips("token", "word")).where(F.col("d") <= SLIPS)
    return near.groupBy("token").agg(F.collect_list(F.struct("word", "d")).alias("near"))


def cases(spans: DataFrame) -> DataFrame:
    """``span_id, text, type`` of each coded entity without codes, as last delivered."""
    coded = spans.where(F.col("span_id").isNotNull() & F.col("type").isin(*ONTOLOGY) & F.col("text").isNotNull())
    coded = coded.where(F.col("candidates").isNull() | (F.size("candidates") == 0))
    order = F.struct("ingested_at", "extracted_at", "text", "type") if "ingested_at" in spans.columns else F.struct("text", "type")
    return coded.groupBy("span_id").agg(F.max_by(F.struct("text", "type"), order).alias("x")).select(F.col("span_id").cast("bigint"), "x.text", "x.type")


def _closest(texts: DataFrame, by: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``text, type, found`` of texts that a name of the block fits; ``found`` is the smaller the closer."""
    names = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, by))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index = _indexes(names)
            rows = []
            for text, kind in zip(pdf["text"], pdf["type"]):
                forms = core(text, index[kind].keys)
                if any(f in index[kind].exact for f in forms):
                    continue
                rows += [(text, kind, t) for t in sorted({t for f in forms for t in (*f.split(), f.replace(" ", ""))})]
            yield pd.DataFrame(rows, columns=["text", "type", "token"])

    each = texts.mapInPandas(split, "text string, type string, token string")
    near = _repairs(each.select("token").distinct(), by)
    found = each.join(near, "token").groupBy("text", "type").agg(F.collect_list(F.struct("token", "near")).alias("repaired"))
    ready = texts.join(found, ["text", "type"], "left")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index = _indexes(names)
            rows = []
            for text, kind, got in zip(pdf["text"], pdf["type"], pdf["repaired"]):
                repaired = {} if got is None else {r["token"]: [(x["word"], x["d"]) for x in r["near"]] for r in got}
                if x := index[kind].find(text, repaired):
                    rows.append((text, kind, dict(zip(("slips", "form", "accents", "identifier"), x))))
            yield pd.DataFrame(rows, columns=["text", "type", "found"])

    return ready.mapInPandas(rank, "text string, type string, found struct<slips:int,form:int,accents:int,identifier:string>")


def link(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """``span_id, identifier`` of each coded entity without codes, UNMATCHED where no name fits."""
    own = cases(spans)
    texts = own.select("text", "type").distinct()
    blocks = [_closest(texts, by) for by in _blocks(nodes)]
    found = blocks[0]
    if len(blocks) > 1:
        found = reduce(DataFrame.unionByName, blocks).groupBy("text", "type").agg(F.min("found").alias("found"))
    return own.join(found, ["text", "type"], "left").select("span_id", F.coalesce("found.identifier", F.lit("UNMATCHED")).alias("identifier"))


def unmatched(linked: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts that no listed name fits, as last delivered, with how many entities have them."""
    return linked.where("identifier = 'UNMATCHED'").join(cases(spans), "span_id").groupBy("text").agg(F.count("*").alias("entities"))

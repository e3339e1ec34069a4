"""Problem 1: visually identical text with different characters.

Each text is cut at blanks. A token, and what is left of it without signs at its ends, is
walked through a trie of the words of the reference names by a weighted edit automaton.
Characters of one shape and ignorable ones cost nothing, characters of nearly one shape
``NEARLY``, and every other slip 1; a walk may cost ``most`` in all. Where words are reached, the
spelling of the cheapest is taken, so the list decides between shapes that stand for several
letters (a Cyrillic capital I for I or l) and keeps what it spells in another script
(TNF-α). Tokens that reach no word are normalised by a table of shapes.

Texts are held alike only at no cost, which is the default: case, tone and vowel marks,
raised and lowered digits, fractions, punctuation and whether there is a blank show; width,
invisible characters, kind of blank or hyphen, how accents are composed and the script
a letter shape is taken from don't. Runs of blanks count as one; blanks at the ends go.
The form is idempotent. A null text stays null and an empty one empty.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts, then the Latin letters of the same shape.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХҮԌԚԜ": "ABESIJKMHOPCTYXYGQW",
    "аеѕіјорсухһԁԛԝү": "aesijopcyxhdqwy",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αινορ": "aivop",
    "ÐƉ": "ĐĐ",
    "ıɡɑ": "iga",
    "µ": "μ",
}
# Characters without a shape of their own.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
# Shapes that stand for several letters, the usual one first.
SEVERAL = {"І": "Il", "Ӏ": "Il", "Ι": "Il", "ӏ": "lI", "ǀ": "lI", "υ": "uv"}
#: Letters and signs of nearly one shape.
NEAR_SHAPES = ("Il1|", "O0", "S5", "B8", "Z2", "uv")
NEARLY = 0.4
HYPHENS = "‐‑‒–−­﹣－⁃"
_VOWEL_MARKS = "̛̂̆"
#: Words of the reference names that a worker holds; it is checked.
MOST_WORDS = 2_000_000


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for a, b in LOOKALIKES.items():
        for x, y in zip(a, b, strict=True):
            table[ord(x)] = y
    for c in range(0xFF01, 0xFF5F):
        table[c] = chr(c - 0xFEE0)
    for c in range(0x0009, 0x3001):
        if chr(c).isspace():
            table[c] = " "
    table[0x2800] = table[0x3164] = " "
    for c in HYPHENS:
        table[ord(c)] = "-"
    for c in IGNORABLE:
        table[ord(c)] = None
    return table


TABLE = _table()


def _marks(s: str) -> str:
    """NFD with the marks of a letter in one order: below, then those of the vowel, then tones."""
    s = unicodedata.normalize("NFD", s)
    if s.isascii():
        return s
    out, marks = [], []
    for c in s:
        if unicodedata.combining(c):
            marks.append(c)
            continue
        if marks:
            out += sorted(marks, key=lambda m: (unicodedata.combining(m) != 216, m not in _VOWEL_MARKS, unicodedata.combining(m)))
            marks = []
        out.append(c)
    out += sorted(marks, key=lambda m: (unicodedata.combining(m) != 216, m not in _VOWEL_MARKS, unicodedata.combining(m)))
    return "".join(out)


def by_table(s: str) -> str:
    """The form of a text by the table alone."""
    if s.isascii():
        return " ".join(s.split())
    # a letter with its accent is taken apart before its base is looked up
    s = _marks(s.translate(TABLE)).translate(TABLE)
    return " ".join(unicodedata.normalize("NFC", s).split())


def _shapes(c: str) -> str:
    """What a decomposed character may show; empty if it shows nothing."""
    if c in SEVERAL:
        return SEVERAL[c]
    to = TABLE.get(ord(c), c)
    return "" if to is None else to


class Trie:
    """Canonical spellings over decomposed characters. Of words that look the same the first in order is the spelling of all."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        #: Plain forms of words that the table would spell otherwise.
        self.named: dict[str, str] = {}
        spelled: dict[str, str] = {}
        for w in sorted(set(words), key=lambda w: (by_table(w) != w, w)):
            form = by_table(w)
            if not form or " " in form:
                continue
            own = spelled.setdefault(form, unicodedata.normalize("NFC", w))
            if own != form:
                self.named[form] = own
            node = self.root
            for c in _marks(form):
                node = node.setdefault(c, {})
            node[""] = own

    def walk(self, token: str, most: float = 0.0) -> str | None:
        """The word that the token shows at the least cost of at most ``most``; of several the one the table would give, then the first."""
        states: dict[int, tuple[float, dict]] = {id(self.root): (0.0, self.root)}

        def reach(to: dict[int, tuple[float, dict]], node: dict, cost: float) -> None:
            if cost <= most and (id(node) not in to or cost < to[id(node)][0]):
                to[id(node)] = (cost, node)

        def skip(to: dict[int, tuple[float, dict]]) -> dict[int, tuple[float, dict]]:
            """States after letters of the word that the token leaves out."""
            open_ = list(to.values()) if most >= 1 else []
            while open_:
                cost, node = open_.pop()
                for c, after in node.items():
                    if c and cost + 1 <= most and (id(after) not in to or cost + 1 < to[id(after)][0]):
                        to[id(after)] = (cost + 1, after)
                        open_.append(to[id(after)])
            return to

        states = skip(states)
        for c in _marks(token):
            shapes = [unicodedata.normalize("NFD", x) for x in _shapes(c)]
            if not shapes:  # an ignorable: every state stays
                continue
            step: dict[int, tuple[float, dict]] = {}
            for cost, node in states.values():
                for shape in shapes:
                    at = node
                    for x in shape:
                        at = at.get(x) if at is not None else None
                    if at is not None:
                        reach(step, at, cost)
                if cost + NEARLY <= most:
                    for x, after in node.items():
                        if x:
                            near = any(x in g and any(y in g for y in shapes) for g in NEAR_SHAPES)
                            reach(step, after, cost + (NEARLY if near else 1))
                    reach(step, node, cost + 1)  # a letter too many
            states = skip(step)
            if not states:
                return None
        ends = [(cost, n[""]) for cost, n in states.values() if "" in n]
        return min(ends, key=lambda e: (e[0], by_table(e[1]) != by_table(token), e[1]))[1] if ends else None


@lru_cache(maxsize=4)
def _trie(words: tuple[str, ...]) -> Trie:
    return Trie(list(words))


def _token(token: str, trie: Trie, most: float) -> str:
    """A token's spelling by the list, with or without the signs at its ends, else by the table."""
    got = trie.walk(token, most)
    if got is None and (inner := token.strip(_SIGNS)) and inner != token:
        got = trie.walk(inner, most)
        if got is not None:
            at = token.index(inner)
            return by_table(token[:at]) + got + by_table(token[at + len(inner) :])
    return by_table(token) if got is None else got


def canonical(text: str, trie: Trie, memo: dict[str, str], most: float = 0.0) -> str:
    """The consistent form of one text."""
    if text.isascii() and not most and not trie.named:
        return " ".join(text.split())
    out = []
    # blanks of every kind first, so that tokens are what shows as tokens
    for token in text.translate(_BLANKS).split():
        got = memo.get(token)
        if got is None:
            got = _token(token, trie, most)
            if len(memo) < 500_000:
                memo[token] = got
        if got:
            out.append(got)
    return " ".join(out)


_BLANKS = {c: " " for c, to in TABLE.items() if to == " "}
_SIGNS = string.punctuation + "".join(chr(c) for c, to in TABLE.items() if to is None or to in string.punctuation)


def canonical_form(words: tuple[str, ...] = ()):
    """A function of a text column; ``words`` are the canonical spellings (a bounded reference list)."""

    @F.pandas_udf(StringType())
    def form(texts: pd.Series) -> pd.Series:
        trie, memo = _trie(words), {}
        return texts.map(lambda t: None if t is None else canonical(t, trie, memo))

    return form


def vocabulary(nodes: DataFrame) -> tuple[str, ...]:
    """Distinct words of the concept names; a reference list of fixed size, and that is checked against MOST_WORDS."""
    names = nodes.select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    words = names.where("name is not null").select(F.explode(F.split("name", r"\s+")).alias("w")).distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"the reference names have over {MOST_WORDS} words; raise MOST_WORDS if workers can hold them")
    return tuple(sorted(r.w for r in words if r.w))


def normalise(df: DataFrame, column: str, words: tuple[str, ...] = (), to: str = "canonical_text") -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``to``."""
    return df.withColumn(to, canonical_form(words)(F.col(column)))


def same_looking(spans: DataFrame, raws: DataFrame, nodes: DataFrame) -> DataFrame:
    """``span_id, raw_id`` of one record whose texts look the same and differ; each pair once.

    Null texts and records pair with nothing. Equal strings are no case, but a pair
    counts if any delivery of the span or any copy of the raw row differs.
    """
    words = vocabulary(nodes)
    form = canonical_form(words)
    # spans go to Python as they are, without a shuffle; raw rows that were sent again become one
    a = spans.where("text is not null and record_id is not null").select("record_id", "span_id", "text").withColumn("form", form("text"))
    b = raws.where("raw is not null and record_id is not null").select("record_id", "raw_id", "raw").distinct().withColumn("form", form("raw"))
    # texts of a record are spread by their form, so a record with many rows is no hot key
    pairs = a.join(b, ["record_id", "form"]).where("text <> raw")
    return pairs.select(F.col("span_id").cast("bigint"), F.col("raw_id").cast("bigint")).distinct()


def same_text(a: Column, b: Column, words: tuple[str, ...] = ()) -> Column:
    """Whether two text columns look the same."""
    form = canonical_form(words)
    return form(a) == form(b)

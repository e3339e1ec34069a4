"""Column builders over texts, offsets and codes. Offsets are code points, half-open.

Unless said otherwise a null argument gives null, and an empty text an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

LINE_END = "\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without blanks, tabs, returns and form feeds at either end."""
    return F.regexp_replace(_col(c), r"^[ \t\r\f]+|[ \t\r\f]+$", "")


def fold_key(s: str) -> str:
    """Compatibility form, case folded, marks dropped, runs of white space made one blank."""
    d = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s).casefold())
    return " ".join("".join(c for c in d if unicodedata.category(c) != "Mn").split())


def normalize_key(c: Column | str) -> Column:
    """``fold_key`` of a column; Spark has no built-in for it, so Arrow batches go to Python."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_key(t))

    return run(_col(c))


@lru_cache(maxsize=100_000)
def _fold_character(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).casefold()) if unicodedata.category(x) != "Mn")


def fold_with_map(s: str) -> tuple[str, list[int]]:
    """Folded characters, and for each the place in the source that it came from."""
    if s.isascii():
        return s.lower(), list(range(len(s)))
    out = list(map(_fold_character, s))
    if all(len(x) == 1 for x in out):
        return "".join(out), list(range(len(s)))
    return "".join(out), [i for i, x in enumerate(out) for _ in x]


def normalize_with_map(c: Column | str) -> Column:
    """Struct of the folded ``value`` and ``norm_to_raw``, the source place of each of its characters."""
    kind = StructType([StructField("value", StringType()), StructField("norm_to_raw", ArrayType(IntegerType()))])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else fold_with_map(t) for t in texts]
        return pd.DataFrame(rows, columns=["value", "norm_to_raw"])

    return run(_col(c))


def raw_span(norm_to_raw: Column | str, start: Column | str, end: Column | str) -> Column:
    """Source span of a span of the folded text, clamped to it; null for an empty map."""
    m, a, b = _col(norm_to_raw), _col(start), _col(end)
    n = F.size(m)
    first = F.get(m, F.greatest(F.lit(0), F.least(a, n - 1)))
    last = F.get(m, F.greatest(F.lit(0), F.least(b, n) - 1)) + 1
    return F.when(n > 0, F.struct(first.alias("start"), last.alias("end")))


def phrase_key(c: Column | str) -> Column:
    """Lower case, one blank between words; accents stay."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[ \t\r\n\f]+", " "))


def words(c: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(_col(c), r"[ \t\r\n\f]+"), lambda w: w != "")


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, and single other characters but white space; a combining mark is one of these."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x85])"), F.lit(1))


def crlf_offset(text: Column | str, offset: Column | str) -> Column:
    """Offset in the text if its line ends were two characters."""
    before = F.substring(_col(text), F.lit(1), _col(offset))
    return _col(offset) + F.length(before) - F.length(F.replace(before, F.lit(LINE_END), F.lit("")))


def pieces_with_offsets(parts: Column, gap: int) -> Column:
    """Array of (piece, start, end) of parts that stand ``gap`` characters apart, in one pass over the parts."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<piece:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        piece = F.struct(p.alias("piece"), acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + gap).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


def context(text: Column | str, start: Column | str, end: Column | str, width: int) -> Column:
    """``width`` characters on either side, the span between marks."""
    t, a, b = _col(text), _col(start), _col(end)
    left = F.substring(t, F.greatest(a - width, F.lit(0)) + 1, F.least(a, F.lit(width)))
    return F.concat(left, F.lit("⟦"), F.substring(t, a + 1, b - a), F.lit("⟧"), F.substring(t, b + 1, F.lit(width)))


def hash_int(*parts: Column | str) -> Column:
    """32 bits of a SHA-256 over the parts joined by colons; the same in any partitioning."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *map(_col, parts)), 256), 1, 8), 16, 10).cast("bigint")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays taken as sets: 1 if both are empty; a null array counts as empty."""
    x, y = F.coalesce(_col(a), F.array()), F.coalesce(_col(b), F.array())
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def ordered_union(a: Column | str, b: Column | str) -> Column:
    """Values of ``a`` in their order, then those of ``b`` that ``a`` lacks, each once; a null array counts as empty, null values are out."""
    x, y = (F.coalesce(_col(c), F.array().cast("array<string>")) for c in (a, b))
    return F.array_compact(F.array_distinct(F.concat(x, y)))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length of what the spans [a, b) and [c, d) share."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0))


def overlap_ratio(a: Column, b: Column, c: Column, d: Column, of: str = "shorter") -> Column:
    """Overlap over the length of the ``shorter`` or ``longer`` span; 0 for an empty denominator."""
    pick = {"shorter": F.least, "longer": F.greatest}[of]
    n = pick(b - a, d - c)
    return F.when(n > 0, overlap(a, b, c, d) / n).otherwise(F.lit(0.0))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words, row by row of the table, without leaving the JVM."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(last: Column, x: Column) -> Column:
        start = F.struct((last[0] + 1).alias("left"), F.array(last[0] + 1).alias("row"))

        def cell(acc: Column, j: Column) -> Column:
            cost = F.when(F.element_at(b, j) == x, 0).otherwise(1)
            d = F.least(F.element_at(last, j + 1) + 1, acc["left"] + 1, F.element_at(last, j) + cost)
            return F.struct(d.alias("left"), F.array_append(acc["row"], d).alias("row"))

        done = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, cell, lambda acc: acc["row"])
        return F.when(F.size(b) == 0, F.array(last[0] + 1)).otherwise(done)

    return F.aggregate(a, first, row, lambda r: F.element_at(r, -1))


def word_error_rate(a: Column | str, b: Column | str) -> Column:
    """Edit distance of the tokens of ``b`` from those of ``a`` over the tokens of ``a``; of an empty ``a`` 0 or, if ``b`` has some, 1. Null counts as empty."""
    x, y = tokens(F.coalesce(_col(a), F.lit(""))), tokens(F.coalesce(_col(b), F.lit("")))
    return F.when(F.size(x) > 0, word_distance(x, y) / F.size(x)).otherwise(F.when(F.size(y) == 0, 0.0).otherwise(1.0))


def compact_code(c: Column | str) -> Column:
    """Capital letters and digits only: K21.9 as K219."""
    return F.regexp_replace(F.upper(_col(c)), "[^A-Z0-9]", "")


def display_code(c: Column | str) -> Column:
    """K219 as K21.9."""
    k = compact_code(c)
    return F.when(F.length(k) > 3, F.concat(F.substring(k, 1, 3), F.lit("."), F.substring(k, 4, 100))).otherwise(k)


def parent_code(c: Column | str) -> Column:
    """The textual parent: the first three characters, where the code is finer."""
    return F.when(F.length(_col(c)) > 3, F.substring(_col(c), 1, 3))


def strength(c: Column | str) -> Column:
    """The first dose of a folded mention as "number unit": decimals with a point, a range as written, no trailing zeros; empty if there is none."""
    found = F.regexp_substr(_col(c), F.lit(r"\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?\s*(?:mcg|mg|ml|g)(?![\p{L}\p{N}_])"))
    return F.coalesce(_dose(found), F.lit(""))


def _dose(found: Column) -> Column:
    number = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(found, "(mg|mcg|ml|g)$", "")), ",", "."), r"\.0+(?=\s|$)", "")
    return F.concat_ws(" ", number, F.regexp_extract(found, "(mg|mcg|ml|g)$", 1))


def route(c: Column | str) -> Column:
    """``injection`` or ``oral`` where a folded context says so, else empty; an injection first."""
    words = F.concat(F.lit(" "), F.regexp_replace(_col(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    inject = words.rlike(" iv | (tiem|inject)|tinh mach")
    oral = words.rlike(" po | uong|oral")
    return F.when(inject, "injection").when(oral, "oral").otherwise("")


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the word edit distance over the words of ``a`` (it can be negative); of two empty texts 1, of an empty ``a`` alone 0."""
    x, y = words(F.coalesce(_col(a), F.lit(""))), words(F.coalesce(_col(b), F.lit("")))
    return F.when(F.size(x) > 0, 1 - word_distance(x, y) / F.size(x)).otherwise(F.when(F.size(y) == 0, 1.0).otherwise(0.0))


def block_ratio(a: Column | str, b: Column | str) -> Column:
    """Share of characters in the longest common blocks of two texts (Ratcliff and Obershelp); null if one is null."""
    from difflib import SequenceMatcher

    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return run(_col(a), _col(b))


def whole_words(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Struct of the span widened to the words that it cuts and without signs and blanks at its edges; null if nothing is left or it isn't in the text.

    Only what stands next to the span on its line is looked at.
    """
    t, a, b = _col(text), _col(start), _col(end)
    letter = r"[\p{L}\p{N}]"
    seed = F.substring(t, a + 1, b - a)
    left, right = F.substring_index(F.substring(t, F.lit(1), a), LINE_END, -1), F.substring_index(F.substring(t, b + 1, F.length(t)), LINE_END, 1)
    more = F.when(seed.rlike(f"^{letter}"), F.length(F.regexp_extract(left, f"{letter}*$", 0))).otherwise(0)
    after = F.when(seed.rlike(f"{letter}$"), F.length(F.regexp_extract(right, f"^{letter}*", 0))).otherwise(0)
    first = F.when(more > 0, a - more).otherwise(a + F.length(F.regexp_extract(seed, rf"^[^\p{{L}}\p{{N}}]*", 0)))
    last = F.when(after > 0, b + after).otherwise(b - F.length(F.regexp_extract(seed, rf"[^\p{{L}}\p{{N}}]*$", 0)))
    inside = (a >= 0) & (a < b) & (b <= F.length(t)) & (first < last)
    return F.when(inside, F.struct(first.cast("int").alias("start"), last.cast("int").alias("end")))

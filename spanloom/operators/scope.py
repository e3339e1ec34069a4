"""What the context says about a mention: negation, relatives, history.

A context is first brought to words: small letters, signs that part words as words of
their own, one blank between words and at both ends. Cues are then phrases at the end, at
the start or anywhere in it. All of it is built-in expressions over the text before and after
a mention; a text is carried to its mentions once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import pieces_with_offsets

# The cues, as plain phrases.
NO = ["không", "không có", "không còn", "không bị", "không mắc", "không ghi nhận", "chưa", "chưa ghi nhận", "phủ nhận", "âm tính"]
NO_WITHIN = ["không", "không có", "không còn", "không bị", "không mắc", "chưa", "phủ nhận"]
NOT_NO = ["không xác định", "không đặc hiệu", "không do", "không biệt định"]
TURNS = ["nhưng", "tuy nhiên", "song", "mặc dù"]
RELATIVES = ["mẹ", "bố", "cha", "mẹ bệnh nhân", "bố bệnh nhân", "cha bệnh nhân", "anh trai", "chị gái", "em trai", "em gái"]
RELATIVE_HAS = ["đã", "có", "bị", "mắc"]
OF_FAMILY = ["tiền sử gia đình", "bệnh sử gia đình"]
TOLD = ["theo lời người nhà", "theo lời gia đình", *(f"{who} {what}" for who in ("người nhà", "gia đình") for what in ("nhận thấy", "cho biết", "kể"))]
PAST = ["tiền sử", "trước khi nhập viện", "trước nhập viện", "đã từng", "đã điều trị trước đây", "lịch sử sử dụng", "các bệnh lý mạn tính", "các bệnh lý mãn tính", "các bệnh đã điều trị"]
NOW = ["tiền sử bệnh hiện tại", "bệnh sử hiện tại"]

#: Code points that a cue may stand before a mention: of negation, of a relative, of history (of coded types), and how far what is now reaches.
NO_REACH, RELATIVE_REACH, PAST_REACH, NOW_REACH = 70, 80, 90, 300


def in_words(c: Column) -> Column:
    """Small letters, signs apart, one blank between words and at both ends; several blanks or line ends are one."""
    apart = F.regexp_replace(F.lower(c), r"([,:;.(\-])", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, r"[ \t\r\n\f]+", " ")), F.lit(" "))


def _any(phrases: list[str]) -> str:
    return "(" + "|".join(phrases) + ")"


def _holds(c: Column, phrases: list[str]) -> Column:
    return c.rlike(_any(phrases))


def negated(line_before: Column, mention: Column) -> Column:
    """A cue ends right before the mention, after the last sign or word that turns the sentence; or the mention begins with one.

    A mention that begins with a qualifier ("không do chấn thương") isn't negated by it. A sign right before the mention parts it from the cue.
    """
    near = in_words(F.right(line_before, F.lit(NO_REACH)))
    near = F.regexp_replace(near, rf"^.* ([.;]|{'|'.join(TURNS)}) ", " ")
    own = F.regexp_replace(in_words(mention), f" {_any(NOT_NO)} ", " ")
    # the mention stands apart from what is before it by a blank
    return (near.rlike(f" {_any(NO)} $") & line_before.rlike(r"[ \t\r\n\f]$")) | own.rlike(f"^ {_any(NO_WITHIN)} ")


def of_family(line_before: Column) -> Column:
    """The mention is a relative's: under a family heading on the line, or right after a relative; not what relatives told."""
    words = in_words(line_before)
    near = in_words(F.right(line_before, F.lit(RELATIVE_REACH)))
    return _holds(words, OF_FAMILY) | (~_holds(words, TOLD) & near.rlike(f" {_any(RELATIVES)}( {_any(RELATIVE_HAS)})? $"))


def _past_heading(line: Column) -> Column:
    """Whether a numbered heading is number 1, of history and not of what is now."""
    heading = F.lower(F.regexp_extract(line, _NUMBERED, 2))
    return F.regexp_extract(line, _NUMBERED, 1).rlike("^0*1$") & heading.contains("tiền sử") & ~heading.contains("hiện tại")


_NUMBERED = r"^[ \t\r\f]*(\d+)\.[ \t]*(.*)$"


def headings(text: Column) -> Column:
    """Of a text its numbered lines: where each begins and whether it is a heading of history."""
    numbered = F.filter(pieces_with_offsets(F.split(text, "\n", -1), 1), lambda x: x["piece"].rlike(r"^[ \t\r\f]*\d+\."))
    return F.transform(numbered, lambda x: F.struct(x["start"].alias("at"), _past_heading(x["piece"]).alias("past")))


def under_past_heading(marks: Column, start: Column, line_before: Column) -> Column:
    """The last numbered line up to the mention is a heading of history; of the mention's own line what stands before it."""
    line = start - F.length(line_before)
    last = F.get(F.filter(marks, lambda x: x["at"] < line), F.size(F.filter(marks, lambda x: x["at"] < line)) - 1)
    above = F.coalesce(last["past"], F.lit(False))
    return F.when(line_before.rlike(r"^[ \t\r\f]*\d+\."), _past_heading(line_before)).otherwise(above)


def historical(near: Column, line_before: Column, line_after: Column, mention: Column, section: Column, coded: Column, symptom: Column) -> Column:
    """A cue of history in the sentence; for coded types also on the line or shortly before; or a heading of history.

    What is said to be now takes it back. A symptom that something was taken for ("điều trị ...") isn't historical by it. ``near`` is what stands before.
    """
    low, left, right, own = F.lower(near), F.lower(line_before), F.lower(line_after), F.lower(mention)
    sentence = F.concat(F.regexp_replace(left, r"^.*[.!?;]", ""), own, F.regexp_extract(right, r"^[^.!?;]*", 0))
    line = F.concat(left, own, right)
    now_near = _holds(line, NOW)
    for phrase in NOW:
        now_near = now_near | F.right(low, F.lit(NOW_REACH + len(phrase))).contains(phrase)
    past = _holds(sentence, PAST) & ~_holds(sentence, NOW)
    past = F.when(coded, (past | _holds(line, PAST) | _holds(F.right(low, F.lit(PAST_REACH)), PAST)) & ~now_near).otherwise(past)
    taken_for = F.regexp_like(sentence, F.concat(F.lit(r"điều trị\s+[^.]{0,50}\Q"), F.replace(own, F.lit("\\E"), F.lit("")), F.lit(r"\E")))
    return (past | section) & ~(symptom & taken_for)


def assertions(spans: DataFrame, docs: DataFrame, types: tuple[str, ...], coded: tuple[str, ...] = (), symptom: str = "") -> DataFrame:
    """``record_id, start, end, type`` of distinct spans with ``isHistorical, isFamily, isNegated`` where the context says so, in this order.

    Types not in ``types`` have none. Spans without complete positions in a text are out. Headings are found once a text; a mention takes its line and
    what stands shortly before it, so that no rule reads the whole text again.
    """
    s = spans.dropna(subset=["record_id", "start", "end", "type"]).select(F.col("record_id").alias("doc_id"), "start", "end", "type").distinct()
    d = docs.where("doc_id is not null and text is not null").select("doc_id", "text", headings(F.col("text")).alias("marks"))
    j = s.join(d, "doc_id").where((F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("start") < F.col("end")))
    none = F.array().cast("array<string>")
    before, mention = F.substring("text", F.lit(1), F.col("start")), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    after = F.substring("text", F.col("end") + 1, F.length("text"))
    reach = NOW_REACH + max(map(len, NOW))
    # cut to what the rules need, and kept apart from them, lest each rule cuts again
    j = j.select(
        "doc_id", "start", "end", "type", "marks", mention.alias("mention"), F.substring_index(before, "\n", -1).alias("left"), F.substring_index(after, "\n", 1).alias("right"),
        F.substring("text", F.greatest(F.col("start") - reach, F.lit(0)) + 1, F.least(F.col("start"), F.lit(reach))).alias("near"), F.rand(1).alias("_apart"),
    ).where("_apart >= 0")
    left, mention = F.col("left"), F.col("mention")
    section = under_past_heading(F.col("marks"), F.col("start"), left)
    past = historical(F.col("near"), left, F.col("right"), mention, section, F.col("type").isin(*coded) if coded else F.lit(False), F.col("type") == symptom)
    found = F.array_compact(F.array(F.when(past, "isHistorical"), F.when(of_family(left), "isFamily"), F.when(negated(left, mention), "isNegated")))
    out = j.select("doc_id", "start", "end", "type", F.when(F.col("type").isin(*types), found).otherwise(none).alias("assertions"))
    return out.withColumnRenamed("doc_id", "record_id")

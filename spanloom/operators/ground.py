"""From words to places: grounding of mentions, token labels and back, near-equal spans.

Offsets are code points of the stored text. Null texts, mentions without a type or a letter
and incomplete spans take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import places as P
from spanloom.functions.text import fold_key, fold_with_map, pieces_with_offsets
from spanloom.operators.spans import KEY, keys, overlapping

#: Plain mentions of so few letters must stand as they are, case aside.
SHORT = 3


def occurrences(text: str, mention: str) -> list[tuple[int, int]]:
    """All places of a mention in a text: with its own letters, case aside; else folded, with any white space between words."""
    mention = mention.strip()
    if not mention:
        return []
    found = [m.span() for m in re.finditer(re.escape(mention), text, re.IGNORECASE)]
    if found or (mention.isascii() and len(mention) <= SHORT):
        return found
    words = fold_key(mention).split()
    if not words:
        return []
    plain, places = fold_with_map(text)
    return [(places[m.start()], places[m.end() - 1] + 1) for m in re.finditer(r"\s+".join(map(re.escape, words)), plain)]


def ground(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """``record_id, type, mention, start, end, text``: every place of each mention ``record_id, text, type``; repeated mentions (case aside) count once.

    A mention that stands nowhere gives no row.
    """
    m = mentions.dropna(subset=["record_id", "text", "type"]).groupBy("record_id", "type", F.lower(F.trim("text")).alias("_k")).agg(F.min(F.trim("text")).alias("mention")).where("_k <> ''")
    per = m.groupBy("record_id").agg(F.collect_list(F.struct("type", "mention")).alias("wanted"))
    j = docs.where("text is not null").select(F.col("doc_id").alias("record_id"), "text").join(per, "record_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for record, text, wanted in pdf[["record_id", "text", "wanted"]].itertuples(index=False):
                places: dict[str, list[tuple[int, int]]] = {}
                for w in wanted:
                    if w["mention"] not in places:
                        places[w["mention"]] = occurrences(text, w["mention"])
                    rows += [(record, w["type"], w["mention"], a, b, text[a:b]) for a, b in places[w["mention"]]]
            yield pd.DataFrame(rows, columns=["record_id", "type", "mention", "start", "end", "text"])

    return j.mapInPandas(run, "record_id bigint, type string, mention string, start int, `end` int, text string")


def word_tokens(docs: DataFrame) -> DataFrame:
    """``record_id, start, end`` of the words between white space."""
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("record_id"), F.explode(pieces_with_offsets(F.split("text", "[ \t\r\n\f]", -1), 1)).alias("x"))
    return d.where("x.piece <> ''").select("record_id", "x.start", "x.end")


def bio_labels(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Each token with ``B-`` or ``I-`` and the type of the shortest entity that meets it (then the earlier, then the type in order), else ``O``.

    A token goes on with an entity if the token before it in the record has the same.
    """
    t = tokens.dropna().distinct().withColumn("type", F.lit(""))
    hit = overlapping(t, entities).groupBy("record_id", F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(
        F.min(F.struct((F.col("r_end") - F.col("r_start")).alias("n"), F.col("r_start").alias("s"), F.col("r_type").alias("type"))).alias("e")
    )
    j = t.drop("type").join(hit, ["record_id", "start", "end"], "left")
    before = F.lag("e").over(Window.partitionBy("record_id").orderBy("start", "end"))
    label = F.when(F.col("e").isNull(), F.lit("O")).otherwise(F.concat(F.when(before == F.col("e"), F.lit("I-")).otherwise(F.lit("B-")), F.col("e.type")))
    return j.select("record_id", "start", "end", label.alias("label"))


def bio_decode(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """``record_id, start, end, type, confidence`` from ``record_id, start, end, label, p``, several of them per token where windows overlap.

    Probabilities are averaged per token and label; the greatest counts (the lesser label on ties). ``B-`` begins an entity, ``I-``
    goes on with one of its type that the token before it is of, unless a line or a sentence ends between them, and begins one elsewhere;
    the confidence is the mean of its tokens.
    """
    mean = scores.dropna().groupBy("record_id", "start", "end", "label").agg(F.avg("p").alias("p"))
    best = mean.groupBy("record_id", "start", "end").agg(F.min(F.struct((-F.col("p")).alias("n"), "label")).alias("x")).select("record_id", "start", "end", "x.label", (-F.col("x.n")).alias("p"))
    kind = F.when(F.col("label") != "O", F.substring("label", 3, 200))
    w = Window.partitionBy("record_id").orderBy("start", "end")
    tagged = best.withColumn("type", kind).withColumn("last", F.lag("end").over(w))
    tagged = tagged.withColumn("fresh", (F.col("label").startswith("B-") | ~F.lag("type").over(w).eqNullSafe(F.col("type"))).cast("int"))
    # the text is looked at only where a token would go on
    texts = docs.where("text is not null").select(F.col("doc_id").alias("record_id"), "text")
    gap = F.substring("text", F.col("last") + 1, F.col("start") - F.col("last"))
    ended = tagged.where("fresh = 0 and type is not null").select("record_id", "start", "end", "last").join(texts, "record_id").where(gap.rlike("[\n.!?;]")).select("record_id", "start", "end", F.lit(1).alias("ended"))
    tagged = tagged.join(ended, ["record_id", "start", "end"], "left").withColumn("fresh", F.greatest("fresh", F.coalesce("ended", F.lit(0))))
    runs = tagged.withColumn("run", F.sum("fresh").over(w)).where("type is not null")
    return runs.groupBy("record_id", "run", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("p"), 6).alias("confidence")).select(*KEY, "confidence")


class _Labelled:
    """Words of some records and the labels that each of ``sources`` gives them, as ``bio_labels`` says.

    Columns of ``batch``: ``texts``, a list per record (mostly of one), and ``spans``, a list of ``start, end, type`` and, if there are ``sources``, ``source``.
    """

    def __init__(self, batch: pa.RecordBatch, sources: tuple[str, ...] = ()):
        many = pc.list_value_length(batch.column("texts")).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(many)), many)
        self.points, self.base, self.size = P.flat(batch.column("texts").flatten().to_pylist())
        begin, end = P.runs(P.among(self.points, " \t\r\n\f"))
        text = np.searchsorted(self.base, begin, side="right") - 1
        # spans once per text of their record, the longest first, then the later, so that those that count more are written over the others
        n = pc.fill_null(pc.list_value_length(batch.column("spans")), 0).to_numpy(zero_copy_only=False)
        spans = batch.column("spans").flatten()
        a, b = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        names = np.array(spans.field("type").to_pylist(), object)
        types = sorted(set(names.tolist()))
        number = {t: i for i, t in enumerate(types)}
        kind = np.fromiter((number[t] for t in names), np.int64, len(names))
        order = np.lexsort((kind, a, b - a))[::-1]
        first = np.cumsum(n) - n
        every, at = P.spread(first[self.owner], n[self.owner]), np.repeat(np.arange(len(self.owner)), n[self.owner])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        turn = np.argsort(place[every], kind="stable")
        every, at = every[turn], at[turn]
        low = np.searchsorted(end, self.base[at] + np.clip(a[every], 0, self.size[at]), side="right")
        high = np.searchsorted(begin, self.base[at] + np.clip(b[every], 0, self.size[at]), side="left")
        meets = np.maximum(high - low, 0)
        own = np.array(spans.field("source").to_pylist(), object)[every] if sources else None
        best = []
        for source in sources or (None,):
            mine = slice(None) if own is None else own == source
            x = np.full(len(begin), -1, np.int64)
            x[P.spread(low[mine], meets[mine])] = np.repeat(every[mine], meets[mine])
            best.append(x)
        self.record, self.start, self.end = self.owner[text], begin - self.base[text], end - self.base[text]
        self.several = bool((many > 1).any())
        if self.several:  # the same place in several texts is one word
            order = np.lexsort((self.end, self.start, self.record))
            key = np.stack((self.record, self.start, self.end))[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            order = order[new]
            self.record, self.start, self.end = self.record[order], self.start[order], self.end[order]
            best = [x[order] for x in best]
        # labels are numbered in their order
        self.names = sorted({"O"} | {f"{x}-{t}" for t in types for x in "BI"})
        code = {x: i for i, x in enumerate(self.names)}
        of = np.array([[code[f"B-{t}"], code[f"I-{t}"]] for t in types] + [[code["O"]] * 2], np.int64)
        of_span = np.append(kind, len(types))
        self.labels = []
        for x in best:
            on = np.zeros(len(x), np.int64)
            on[1:] = x[1:] == x[:-1]
            self.labels.append(of[of_span[x], on])

    def broken(self, i: np.ndarray) -> np.ndarray:
        """Whether a line or a sentence ends between the words before ``i`` and those at ``i``."""
        marks = np.concatenate(([0], np.cumsum(P.among(self.points, "\n.!?;"))))
        a, b, record = self.end[i - 1], self.start[i], self.record[i]
        found = np.zeros(len(i), bool)
        first = np.searchsorted(self.owner, record)
        k = first.copy()
        while True:  # text by text of a record
            live = np.flatnonzero((k < len(self.owner)) & (self.owner[np.minimum(k, len(self.owner) - 1)] == record))
            if not len(live):
                return found
            at = k[live]
            found[live] |= marks[self.base[at] + np.minimum(b[live], self.size[at])] > marks[self.base[at] + np.minimum(a[live], self.size[at])]
            if not self.several:
                return found
            k += 1


def _per_record(docs: DataFrame, entities: DataFrame, *more: str) -> DataFrame:
    """``record_id``, the distinct ``texts`` of each record and its distinct complete spans."""
    d = docs.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("record_id")).agg(F.collect_set("text").alias("texts"))
    e = entities.select(*KEY, *more).dropna().where("start < `end`")
    return d.join(e.groupBy("record_id").agg(F.collect_set(F.struct("start", "end", "type", *more)).alias("spans")), "record_id", "left")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = np.fromiter((sum(map(len, x)) for x in batch.column("texts").to_pylist()), np.int64, batch.num_rows)
        for a, b in P.slices(chars):
            yield batch.slice(a, b - a)


def text_labels(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """``bio_labels`` of the words of whole texts: a record's spans come to its text, so that no word travels."""
    j = _per_record(docs, entities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _Labelled(batch)
            ids = batch.column("record_id").take(pa.array(x.record))
            label = pa.array(x.names, pa.string()).take(pa.array(x.labels[0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(x.start.astype(np.int32)), pa.array(x.end.astype(np.int32)), label], names=["record_id", "start", "end", "label"])

    return j.mapInArrow(run, f"record_id {j.schema['record_id'].dataType.simpleString()}, start int, `end` int, label string")


def text_decode(docs: DataFrame, entities: DataFrame, sources: tuple[str, ...], outside: float) -> DataFrame:
    """``bio_decode`` of what ``sources`` say of the words of whole texts, each by ``text_labels`` of its own spans with 1, or ``outside`` where it has none.

    The sum of a label over the number of sources is its share; labels that a source doesn't give have no share of it.
    """
    j = _per_record(docs, entities.where(F.col("source").isin(*sources)), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _Labelled(batch, sources)
            out = x.names.index("O")
            weights = [np.where(c == out, outside, 1.0) for c in x.labels]
            p, label = np.full(len(x.start), -1.0), np.zeros(len(x.start), np.int64)
            for c in x.labels:
                sum_ = sum(np.where(o == c, w, 0.0) for o, w in zip(x.labels, weights))
                better = (sum_ > p) | (sum_ == p) & (c < label)
                p, label = np.where(better, sum_, p), np.where(better, c, label)
            begins = np.array([n.startswith("B-") for n in x.names])[label]
            types = sorted({n[2:] for n in x.names if n != "O"})
            kind = np.array([-1 if n == "O" else types.index(n[2:]) for n in x.names])[label]
            fresh = np.ones(len(label), bool)
            fresh[1:] = begins[1:] | (kind[1:] != kind[:-1]) | (x.record[1:] != x.record[:-1])
            i = np.flatnonzero(~fresh & (kind >= 0))
            fresh[i[x.broken(i)]] = True
            # every word between two fresh ones is of one type
            first = np.flatnonzero(fresh)
            if not len(first):
                continue
            n = np.diff(np.append(first, len(label)))
            mean, last = np.add.reduceat(p / len(sources), first) / n, np.maximum.reduceat(x.end, first)
            keep = kind[first] >= 0
            first = first[keep]
            kinds = pa.array(types, pa.string()).take(pa.array(kind[first]))
            cols = [batch.column("record_id").take(pa.array(x.record[first])), pa.array(x.start[first].astype(np.int32)), pa.array(last[keep].astype(np.int32)), kinds, pa.array(mean[keep])]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEY, "confidence"])

    runs = j.mapInArrow(run, f"record_id {j.schema['record_id'].dataType.simpleString()}, start int, `end` int, type string, confidence double")
    return runs.select(*KEY, F.round("confidence", 6).alias("confidence"))


def near_equal(spans: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Distinct ``record_id, start, end, type`` with the greatest ``confidence`` of each group of near-equal ones.

    By start, the longer first, a span meets the kept ones of its type: if they share ``ratio`` of the shorter of both, the more confident stays
    (the one kept before on ties). Folded within islands that no span crosses.
    """
    s = spans.dropna(subset=[*KEY, "confidence"]).where("start < `end`").groupBy(*KEY).agg(F.max("confidence").cast("double").alias("confidence"))
    s = s.select(F.col("record_id").cast("bigint"), "type", F.col("start").cast("int"), F.col("end").cast("int"), "confidence")
    w = Window.partitionBy("record_id", "type").orderBy("start", "end")
    ends = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("island", F.sum(F.when(F.col("start") < ends, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r[2], -r[3])):
            like = next((k for k in kept if min(k[3], r[3]) - max(k[2], r[2]) >= ratio * min(k[3] - k[2], r[3] - r[2])), None)
            if like is None:
                kept.append(r)
            elif r[4] > like[4]:
                kept.remove(like)
                kept.append(r)
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        out: list[tuple] = []
        for _, island in groupby(rows, key=lambda r: (r[0], r[1], r[5])):
            out += fold(list(island))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names, own = s.columns, ["record_id", "type", "island"]
    kind = "record_id bigint, type string, start int, `end` int, confidence double, island bigint"
    return s.repartition(*own).sortWithinPartitions(*own).mapInPandas(run, kind).select(*KEY, "confidence")


def outermost(spans: DataFrame) -> DataFrame:
    """Distinct spans that don't lie strictly inside a span of another type."""
    inside = overlapping(spans, spans).where("l_type <> r_type and r_start <= l_start and l_end <= r_end and r_end - r_start > l_end - l_start")
    return keys(spans).join(inside.select("record_id", *(F.col(f"l_{c}").alias(c) for c in KEY[1:])).distinct(), KEY, "left_anti")

"""Problem 3: long exact spans shared between records.

Super-k-mer partitioning: each window of ``k`` code points belongs to the bucket of its
minimiser (the m-gram of least hash), and consecutive windows with one minimiser travel
as one packed string. Three steps keep the traffic small:

1. light rows (minimiser, record) are aggregated; minimisers of one record only are out,
   as their windows can't occur elsewhere;
2. the packed strings of the others are cut from the texts and equal strings of a bucket
   are joined into one with the least and the greatest record that hold it;
3. in each bucket the windows of the different strings are sorted and counted exactly. A
   bucket with many different strings is no task's burden: its windows are dealt out over
   the cluster by their own text and counted there, as exactly.

Null texts and texts shorter than ``k`` share nothing. Repetition inside one record
doesn't count. Rows with the same doc_id are one record: its runs come out once, if
the rows hold the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import cut

K, M = 150, 64
#: Windows of a packed string at most; a longer run of windows with one minimiser goes as several strings.
PACK_WINDOWS = 512
#: Different packed strings of a bucket that one task sorts; beyond that the windows are dealt out.
BUCKET_STRINGS = 400
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """Hash of each m-gram, m a power of two, by doubling."""
    h, n = codes.astype(np.uint64) * _ODD, 1
    while n < m:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= _ODD
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def super_windows(texts: list[str], k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: number of the text, minimiser, first window and number of windows, for each run of windows."""
    long = [(i, t) for i, t in enumerate(texts) if t and len(t) >= k]
    if not long:
        return (np.zeros(0, np.int64),) * 4
    size = np.fromiter((len(t) for _, t in long), np.int64, len(long))
    codes = np.frombuffer("".join(t for _, t in long).encode("utf-32-le", "surrogatepass"), np.uint32)
    least = sliding_min(gram_hashes(codes, m), k - m + 1)
    n = len(least)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    # windows that lie in one text; a break wherever the minimiser or the text changes
    first = np.ones(n, bool)
    first[1:] = least[1:] != least[:-1]
    first[start[start < n]] = True
    inside = np.zeros(n + 1, np.int64)
    inside[start] += 1
    inside[np.minimum(start + size - k + 1, n)] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    out = start[1:] - k + 1
    first[out[(out > 0) & (out < n)]] = True
    runs = np.flatnonzero(first)
    length = np.diff(np.append(runs, n))
    keep = inside[runs]
    runs, length = runs[keep], length[keep]
    if (length > PACK_WINDOWS).any():
        parts = -(-length // PACK_WINDOWS)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        runs, total = np.repeat(runs, parts) + at * PACK_WINDOWS, np.repeat(length, parts)
        length = np.minimum(total - at * PACK_WINDOWS, PACK_WINDOWS)
    doc = np.searchsorted(start, runs, "right") - 1
    number = np.fromiter((i for i, _ in long), np.int64, len(long))
    return number[doc], least[runs].astype(np.int64), runs - start[doc], length


def _slices(texts: list[str | None], chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _minimisers(docs: DataFrame, k: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in _slices(texts):
                doc, h, _, _ = super_windows(texts[a:b], k, m)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(ids[a:b][doc[new]])], names=["h", "doc_id"])

    return docs.mapInArrow(run, "h bigint, doc_id bigint")


def _packed(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Packed strings of the records, for the minimisers in ``wanted`` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, wanted = (batch.column(c).to_pylist() for c in ("text", "doc_id", "wanted"))
            for a, b in _slices(texts):
                doc, h, start, n = super_windows(texts[a:b], k, m)
                rows: tuple[list, list, list, list] = ([], [], [], [])
                sets = [set(w) for w in wanted[a:b]]
                for i, x, s, w in zip(doc.tolist(), h.tolist(), start.tolist(), n.tolist()):
                    if x in sets[i]:
                        for col, y in zip(rows, (x, ids[a + i], s, texts[a + i][s : s + w + k - 1])):
                            col.append(y)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["h", "doc_id", "at", "packed"])

    return docs.mapInArrow(run, "h bigint, doc_id bigint, at int, packed string")


def _shared_windows(strings: list[tuple[int, int, int, str]], k: int) -> Iterator[tuple[int, int, int]]:
    """Of the different strings (number, least and greatest record, text) of one bucket: windows of two records, as runs."""
    windows = sorted([(p[i : i + k], s, i) for s, (_, _, _, p) in enumerate(strings) for i in range(len(p) - k + 1)])
    shared: dict[int, list[int]] = {}
    at, n = 0, len(windows)
    while at < n:
        end, w = at + 1, windows[at][0]
        while end < n and windows[end][0] == w:
            end += 1
        own = [strings[s] for _, s, _ in windows[at:end]]
        if min(o[1] for o in own) != max(o[2] for o in own):
            for _, s, i in windows[at:end]:
                shared.setdefault(s, []).append(i)
        at = end
    for s, found in shared.items():
        found.sort()
        a = b = found[0]
        for i in found[1:]:
            if i > b + 1:
                yield strings[s][0], a, b
                a = i
            b = i
        yield strings[s][0], a, b


def _count_buckets(strings: DataFrame, k: int) -> DataFrame:
    """Buckets one after the other, as the sorted rows of a partition come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("h", "string", "low", "high", "packed")))

        out: list[tuple[int, int, int, int]] = []
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ["h", "string", "first", "last"]
        for h, bucket in groupby(rows(), key=lambda r: r[0]):
            out += [(h, *x) for x in _shared_windows([r[1:] for r in bucket], k)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return strings.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h bigint, string bigint, first int, last int")


def shared_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``doc_id, span_start, span_end``: maximal runs of code points that lie in a string of ``k`` or more also found in another record."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    long = docs.where(F.length("text") >= k)
    light = _minimisers(long, k, m)
    both = light.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("h")
    wanted = light.join(both, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("wanted"))
    found = cut(_packed(long.join(wanted, "doc_id"), k, m).withColumn("string", F.xxhash64("packed")))
    # equal strings become one; `string` tells different ones of a bucket apart, and their own text proves it
    strings = found.groupBy("h", "packed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("string").alias("string"))
    sizes = strings.groupBy("h").agg(F.count("*").alias("strings"), F.min("low").alias("l"), F.max("high").alias("g")).where("l <> g")
    strings = cut(strings.join(sizes.select("h", "strings"), "h"))
    # alone in its bucket: all of its windows are shared if two records hold it
    windows = F.length("packed") - k
    alone = strings.where("strings = 1").select("h", "string", F.lit(0).alias("first"), windows.alias("last"))
    few = strings.where(f"strings > 1 and strings <= {BUCKET_STRINGS}")
    few = _count_buckets(few.select("h", "string", "low", "high", "packed"), k)
    many = (
        strings.where(f"strings > {BUCKET_STRINGS}")
        .select("h", "string", "low", "high", "packed", F.explode(F.sequence(F.lit(0), windows)).alias("i"))
        .select("h", "string", "low", "high", "i", F.substring("packed", F.col("i") + 1, F.lit(k)).alias("window"))
    )
    counted = many.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("g")).where("l <> g").select("window")
    # at most PACK_WINDOWS windows of one string: back to runs
    island = F.col("i") - F.row_number().over(Window.partitionBy("h", "string").orderBy("i"))
    dealt = many.join(counted, "window", "left_semi").select("h", "string", "i", island.alias("island"))
    dealt = dealt.groupBy("h", "string", "island").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("island")
    hits = alone.unionByName(few).unionByName(dealt)
    runs = found.join(hits, ["h", "string"]).select("doc_id", (F.col("at") + F.col("first")).alias("a"), (F.col("at") + F.col("last") + k).alias("b"))
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    ends = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = runs.distinct().withColumn("new", F.when(F.col("a") <= ends, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("doc_id", "run").agg(F.min("a").cast("int").alias("span_start"), F.max("b").cast("int").alias("span_end")).drop("run")


def shared_amount(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Of every record: ``n_chars``, how many of them are shared, and the share (0 where there is no text)."""
    amount = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return n.join(amount, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.greatest("n_chars", F.lit(1)), 6).alias("shared_part"))

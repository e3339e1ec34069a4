"""Problem 7: notes into containers of fixed capacity, by their token counts.

Shortest-pack-first over the length histogram: lengths are placed longest first,
each into the shortest packs that there are, and only counts of packing patterns are
kept. (Longest-pack-first is tried beside it, on the same histogram, and taken where it
needs fewer containers, as it may where many lengths are near the capacity.) The histogram has at most ``capacity`` entries at any corpus
size. Documents get their container by their rank among those of the same length.

Only a note longer than a container is split, into full pieces and a rest. Notes
without tokens (null and empty texts) take no space: one row, container null.
Repeated rows are separate items. Containers are numbered from 0.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tokenize import TOKENIZERS, encode
from spanloom.session import cut

CAPACITY = 2048
#: Rows of one length ranked in one task.
RANK_ROWS = 100_000


def _place(histogram: dict[int, int], capacity: int, pick) -> list[tuple[tuple[int, ...], int]]:
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit a container of {capacity}")
        while n:
            free = pick((f for f in packs if f >= length and packs[f]), default=None)
            if free is None:
                each = capacity // length
                full, rest = divmod(n, each)
                for k, count in ((each, full), (rest, 1)):
                    if k and count:
                        packs.setdefault(capacity - k * length, []).append(((length,) * k, count))
                break
            pattern, count = packs[free].pop()
            used = min(n, count)
            if count > used:
                packs[free].append((pattern, count - used))
            packs.setdefault(free - length, []).append(((*pattern, length), used))
            n -= used
    merged: Counter = Counter()
    for group in packs.values():
        for pattern, count in group:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in a container) and how many containers follow each."""
    ways = [_place(histogram, capacity, pick) for pick in (max, min)]  # most free space first: the shortest pack
    return min(ways, key=lambda w: sum(count for _, count in w))


def _pieces(docs: DataFrame, capacity: int, vocabulary: str, tokenizers: str) -> DataFrame:
    n = F.col("n_tokens")
    sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")), lambda i: F.least(n - i * capacity, F.lit(capacity)))
    counted = encode(docs, vocabulary, tokenizers, counts=True)
    return cut(counted.select("doc_id", F.posexplode(sizes).alias("piece", "n_tokens")).withColumn("copy", F.monotonically_increasing_id()))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``doc_id, piece, n_tokens, container_id``; every piece once, no container over ``capacity``."""
    spark = docs.sparkSession
    pieces = _pieces(docs, capacity, vocabulary, tokenizers)
    filled = pieces.where("n_tokens > 0")
    # at most `capacity` rows
    histogram = {r[0]: r[1] for r in filled.groupBy("n_tokens").count().collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: Counter = Counter()
    base = 0
    for pattern, count in pack_histogram(histogram, capacity):
        for length, times in Counter(pattern).items():
            slots.setdefault(length, []).append((ranked[length], times * count, base, times))
            ranked[length] += times * count
        base += count
    rows = [(k, v) for k, v in slots.items()] or [(0, [])]
    places = spark.createDataFrame(rows, "n_tokens bigint, slots array<struct<first:bigint,n:bigint,base:bigint,times:bigint>>")
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    filled = filled.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(buckets)))
    order = Window.partitionBy("n_tokens").orderBy("bucket")
    offsets = filled.groupBy("n_tokens", "bucket").count().select("n_tokens", "bucket", (F.sum("count").over(order) - F.col("count")).alias("before"))
    within = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece", "copy")
    placed = (
        filled.withColumn("k", F.row_number().over(within) - 1)
        .join(offsets, ["n_tokens", "bucket"])
        .join(places, "n_tokens")
        .withColumn("rank", F.col("before") + F.col("k"))
        .withColumn("slot", F.expr("filter(slots, s -> rank >= s.first and rank < s.first + s.n)[0]"))
        .select("doc_id", "piece", "n_tokens", (F.col("slot.base") + F.expr("(rank - slot.first) div slot.times")).alias("container_id"))
    )
    return placed.unionByName(pieces.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.lit(None).cast("bigint").alias("container_id")))


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the space that is used."""
    return packed.where("container_id is not null").agg(
        (F.max("container_id") + 1).alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.round(F.sum("n_tokens") / ((F.max("container_id") + 1) * capacity), 6).alias("used"),
    )

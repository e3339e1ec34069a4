"""Problem 6: ids of a public byte-level BPE tokenizer for every document.

Merges are replayed over a block of documents at once. The distinct words of the
block become chains of symbols; an inverted index holds, for each merge, the
positions whose pair it would join. Merges come off a heap in rank order, and each
touches only the neighbours of the positions it joins.

Null and empty texts have the empty list. Strings of special tokens in a text are
ordinary text. Texts are encoded whole; repeated documents are encoded each.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the tokenizer's authors split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text per block, and words that a worker remembers between blocks.
BLOCK_CHARS, MEMO_WORDS = 4_000_000, 200_000


class MergeReplay:
    """One vocabulary and the merges that follow from its ranks."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.joined: dict[int, int] = {}
        self.find = regex.compile(SPLIT).findall
        self.memo: dict[str, list[int]] = {}

    def _join(self, a: int, b: int) -> int:
        """Id of the token that symbols a and b merge into, which is also the merge's rank; -1 for none."""
        key = a << 20 | b
        r = self.joined.get(key)
        if r is None:
            r = self.joined[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by replaying the merges over all words together."""
        sym: list[int] = []
        start = []
        nxt: list[int] = []
        prv: list[int] = []
        index: dict[int, list[int]] = {}
        byte, join = self.byte, self._join
        for w in words:
            at = len(sym)
            start.append(at)
            ids = [byte[b] for b in w]
            n = len(ids)
            sym += ids
            nxt += range(at + 1, at + n)
            nxt.append(-1)
            prv.append(-1)
            prv += range(at, at + n - 1)
            for i in range(n - 1):
                r = join(ids[i], ids[i + 1])
                if r >= 0:
                    if r in index:
                        index[r].append(at + i)
                    else:
                        index[r] = [at + i]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            where = index.pop(r)
            where.sort()
            for i in where:
                j = nxt[i]
                if j < 0 or sym[i] < 0 or join(sym[i], sym[j]) != r:
                    continue
                sym[i] = r
                sym[j] = -1
                k = nxt[i] = nxt[j]
                nxt[j] = -1
                if k >= 0:
                    prv[k] = i
                    s = join(r, sym[k])
                    if s >= 0:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(heap, s)
                h = prv[i]
                if h >= 0:
                    s = join(sym[h], r)
                    if s >= 0:
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heapq.heappush(heap, s)
        out = []
        for at in start:
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = nxt[at]
            out.append(ids)
        return out

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        code: dict[str, int] = {}
        codes: list[int] = []
        ends = []
        for t in texts:
            if t:
                for w in self.find(t):
                    c = code.get(w)
                    if c is None:
                        c = code[w] = len(code)
                    codes.append(c)
            ends.append(len(codes))
        memo, ranks = self.memo, self.ranks
        ids: list[list[int] | None] = []
        todo, place = [], []
        for w in code:
            got = memo.get(w)
            if got is None:
                b = w.encode("utf-8", "surrogatepass")
                r = ranks.get(b)
                if r is None:
                    place.append(len(ids))
                    todo.append(b)
                else:
                    got = [r]
            ids.append(got)
        if todo:
            for i, got in zip(place, self.replay(todo)):
                ids[i] = got
        if len(memo) < MEMO_WORDS:
            memo.update(zip(code, ids))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for w in ids for x in w), np.int32, int(size.sum()))
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.asarray(codes, np.int64)
        n = size[at] if len(at) else np.zeros(0, np.int64)
        done = np.concatenate(([0], np.cumsum(n)))
        take = np.arange(done[-1]) - np.repeat(done[:-1], n) + np.repeat(first[at], n)
        bounds = done[np.asarray([0, *ends])]
        return flat[take], np.diff(bounds)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of the list of about BLOCK_CHARS characters."""
    at = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BLOCK_CHARS:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, counts: bool = False) -> DataFrame:
    """``doc_id, ids`` of each row, or ``doc_id, n_tokens`` with ``counts``; a narrow plan without a shuffle."""
    path = os.path.join(tokenizers, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = MergeReplay(path)
        for batch in batches:
            texts, doc = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in blocks(texts):
                ids, n = bpe.block(texts[a:b])
                if counts:
                    col = pa.array(n, pa.int64())
                else:
                    col = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc.slice(a, b - a), col], names=["doc_id", "n_tokens" if counts else "ids"])

    out = "doc_id bigint, n_tokens bigint" if counts else "doc_id bigint, ids array<int>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, out)

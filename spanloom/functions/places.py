"""Code points of many texts at once: words, lines and spans as arrays, for Arrow batches.

Texts stand one after the other with a line end between them, so a word or a line never
goes on into the next text; a place in a text is its offset plus the ``base`` of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, and of each text its base and size."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size + 1) - size - 1, size


def among(points: np.ndarray, signs: str) -> np.ndarray:
    """Which code points are one of the ASCII ``signs``."""
    known = np.zeros(129, bool)
    known[[ord(c) for c in signs]] = True
    return known[np.minimum(points, 128)]


def runs(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of what stands between blanks."""
    edge = np.concatenate(([True], blank, [True]))
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    return edge[::2], edge[1::2]


def slices(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in all, no row parted."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to

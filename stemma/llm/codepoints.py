"""Texts as arrays of code points, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points handled at once; longer texts are cut into pieces.
PIECE = 1_000_000


@cache
def letters() -> np.ndarray:
    """Boolean by code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str | None], most: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (text number, text), each run of at most ``most`` characters or so; a longer text is a run of its own, whole."""
    at: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        if parts and size + len(text) > (most or PIECE):
            yield at, parts
            at, parts, size = [], [], 0
        at.append(i)
        parts.append(text)
        size += len(text)
    if parts:
        yield at, parts


def points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all parts, a line feed after each; start of each part and the end)."""
    joined = "\n".join(parts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return cp, starts

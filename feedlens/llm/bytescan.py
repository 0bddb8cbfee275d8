"""Numpy scans over the joined UTF-8 bytes of many texts, for operators whose tokens are runs of ASCII classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are scanned at a time; a scan's arrays take some twenty to fifty times as much.
WINDOW_BYTES = 2 << 20


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 flags, true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true."""
    padded = np.zeros(len(mask) + 2, bool)
    padded[1:-1] = mask
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def cut_at(text: bytes, seps: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """(offset, part) of a text cut behind separator bytes into parts of about ``most`` bytes.

    A part is longer only where no separator falls into it.
    """
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(s, at, at + most) for s in (seps[i : i + 1] for i in range(len(seps))))
        if cut < 0:
            later = [p for p in (text.find(seps[i : i + 1], at + most) for i in range(len(seps))) if p >= 0]
            cut = min(later, default=len(text) - 1)
        yield at, text[at : cut + 1]
        at = cut + 1
    yield at, text[at:]


class Window:
    """Parts of texts joined by line feeds. ``owner`` holds what was given with each part."""

    def __init__(self, parts: list[tuple]):
        self.owner = [p[0] for p in parts]
        self.base = np.array([p[1] for p in parts], np.int64)
        sizes = np.array([len(p[2]) + 1 for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.data = b"\n".join(p[2] for p in parts) + b"\n"

    def part_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def in_text(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Byte offsets in the whole texts of byte offsets in the window."""
        return self.base[part] + at - self.first[part]


def windows(texts: Iterable[tuple[object, bytes]], seps: bytes, size: int = WINDOW_BYTES) -> Iterator[Window]:
    """Windows of about ``size`` bytes over (owner, text); long texts are cut behind separators."""
    parts, held = [], 0
    for owner, text in texts:
        for at, part in cut_at(text, seps, size):
            parts.append((owner, at, part))
            held += len(part) + 1
            if held >= size:
                yield Window(parts)
                parts, held = [], 0
    if parts:
        yield Window(parts)

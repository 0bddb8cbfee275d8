"""Hashed word and character n-gram features of a whole text, by array operations."""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def word_table() -> np.ndarray:
    """Code point -> itself if it belongs to a word, else 0 (BMP)."""
    t = np.arange(0x10000, dtype=np.uint64)
    keep = np.fromiter((chr(i).isalnum() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)), bool, 0x10000)
    t[~keep] = 0
    return t


class SubwordHasher:
    """Buckets of every word and of its boundary-marked n-grams.

    A word is a run of letters and digits, lower-cased. N-grams of ``ns``
    characters run over ``<word>``; a word adds itself once, too.
    """

    def __init__(self, bits: int = 18, ns: tuple[int, ...] = (3, 4, 5)):
        self.bits, self.ns = bits, ns
        self.table = word_table()
        self.inv = np.uint64(_inverse(int(P)))
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.pows = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, P, np.uint64)])
            self.invs = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, self.inv, np.uint64)])

    def codes(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = cp >= 0x10000
        if wide.any():
            out = self.table[np.where(wide, 0, cp)]
            # beyond the BMP each distinct code point is asked for by itself
            for c in np.unique(cp[wide]):
                if chr(c).isalnum():
                    out[cp == c] = c
        else:
            out = self.table[cp]
        return np.concatenate([[np.uint64(0)], out, [np.uint64(0)]])

    def buckets(self, text: str) -> np.ndarray:
        """The distinct buckets of the text's words and n-grams, sorted.

        A bag has each bucket once: otherwise junk that repeats one word for
        pages would be judged by that word alone.
        """
        c = self.codes(text)
        n = len(c)
        if n > len(self.pows) - 1:
            self.grow(2 * n)
        sep = c == 0
        shift = np.uint64(64 - self.bits)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((c + np.uint64(1)) * self.pows[:n], dtype=np.uint64)])
            outs = []
            inner = np.concatenate([[0], np.cumsum(sep)])
            for k in self.ns:
                if n < k:
                    continue
                # separators may only stand at the two ends, and not everywhere
                ok = (inner[k - 1 : n] - inner[1 : n - k + 2]) == 0
                i = np.flatnonzero(ok)
                h = (sums[i + k] - sums[i]) * self.invs[i] + np.uint64(k) * MIX
                outs.append((h ^ (h >> np.uint64(29))) * MIX >> shift)
            start = np.flatnonzero(sep[:-1] & ~sep[1:]) + 1
            end = np.flatnonzero(~sep[:-1] & sep[1:]) + 1
            h = (sums[end] - sums[start]) * self.invs[start]
            outs.append((h ^ (h >> np.uint64(31))) * MIX >> shift)
        flat = np.concatenate(outs).astype(np.int32)
        flat.sort()
        return flat[np.r_[True, flat[1:] != flat[:-1]]] if len(flat) else flat

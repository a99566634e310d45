"""Words and word shingles as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time; a longer text is cut between words.
PIECE = 8_000_000
#: Modular inverse of ODD, so powers can be taken off again.
INVERSE = pow(int(ODD), -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each number."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _rows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` numbers."""
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for k in range(n):
        out += h[k : k + len(out)]
        out *= ODD
        out ^= out >> np.uint64(31)
    return mix(out)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of every run of `n` words, in order; of the whole sequence where there are fewer words, of nothing where
    there is none."""
    return _rows(words, min(n, len(words))) if len(words) else words


class Hasher:
    """Word hashes of many texts: A-Z lower-cased, split at ASCII white space.

    A word's hash is the difference of two running sums of byte values times powers, with the power of its place
    taken off."""

    def __init__(self):
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.append(np.uint64(1), np.full(n, ODD)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(INVERSE))))

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, in order; where each text's words end)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        flat = np.frombuffer(b"\n".join(raw).lower() + b"\n", np.uint8)
        blank = self.blank[flat]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        start, end = edge[::2], edge[1::2]
        stops = np.cumsum([len(r) + 1 for r in raw])
        hashes, done = [np.empty(0, np.uint64)], 0
        while done < len(start):
            upto = max(done + 1, int(np.searchsorted(end, start[done] + PIECE, "right")))
            hashes.append(self._hash(flat[start[done] : end[upto - 1]], start[done:upto] - start[done], end[done:upto] - start[done]))
            done = upto
        return np.concatenate(hashes), np.searchsorted(start, stops)

    def _hash(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(flat))
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(self.value[flat] * self.power[: len(flat)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def shingles(self, texts: list[str | None], n: int = 5) -> list[np.ndarray]:
        """Each text's shingles, in order."""
        words, ends = self.words(texts)
        runs, out, a = _rows(words, n), [], 0
        for b in ends.tolist():
            out.append(runs[a : b - n + 1] if b - a >= n else shingles(words[a:b], n))
            a = b
        return out


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    if len(h) < 2:
        return h
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])]

"""Points of one object inside Arrow batches: keyed draws side by side, and which points are near."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a message that fit one block of md5, and messages worked on together, so that they stay in the cache.
ONE_BLOCK, TOGETHER = 55, 1 << 13


def _hashes(words: np.ndarray, used: int) -> np.ndarray:
    """``scalar.stable_hash`` of messages of one block, given as 16 rows of words: those that are ``used``, zeros and the length."""
    a, b, c, d = [np.full(words.shape[1], v) for v in _START]
    f = np.empty_like(a)
    for i in range(64):
        turn, j = divmod(i, 16)
        if turn == 0:
            k = j
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            k = (5 * j + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            k = (3 * j + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * j % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _SINES[i]
        if k < used or k == 14:
            a += words[k]
        shift = _SHIFTS[turn][j % 4]
        np.left_shift(a, np.uint32(shift), out=f)
        a >>= np.uint32(32 - shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    total = np.zeros(words.shape[1], np.uint64)
    for v, start in zip((a, b, c, d), _START, strict=True):
        total += (v + start).byteswap()
    return total % np.uint64(4294967295)


def uniforms(prefixes: pa.Array, counts: np.ndarray, tags: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each draw, and for each tag (one letter) ``scalar.uniform(prefix, i, tag)`` for the i from 1 to the row's count."""
    n, total = len(prefixes), int(counts.sum())
    _, offsets, data = prefixes.buffers()
    at = np.frombuffer(offsets, np.int32)[prefixes.offset : prefixes.offset + n + 1].astype(np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(n), counts)
    i = np.arange(1, total + 1) - np.repeat(np.cumsum(counts) - counts, counts)
    digits = np.searchsorted(10 ** np.arange(1, 19), i, side="right") + 1
    if total and int((size[row] + digits).max()) >= ONE_BLOCK:
        texts = prefixes.to_pylist()
        return row, [np.array([int(hashlib.md5(f"{texts[r]}{k}{t}".encode()).hexdigest(), 16) % 4294967295 for r, k in zip(row.tolist(), i.tolist())], np.float64) / 4294967295.0 for t in tags]
    heads = np.zeros((n, 64), np.uint8)
    heads.reshape(-1)[np.repeat(64 * np.arange(n) - at[:-1], size) + np.arange(at[0], at[-1])] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    out = [np.empty(total) for _ in tags]
    for lo in range(0, total, TOGETHER):
        r, left, places = row[lo : lo + TOGETHER], i[lo : lo + TOGETHER], digits[lo : lo + TOGETHER]
        block = heads[r]
        flat = block.reshape(-1)
        end = 64 * np.arange(len(r)) + size[r] + places
        for k in range(1, int(places.max()) + 1):
            some = places >= k
            tens = left // 10
            flat[(end - k)[some]] = (48 + left - 10 * tens)[some]
            left = tens
        flat[end + 1] = 0x80
        bits = 8 * (size[r] + places + 1)
        block[:, 56], block[:, 57] = bits & 255, bits >> 8
        used = int(bits.max()) // 32 + 1
        for t, o in zip(tags, out, strict=True):
            flat[end] = ord(t)
            o[lo : lo + TOGETHER] = _hashes(np.ascontiguousarray(block.view("<u4").T), used) / 4294967295.0
    return row, out


#: Posed points that are looked up first, then those looked up together, and candidates compared together.
FIRST, NEXT, COMPARED = 1 << 9, 1 << 16, 1 << 21


class Resting:
    """Resting points of labels 0.. in the order of their cells, which are no smaller than the threshold."""

    def __init__(self, xyz: np.ndarray, label: np.ndarray, n_labels: int, threshold: float):
        self.threshold = threshold
        self.lo, self.hi = np.full((3, n_labels), np.inf), np.full((3, n_labels), -np.inf)
        for lo, hi, c in zip(self.lo, self.hi, xyz):
            np.minimum.at(lo, label, c)
            np.maximum.at(hi, label, c)
        self.low, high = xyz.min(axis=1), xyz.max(axis=1)
        # Any two points closer than the threshold lie in one cell or in neighbours; cells of all axes fit one number.
        self.width = max(threshold * (1 + 1e-9), float((high - self.low).max()) / (1 << 20))
        self.dims = [int(d) + 5 for d in np.floor((high - self.low) / self.width)]
        code = self._code(xyz)
        order = np.argsort(code, kind="stable")
        self.xyz, self.label, self.code = xyz[:, order], label[order], code[order]

    def _code(self, xyz: np.ndarray) -> np.ndarray:
        i, j, k = [np.floor((c - lo) / self.width).astype(np.int64) + 2 for c, lo in zip(xyz, self.low)]
        return (i * self.dims[1] + j) * self.dims[2] + k

    def touched(self, posed: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Those of the asked labels (flags) that have a point closer than the threshold to a posed one.

        A few of the posed points come first, the others only for labels that these leave open.
        """
        open_, out = asked.copy(), np.zeros_like(asked)
        step = max(1, posed.shape[1] // FIRST)
        self._look(posed[:, ::step], open_, out)
        for lo in range(0, posed.shape[1] if step > 1 else 0, NEXT):
            if not open_.any():
                break
            self._look(posed[:, lo : lo + NEXT], open_, out)
        return out

    def _look(self, points: np.ndarray, open_: np.ndarray, out: np.ndarray) -> None:
        keep = np.ones(points.shape[1], bool)
        for c, lo, hi in zip(points, self.lo, self.hi):
            keep &= (c >= lo[open_].min() - self.threshold) & (c <= hi[open_].max() + self.threshold)
        points = points[:, keep]
        mine = np.flatnonzero(open_[self.label])
        codes, around = self.code[mine], self._code(points)
        plane = self.dims[1] * self.dims[2]
        around = (around + np.array([i * plane + j * self.dims[2] for i in (-1, 0, 1) for j in (-1, 0, 1)])[:, None]).ravel()
        first, last = np.searchsorted(codes, around - 1, "left"), np.searchsorted(codes, around + 1, "right")
        some = np.flatnonzero(last > first)
        which, first, n = some % points.shape[1] if len(some) else some, first[some], (last - first)[some]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + COMPARED, "right")))
            k = n[at:stop]
            met = mine[np.repeat(first[at:stop] - (ends[at:stop] - k - base), k) + np.arange(int(k.sum()))]
            p = np.repeat(which[at:stop], k)
            gap = [a[met] - b[p] for a, b in zip(self.xyz, points)]
            near = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] < self.threshold * self.threshold
            hit = np.unique(self.label[met[near]])
            hit = hit[open_[hit]]
            out[hit], open_[hit] = True, False
            if not open_.any():
                return
            at = stop

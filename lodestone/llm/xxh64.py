"""XXH64 of many substrings of one byte buffer at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer substrings are rare; they are hashed one by one.
_LONG = 96


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of ``buffer[starts[i] : starts[i] + lengths[i]]`` for every i."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, _LONG + 1).astype(np.int16), kind="stable")
    sizes = lengths[order]
    short = int(np.searchsorted(sizes, _LONG, "right")) if len(sizes) else 0
    cuts = np.r_[0, np.flatnonzero(np.diff(sizes[:short])) + 1, short] if short else []
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows, n = order[a:b], int(sizes[a])
            at = starts[rows]
            if n >= 32:
                v = [s + P1 + P2, s + P2, s, s - P1]
                done = 0
                while n - done >= 32:
                    v = [_round(v[i], eight[at + (done + 8 * i)]) for i in range(4)]
                    done += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.uint64(0), x)) * P1 + P4
            else:
                h, done = np.full(len(rows), s + P5), 0
            h = h + np.uint64(n)
            while n - done >= 8:
                h = _rotl(h ^ _round(np.uint64(0), eight[at + done]), 27) * P1 + P4
                done += 8
            if n - done >= 4:
                h = _rotl(h ^ (four[at + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            while done < n:
                h = _rotl(h ^ (raw[at + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    for i in order[short:].tolist():
        out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : starts[i] + lengths[i]], seed)
    return out

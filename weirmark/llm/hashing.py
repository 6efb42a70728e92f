"""XXH64 of many byte slices at once."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64_slices(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hash of ``data[s : s + n]`` for each start and length, unsigned.

    Slices under 32 bytes are hashed together, longer ones by the library.
    """
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place
    out = np.empty(len(starts), np.uint64)
    long = lengths >= 32
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]], seed)
    short = np.flatnonzero(~long)
    at, left = starts[short].copy(), lengths[short].copy()
    with np.errstate(over="ignore"):
        acc = np.uint64(seed) + P5 + left.astype(np.uint64)
        for _ in range(3):
            has = np.flatnonzero(left >= 8)
            if not len(has):
                break
            acc[has] = _turn(acc[has] ^ (_turn(words[at[has]] * P2, 31) * P1), 27) * P1 + P4
            at[has] += 8
            left[has] -= 8
        has = left >= 4
        four = words[at] & np.uint64(0xFFFFFFFF)
        acc = np.where(has, _turn(acc ^ (four * P1), 23) * P2 + P3, acc)
        step = np.where(has, 4, 0)
        at, left = at + step, left - step
        for _ in range(3):
            has = left >= 1
            mixed = _turn(acc ^ (padded[at].astype(np.uint64) * P5), 11) * P1
            acc = np.where(has, mixed, acc)
            at, left = at + has, left - has
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        acc ^= acc >> np.uint64(32)
    out[short] = acc
    return out

"""Poisson(1) weights of many replicates at once, by the hash that ``F.xxhash64`` makes.

A weight of the bootstrap is a function of (seed, replicate, row id) only.  The replicates'
part of the hash is made once; a row's bytes are then mixed into all replicates in one
numpy operation per step, a block of rows of equal length at a time.
"""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Start of ``F.xxhash64``.
SPARK_SEED = np.uint64(42)
#: Distinct uniform draws, and the cumulated probabilities of 0, 1, 2 ... up to the largest weight.
MODULUS = 1_000_000_007
CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
       0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def _rotate(x: np.ndarray, bits: int, spare: np.ndarray) -> None:
    np.right_shift(x, np.uint64(64 - bits), out=spare)
    np.left_shift(x, np.uint64(bits), out=x)
    np.bitwise_or(x, spare, out=x)


def _round(x: np.ndarray) -> np.ndarray:
    """rotl(x, 31) * P1 of a new array."""
    return ((x << np.uint64(31)) | (x >> np.uint64(33))) * P1


def xxhash64(rows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of every row of bytes (rows x length) from every seed: rows x seeds, unsigned."""
    n, length = rows.shape
    h = np.empty((n, len(seeds)), np.uint64)
    spare = np.empty_like(h)
    words = np.ascontiguousarray(rows[:, :length // 8 * 8]).view("<u8").reshape(n, -1)
    at = 0
    if length >= 32:
        lanes = [np.broadcast_to(x, h.shape) for x in (seeds + P1 + P2, seeds + P2, seeds, seeds - P1)]
        while length - at * 8 >= 32:
            lanes = [_round(lane + words[:, at + i:at + i + 1] * P2) for i, lane in enumerate(lanes)]
            at += 4
        h[:] = 0
        for lane, bits in zip(lanes, (1, 7, 12, 18)):
            h += (lane << np.uint64(bits)) | (lane >> np.uint64(64 - bits))
        for lane in lanes:
            h ^= _round(lane * P2)
            h *= P1
            h += P4
    else:
        h[:] = seeds + P5
    h += np.uint64(length)
    for i in range(at, length // 8):
        h ^= _round(words[:, i:i + 1] * P2)
        _rotate(h, 27, spare)
        h *= P1
        h += P4
    at = length // 8 * 8
    if length - at >= 4:
        h ^= np.ascontiguousarray(rows[:, at:at + 4]).view("<u4").astype(np.uint64) * P1
        _rotate(h, 23, spare)
        h *= P2
        h += P3
        at += 4
    for i in range(at, length):
        h ^= rows[:, i:i + 1].astype(np.uint64) * P5
        _rotate(h, 11, spare)
        h *= P1
    for bits, prime in ((33, P2), (29, P3), (32, None)):
        np.right_shift(h, np.uint64(bits), out=spare)
        h ^= spare
        if prime is not None:
            h *= prime
    return h


def replicate_seeds(seed: int, n: int) -> np.ndarray:
    """``xxhash64(seed, b)`` of the replicates 0 to n - 1, as the seeds that a row id is mixed into."""
    start = xxhash64(np.array([seed], "<i4").view(np.uint8).reshape(1, 4), np.array([SPARK_SEED]))[0]
    return xxhash64(np.arange(n, dtype="<i4").view(np.uint8).reshape(n, 4), start)[:, 0]


def _steps() -> list[np.uint64]:
    """The smallest draws whose share of MODULUS reaches each entry of CDF."""
    out = []
    for p in CDF:
        t = int(p * MODULUS)
        while t / float(MODULUS) >= p:
            t -= 1
        while t / float(MODULUS) < p:
            t += 1
        out.append(np.uint64(t))
    return out


STEPS = _steps()


def poisson(h: np.ndarray) -> np.ndarray:
    """Poisson(1) weights by inversion of abs(hash) % MODULUS / MODULUS; ``h`` is overwritten."""
    signed = h.view(np.int64)
    np.abs(signed, out=signed)
    spare = h // np.uint64(MODULUS)
    spare *= np.uint64(MODULUS)
    h -= spare
    low = h.astype(np.uint32)                                       # MODULUS < 2**32
    weight = (low >= np.uint32(STEPS[0])).view(np.uint8)
    for t in STEPS[1:]:
        weight += (low >= np.uint32(t)).view(np.uint8)
    return weight

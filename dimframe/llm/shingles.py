"""Sets of word shingles and their HyperMinHash sketches, as numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import WordHashes, mix, words

#: Words to a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Registers of a sketch: the first bits of a shingle's hash choose its register.
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
#: Leading bits of the mantissa that a register keeps beside the count of leading zeros.
MANTISSA = 10
_PLACES = mix(np.arange(1, SHINGLE + 1)) | np.uint64(1)
#: Where an empty register looks, try by try, for a filled one to copy.
_PROBES = (mix(np.arange(64 * REGISTERS, dtype=np.uint64) + np.uint64(0xABCDEF)) % np.uint64(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)
_LAST_RESORT = mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(0x5EED))


def lower_ascii(text: str) -> str:
    """The text with A-Z, and no other letter, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; none without words."""
    w = hashes.array(words(lower_ascii(text))) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return mix(np.array([(w * _PLACES[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    n = len(w) - SHINGLE + 1
    total = w[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        total += w[k : k + n] * _PLACES[k]
    return np.unique(mix(total))


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash of a non-empty sorted set: per register the least hash's leading zeros and mantissa bits.

    Empty registers copy a filled one, found along a sequence of places that is
    the same for all sets, so that two sets agree in each register with a
    probability of their Jaccard similarity (plus rare collisions).
    """
    bucket = (s >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # the set is sorted: the first is the least
    rest = (s[first] << np.uint64(REGISTER_BITS)) | np.uint64((1 << REGISTER_BITS) - 1)
    zeros = 63 - np.floor(np.log2(np.maximum(rest >> np.uint64(11), np.uint64(1)).astype(np.float64))).astype(np.int64) - 11
    tail = (rest << zeros.astype(np.uint64)) << np.uint64(1)  # without the leading one
    value = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (tail >> np.uint64(64 - MANTISSA))
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    at = bucket[first]
    out[at], filled[at] = value.astype(np.uint16), True
    empty = np.flatnonzero(~filled)
    for probe in _PROBES:
        if not len(empty):
            break
        look = probe[empty]
        hit = filled[look]
        out[empty[hit]] = out[look[hit]]
        empty = empty[~hit]
    if len(empty):
        out[empty] = out[at[np.argmin(_LAST_RESORT[at])]]
    return out


def estimated_jaccard(agreeing: np.ndarray) -> np.ndarray:
    """Similarity from the number of agreeing registers, corrected for accidental agreement.

    Two unrelated registers agree when leading zeros and mantissa agree: with
    probability sum over z of 4^-(z+1) / 2^MANTISSA = 1/3 / 2^MANTISSA.
    """
    accident = 1 / 3 / 2**MANTISSA
    return (agreeing / REGISTERS - accident) / (1 - accident)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of consecutive registers; ``regs`` has a row for each sketch."""
    rows = REGISTERS // bands
    parts = regs[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(17)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ (parts[:, :, r] + np.uint64(r << 20)))
    return key

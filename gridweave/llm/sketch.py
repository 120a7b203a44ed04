"""Shingle sets of texts and their HyperMinHash registers."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Registers of a sketch, and the bits that pick one of them.
BUCKETS, BUCKET_BITS = 128, 7
#: Bits of a register: a leading-zero count, then a mantissa.
MANTISSA_BITS = 10
#: Registers in a band, and bands. At a similarity of 0.75 all bands miss with
#: a probability of (1 - 0.75 ** 3) ** 42, about 1e-10.
BAND_ROWS = 3
BANDS = BUCKETS // BAND_ROWS
LEVELS = 64 - BUCKET_BITS


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased; words are what stands between \\x20 and \\x09-\\x0D.
    With fewer words than ``width`` the whole sequence is one shingle; without
    words, or where the text is null, the set is empty.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - width].tolist()
    found = {digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)}
    out = np.fromiter(found, np.uint64, len(found))
    out.sort()
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes that differ between different sets."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (uint16) of sorted hashes; 0 is empty.

    The first bits of a hash pick the bucket. The least of the rest in each
    bucket is kept as its count of leading zeros and the bits after its first
    one, so a register takes 16 bits instead of 64.
    """
    out = np.zeros(BUCKETS, np.uint16)
    if not len(hashes):
        return out
    low = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(LEVELS)
    at = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
    first = hashes[at]
    full = (first >> np.uint64(LEVELS)) == np.arange(BUCKETS, dtype=np.uint64)
    rest = (first << np.uint64(BUCKET_BITS)) >> np.uint64(11)
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    shifted = (rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)
    mantissa = shifted >> np.uint64(53 - MANTISSA_BITS)
    zeros = np.minimum(zeros, 62)
    out[full] = ((zeros << MANTISSA_BITS) | mantissa.astype(np.int64))[full] + 1
    return out


def band_keys(regs: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band that has a full register."""
    digest, out = xxhash.xxh3_64_intdigest, []
    rows = np.ascontiguousarray(regs[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS))
    for k in np.nonzero(rows.any(axis=1))[0].tolist():
        key = digest(rows[k].tobytes(), k)
        out.append(key - (1 << 64) if key >= 1 << 63 else key)
    return out


#: Pairs whose smaller set has fewer shingles meet for certain and are never estimated.
SMALL_SET = 16


def prefix_keys(hashes: np.ndarray, percent: int) -> list[int]:
    """Signed 64-bit keys of which small sets with a similarity of ``percent`` or more share one.

    They have ceil(percent * n / 100) hashes in common at least, so their
    first n - ceil(...) + 1 in order meet. Sets that can't be similar to one
    of fewer than SMALL_SET have none.
    """
    n = len(hashes)
    if percent * n > 100 * (SMALL_SET - 1):
        return []
    own = [xxhash.xxh3_64_intdigest(h.tobytes(), BANDS) for h in hashes[: n + percent * n // -100 + 1]]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in own]


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of buckets that agree by chance, for sets of n and m.

    Two unrelated least values agree if they have the same count of leading
    zeros and the same mantissa bits.
    """
    level = np.arange(LEVELS)

    def at(size):
        load = (np.asarray(size, float) / BUCKETS)[..., None]
        stay = lambda x: np.exp(load * np.log1p(-np.minimum(x, 1 - 1e-12)))
        return stay(2.0 ** -(level + 1)) - stay(2.0**-level)

    return (at(n) * at(m)).sum(axis=-1) / 2**MANTISSA_BITS


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The collision-corrected Jaccard estimates of rows of registers, and how many registers each rests on."""
    full = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    chance = chance_matches(n, m)
    share = same / np.maximum(full, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), full


def may_link(a, b, n, m, least: float = 0.75, sigmas: float = 5.0) -> np.ndarray:
    """Whether pairs may reach the similarity ``least``.

    Sizes rule pairs out exactly, and small sets by nothing else. The estimate does within ``sigmas`` standard
    deviations, which leaves a chance of about 3e-7 to lose a pair that is
    just similar enough.
    """
    n, m = np.asarray(n), np.asarray(m)
    keep = np.minimum(n, m) >= least * np.maximum(n, m)
    at = np.nonzero(keep & (np.minimum(n, m) >= SMALL_SET))[0]
    a, b = a[at], b[at]
    full = np.maximum(((a | b) > 0).sum(axis=1), 1)
    low = least - sigmas * np.sqrt(least * (1 - least) / full)
    # The correction only lowers an estimate: most pairs fail without it.
    near = ((a == b) & (a > 0)).sum(axis=1) >= low * full
    keep[at[~near]] = False
    at = at[near]
    keep[at] = estimated(a[near], b[near], n[at], m[at])[0] >= low[near]
    return keep

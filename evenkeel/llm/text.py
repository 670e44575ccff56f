"""Words and their hashes, a batch of whole texts at a time, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def runs(lengths, most: int):
    """Slices of neighbours whose lengths sum to `most` at the most; a longer one stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[s : s + n] for each start and length."""
    out = np.empty(len(starts), np.uint64)
    buf = np.frombuffer(data + bytes(8), np.uint8)
    u64 = np.ndarray((len(data) + 1,), "<u8", buf, strides=(1,))
    u32 = np.ndarray((len(data) + 5,), "<u4", buf, strides=(1,))
    short = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=33))
    with np.errstate(over="ignore"):
        for n in range(32):
            at = order[ends[n - 1] if n else 0 : ends[n]]
            if not len(at):
                continue
            p = starts[at]
            h = np.full(len(at), np.uint64(seed) + P5 + np.uint64(n))
            done = 0
            while n - done >= 8:
                h = _rotl(h ^ (_rotl(u64[p + done] * P2, 31) * P1), 27) * P1 + P4
                done += 8
            if n - done >= 4:
                h = _rotl(h ^ (u32[p + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            while done < n:
                h = _rotl(h ^ (buf[p + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
            out[at] = h
    for i in order[ends[31] :].tolist():
        s = int(starts[i])
        out[i] = xxhash.xxh64_intdigest(data[s : s + int(lengths[i])], seed)
    return out


def shingles(texts: list[bytes | None], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' k-word shingles, and where each text's begin (one place more than texts).

    A-Z is lower-cased; words are joined by single spaces; a text of fewer words has its whole sequence as one
    shingle, a text without words none.
    """
    parts = [(t or b"").lower().split() for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    data = b" ".join(b" ".join(p) for p in parts if p)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin = np.concatenate([[0], spaces + 1])
    end = np.append(spaces, len(data))
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(m)])
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    at = np.repeat(first - offsets[:-1], m) + np.arange(offsets[-1])
    last = at + np.repeat(np.minimum(n, k) - 1, m)
    if not len(at):
        return np.empty(0, np.uint64), offsets
    return xxh64(data, begin[at], end[last] - begin[at], seed), offsets


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half of the text's hashes; 0 without any."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # byte-wide counters, eight to a word: at most 255 rows are added up before they are widened
    pieces = (n[some] + 254) // 255
    inner = np.repeat(offsets[some] - 255 * (np.cumsum(pieces) - pieces), pieces) + 255 * np.arange(pieces.sum())
    sums = np.add.reduceat(bits, inner, axis=0).view(np.uint8)
    counts = np.add.reduceat(sums.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
    over = (2 * counts > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out

"""Sets of 5-word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from gridspark.llm.hashing import join_hashes, mix, runs, span_hashes

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every shingle, texts ascending, with repeats.

    A-Z count as lower case; words are runs of anything but ASCII white space.  A text of one to four words has one
    shingle, all of it; one without words has none.
    """
    datas = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*datas, b""]), np.uint8)]
    starts, ends = runs(~_SPACE[data])
    rows = np.searchsorted(np.cumsum([len(x) + 1 for x in datas]), starts, side="right")
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(rows, np.arange(len(texts)))
    count = np.searchsorted(rows, np.arange(len(texts)), side="right") - first
    hashes, owners = [], []
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        within = rows[:n] == rows[WORDS - 1:]
        hashes.append(join_hashes(*(words[i:n + i] for i in range(WORDS)))[within])
        owners.append(rows[:n][within])
    for c in range(1, WORDS):
        short = np.flatnonzero(count == c)
        hashes.append(join_hashes(*(words[first[short] + i] for i in range(c))) if len(short) else np.zeros(0, np.uint64))
        owners.append(short)
    h, r = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def ordered_sets(hashes: np.ndarray, rows: np.ndarray, n_texts: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text, in ascending (weight, hash), and where each text's begin (one more entry at the end).

    ``weight`` belongs to the 20 upper bits of a hash.
    """
    keys = (hashes, rows) if weight is None else (hashes, weight[(hashes >> np.uint64(44)).astype(np.int64)], rows)
    order = np.lexsort(keys)
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n_texts + 1))


def set_keys(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit key per set, the same for equal sets."""
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes ^ _SALT)))
    return mix((sums[cut[1:]] - sums[cut[:-1]]) + np.diff(cut).astype(np.uint64) * _SALT)


def signature(hashes: np.ndarray) -> np.ndarray:
    """A bitmap with 2 to 4 bits per element, in 64-bit words; half of its words folded onto the other is that of half the length."""
    bits = max(64, 2 << max(0, len(hashes) - 1).bit_length())
    on = np.zeros(bits, bool)
    on[((hashes >> np.uint64(12)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)

"""Keys of packs met by hash bucket: one row per pack and bucket, whatever the number of keys in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Keys per bucket: bounds the arrays of one task.
BUCKET_KEYS = 1 << 20


def bucket_count(keys: int) -> int:
    return max(1, -(-keys // BUCKET_KEYS))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket from a hash's upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket's key positions, in order; always the same for the same keys."""
    own = bucket_of(hashes, buckets)
    own = own.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(own, kind="stable")
    bounds = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, bounds):
        if len(part):
            yield int(own[part[0]]), part


def first_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first occurrence of each distinct hash (ascending), and for every hash the number of its first."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    firsts = order[new]
    rank = np.argsort(firsts, kind="stable")
    place = np.empty(len(firsts), np.int64)
    place[rank] = np.arange(len(firsts))
    number = np.empty(len(order), np.int64)
    number[order] = place[group]
    return firsts[rank], number

"""Distances of many pairs of names at once, on arrays of code points."""

from __future__ import annotations

import numpy as np

#: Code points are counted in so many classes; merged classes only raise the bound on what two names share.
CLASSES = 64


def code_points(names: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each name, filled up with ``filler``, and the lengths."""
    lengths = np.array([len(n) for n in names], np.int64)
    out = np.full((len(names), max(1, int(lengths.max(initial=0)))), filler, np.int32)
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.int32)
    rows = np.repeat(np.arange(len(names)), lengths)
    out[rows, np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def class_counts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each class of code points occurs in each row."""
    there = np.arange(points.shape[1]) < lengths[:, None]
    at = np.nonzero(there)[0] * CLASSES + points[there] % CLASSES
    return np.bincount(at, minlength=len(points) * CLASSES).reshape(len(points), CLASSES).astype(np.int32)


def shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows of class counts, a bound on the code points that an alignment or a common substring can share."""
    out = np.zeros((len(a), len(b)), np.int32)
    for c in np.flatnonzero(a.any(0) & b.any(0)):
        out += np.minimum(a[:, c, None], b[None, :, c])
    return out


def distance_and_substring(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levenshtein distance and length of the longest common substring of each row of ``a`` with the same row of ``b``, whose
    fillers differ. One row of each table of distances is made for all pairs at a time."""
    n, width = len(a), b.shape[1]
    steps = np.arange(width + 1, dtype=np.int32)
    row, run = np.tile(steps, (n, 1)), np.zeros((n, width + 1), np.int32)
    distance, longest = lb.astype(np.int64).copy(), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        same = b == a[:, i, None]
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ~same)
        row = np.minimum.accumulate(step - steps, axis=1) + steps  # insertions, from the left
        run[:, 1:] = (run[:, :-1] + 1) * same
        longest = np.maximum(longest, run.max(1))
        ends = la == i + 1
        distance[ends] = row[ends, lb[ends]]
    return distance, longest

"""Isolation forests whose samples and splits come from hashes, so that any engine can rebuild them.

Rows of a series are ordered by a hash of their ids; tree t draws ``psi`` neighbours of that order,
from place t * psi on and around its end. A node splits at the point of its value range that its
number names; a child's number follows from its parent's and its side, a root's from the series
and the tree. Path lengths are whole billionths, so their sums are exact in any order.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from ..constants import EULER_GAMMA, IFOREST_MAX_SAMPLES, IFOREST_TREES

#: Numbers of nodes lie below MODULUS; a child's is its parent's times the factor of its side.
MODULUS, LEFT, RIGHT = 2147483647, 48271, 69621
#: Path lengths of 1.
UNIT = 1_000_000_000
#: Hex digits of MD5 that give a row's place or a root's number.
HASH_DIGITS = 7


def path_units(sizes: np.ndarray) -> np.ndarray:
    """Average path below a leaf of so many values, in units."""
    n = np.maximum(np.asarray(sizes, dtype=float), 2.0)
    full = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / n
    return np.round(UNIT * np.where(sizes <= 1, 0.0, np.where(sizes == 2, 1.0, full))).astype(np.int64)


def root_numbers(series: str, trees: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{series}#{t}".encode()).hexdigest()[:HASH_DIGITS], 16) + 1 for t in range(trees)], dtype=np.int64)


def fit(ordered: np.ndarray, series: str, trees: int = IFOREST_TREES, max_samples: int = IFOREST_MAX_SAMPLES):
    """Forest on values in hash order, as a step function: breaks, summed paths in units of the
    pieces between them (a break belongs to the left one), and psi.

    All trees grow together, level by level: a node is a range of one sorted array."""
    ordered = np.asarray(ordered, dtype=float)
    p = len(ordered)
    psi = min(max_samples, p)
    limit = math.ceil(math.log2(max(psi, 2)))
    places = (np.arange(trees)[:, None] * psi + np.arange(psi)) % p
    values = np.sort(ordered[places], axis=1).ravel()
    lo = np.arange(trees, dtype=np.int64) * psi
    hi, number, depth = lo + psi, root_numbers(series, trees), 0
    leaf_at, leaf_path, split_at, split_by = [], [], [], []
    while len(lo):
        least, most = values[lo], values[hi - 1]
        leaf = (depth >= limit) | (hi - lo <= 1) | (least == most)
        leaf_at.append(lo[leaf])
        leaf_path.append(depth * UNIT + path_units((hi - lo)[leaf]))
        lo, hi, number, least, most = (a[~leaf] for a in (lo, hi, number, least, most))
        by = least + (most - least) * (number / MODULUS)
        low, high = lo.copy(), hi - 1  # the greatest value goes right
        while (low < high).any():
            mid = (low + high) // 2
            left = values[mid] <= by
            low, high = np.where((low < high) & left, mid + 1, low), np.where((low < high) & ~left, mid, high)
        split_at.append(low)
        split_by.append(by)
        lo, hi = np.concatenate([lo, low]), np.concatenate([low, hi])
        number, depth = np.concatenate([number * LEFT % MODULUS, number * RIGHT % MODULUS]), depth + 1
    at, path, cut, by = (np.concatenate(x) for x in (leaf_at, leaf_path, split_at, split_by))
    path = path[np.argsort(at, kind="stable")]
    first = np.sort(at) % psi == 0
    # in order of place, every leaf but a tree's first follows one split
    step, by = np.diff(path, prepend=0)[~first], by[np.argsort(cut, kind="stable")]
    order = np.argsort(by, kind="stable")
    breaks, head = np.unique(by[order], return_index=True)
    steps = np.add.reduceat(step[order], head) if len(head) else np.zeros(0, np.int64)
    return breaks, np.concatenate([[0], np.cumsum(steps)]).astype(np.int64) + path[first].sum(), psi


def at_values(model, values: np.ndarray):
    """The step function of a model where only ``values`` (distinct, ascending) will be asked for."""
    breaks, paths, psi = model
    return values[:-1], paths[np.searchsorted(breaks, values, side="left")], psi

"""Agglomerative clustering of small matrices (programs, groups, spectra) on the driver, by nearest-neighbour chains."""

from __future__ import annotations

import numpy as np


def linkage(d: np.ndarray, method: str = "complete") -> list[tuple[int, int, float]]:
    """Merges (a, b, height), lowest first; clusters are numbered on from the points.  O(n^2) steps.

    Complete and average linkage never join at a lesser height than their parts,
    so merges found along chains of nearest neighbours, sorted, are the tree.
    """
    if method not in ("complete", "average"):
        raise ValueError(f"unknown linkage {method}")
    n = len(d)
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, open_, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        chain = chain or [int(np.argmax(open_))]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        found.append((float(d[a, b]), a, b))
        new = np.maximum(d[a], d[b]) if method == "complete" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a] = d[:, a] = new
        d[b] = d[:, b] = d[a, a] = np.inf
        size[a], open_[b] = size[a] + size[b], False
    # A cluster goes by its least point until here.
    number, out = list(range(n)), []
    for i, (height, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        x, y = _root(number, a), _root(number, b)
        out.append((x, y, height))
        number.append(n + i)
        number[x] = number[y] = n + i
    return out


def _root(number: list[int], i: int) -> int:
    while number[i] != i:
        i = number[i]
    return i


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Leaves from left to right of a clustering's tree."""
    held = {i: [i] for i in range(n)}
    for i, (a, b, _) in enumerate(merges):
        held[n + i] = held[a] + held[b]
    return held[n + len(merges) - 1] if merges else list(range(n))


def order(rows: np.ndarray, clustered: bool = True) -> list[int]:
    """Row numbers by a complete-linkage tree over Euclidean distances, or as they are; missing values count as 0."""
    if not clustered or len(rows) < 3:
        return list(range(len(rows)))
    x = np.nan_to_num(rows)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    return leaf_order(linkage(d), len(rows))

"""Helpers of the two link operators: spanning edges instead of all pairs."""

from __future__ import annotations

import numpy as np


def spanning_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked values and for each the smallest value of its component in the graph of the edges u-v."""
    if not len(u):
        return u[:0], u[:0]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new

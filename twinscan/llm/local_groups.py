"""Union of links inside one task: a spanning forest instead of all pairs."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of `n` local nodes; links arrive in arrays and are folded in at once."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that is not the first of its component, and that first node."""
        nodes = np.flatnonzero(self.label != np.arange(len(self.label)))
        return nodes, self.label[nodes]

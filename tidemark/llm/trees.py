"""Decision trees by Gini impurity, for small labelled tables."""

from __future__ import annotations

import numpy as np

Tree = tuple


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 64, random: np.random.Generator | None = None, tries: int = 0) -> Tree:
    """(field, threshold, low, high), or a leaf (share of label 1,).

    With ``random``, each split looks at ``tries`` fields drawn anew.
    """
    if depth == 0 or len(np.unique(labels)) == 1:
        return (float(labels.mean()),)
    fields = range(rows.shape[1])
    if random is not None:
        fields = np.sort(random.choice(rows.shape[1], min(tries, rows.shape[1]), replace=False))
    best = None
    for field in fields:
        values = np.unique(rows[:, field])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, field] <= threshold
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, int(field), float(threshold))
    if best is None:  # nothing tells the rows apart
        return (float(labels.mean()),)
    _, field, threshold = best
    low = rows[:, field] <= threshold
    return (
        field,
        threshold,
        grow(rows[low], labels[low], depth - 1, random, tries),
        grow(rows[~low], labels[~low], depth - 1, random, tries),
    )


def share(tree: Tree, row: tuple) -> float:
    """The share of label 1 in the leaf that a row falls into."""
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def classify(tree: Tree, row: tuple) -> int:
    return int(share(tree, row) >= 0.5)


class Forest:
    """Trees on bootstrap samples with random fields; a row's score is the mean of its leaves."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 10, seed: int = 13):
        random = np.random.default_rng(seed)
        tries = max(1, round(np.sqrt(rows.shape[1])))
        self.trees = []
        for _ in range(trees):
            own = random.integers(0, len(rows), len(rows))
            self.trees.append(grow(rows[own], labels[own], depth, random, tries))

    def score(self, row: tuple) -> float:
        return sum(share(t, row) for t in self.trees) / len(self.trees)

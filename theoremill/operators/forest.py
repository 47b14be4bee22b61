"""A fitted random forest as arrays, and its scores for all pairs of two sets of node vectors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from theoremill.plans.scratch import _remove, scratch_dir


class Forest:
    """Trees of a RandomForestClassificationModel on edge features (R12). Each tree is (feature, threshold, left, right,
    share of label 1), a leaf having no feature (-1)."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], scheme: str):
        self.trees, self.scheme = trees, scheme

    @classmethod
    def of(cls, spark, model, scheme: str) -> "Forest":
        """Reads the nodes from the model as Spark saves it."""
        path = f"{scratch_dir(spark).rstrip('/')}/theoremill/forest-{uuid.uuid4().hex}"
        model.save(path)
        node = F.col("nodeData")
        rows = spark.read.parquet(f"{path}/data").select("treeID", node["id"], node["leftChild"], node["rightChild"], node["impurityStats"], node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"]).collect()  # trees x 2 ** (depth + 1) rows at most
        _remove(spark, path)
        trees: dict[int, list] = {}
        for tree, *rest in rows:
            trees.setdefault(tree, []).append(rest)
        made = []
        for _, nodes in sorted(trees.items()):
            nodes.sort()
            _, left, right, stats, feature, threshold = zip(*nodes, strict=True)
            leaf = np.array(left) < 0
            share = np.array([s[1] / sum(s) if sum(s) else 0.0 for s in stats])
            made.append((np.where(leaf, -1, feature), np.array([t[0] if t else 0.0 for t in threshold]), np.array(left), np.array(right), share))
        return cls(made, scheme)

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Share of label 1 for each pair of a row of q (source) and a row of c (target), to 9 digits: sums in another
        order differ behind that."""
        votes = np.zeros((len(q), len(c)))
        if self.scheme == "concatenation":
            for tree in self.trees:
                votes += self._by_sides(tree, q, c)
        else:
            for i, own in enumerate(q):
                x = own + c if self.scheme == "sum" else (own + c) / 2
                for tree in self.trees:
                    votes[i] += self._walk(tree, len(x), lambda at, f, t, x=x: x[at, f] <= t)
        return np.round(votes / len(self.trees), 9)

    @staticmethod
    def _walk(tree: tuple[np.ndarray, ...], n: int, goes_left) -> np.ndarray:
        feature, threshold, left, right, share = tree
        at = np.zeros(n, int)
        while len(rows := np.flatnonzero(feature[at] >= 0)):
            node = at[rows]
            at[rows] = np.where(goes_left(rows, feature[node], threshold[node]), left[node], right[node])
        return share[at]

    def _by_sides(self, tree: tuple[np.ndarray, ...], q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """A node of the tree asks one side only, so rows that answer all nodes of their side alike are one class: the tree
        is walked once for each pair of classes."""
        feature, threshold = tree[:2]
        width = q.shape[1]
        classes = []
        for x, low in ((q, 0), (c, width)):
            asks = np.unique(np.stack([feature, threshold], 1)[(feature >= low) & (feature < low + width)], axis=0)
            says = np.packbits(x[:, asks[:, 0].astype(int) - low] <= asks[:, 1], axis=1)
            says = np.ascontiguousarray(np.concatenate([says, np.zeros((len(x), 1), np.uint8)], 1))
            _, first, of = np.unique(says.view(f"V{says.shape[1]}").ravel(), return_index=True, return_inverse=True)
            classes.append((x[first], of))
        (a, of_a), (b, of_b) = classes
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
        pairs = self._walk(tree, len(i), lambda at, f, t: np.where(f < width, a[i[at], np.minimum(f, width - 1)], b[j[at], np.maximum(f - width, 0)]) <= t)
        return pairs.reshape(len(a), len(b))[of_a][:, of_b]

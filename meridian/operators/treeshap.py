"""Path-dependent attributions of tree ensembles (Lundberg et al.): exact Shapley values by enumeration of a
tree's own features, for shallow trees. Runs as Arrow batches over exported tree arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame


def export(model: GBTClassificationModel) -> list[tuple[float, list[tuple]]]:
    """Each tree's weight and nodes: (feature, threshold, left, right, value, share of rows)."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[tuple] = []

        def walk(node, total: float) -> int:
            at = len(nodes)
            nodes.append(())
            share = node.impurityStats().count() / total if total else 1.0
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, -1, -1, node.prediction(), share)
            else:
                split = node.split()
                n = node.impurityStats().count()
                left, right = walk(node.leftChild(), n), walk(node.rightChild(), n)
                nodes[at] = (split.featureIndex(), split.threshold(), left, right, node.prediction(), share)
            return at

        walk(tree._call_java("rootNode"), 0)
        out.append((weight, nodes))
    return out


def _expected(nodes: list[tuple], x: np.ndarray, known: frozenset, at: int = 0) -> np.ndarray:
    feature, threshold, left, right, value, _ = nodes[at]
    if feature < 0:
        return np.full(len(x), value)
    a, b = _expected(nodes, x, known, left), _expected(nodes, x, known, right)
    if feature in known:
        return np.where(x[:, feature] <= threshold, a, b)
    return nodes[left][5] * a + nodes[right][5] * b


def attributions(trees: list[tuple[float, list[tuple]]], x: np.ndarray) -> np.ndarray:
    """Shapley values of each row and feature; with the expected value they add up to the ensemble's margin."""
    out = np.zeros(x.shape)
    for weight, nodes in trees:
        used = sorted({n[0] for n in nodes if n[0] >= 0})
        values = {frozenset(s): _expected(nodes, x, frozenset(s)) for k in range(len(used) + 1) for s in combinations(used, k)}
        for f in used:
            for s, v in values.items():
                if f not in s:
                    share = factorial(len(s)) * factorial(len(used) - len(s) - 1) / factorial(len(used))
                    out[:, f] += weight * share * (values[s | {f}] - v)
    return out


def explain(model: GBTClassificationModel, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``key`` and, per feature, its attribution for the row (the ensemble's margin)."""
    trees = export(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = attributions(trees, batch[features].to_numpy(dtype=float))
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame(values, columns=[f"phi_{f}" for f in features])], axis=1)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *features).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"phi_{f} double" for f in features))

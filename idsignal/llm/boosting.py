"""Gradient-boosted trees for two classes: `fit` on rows held in memory, `grow` on a table of any size.

`grow` sums one histogram of gradients a level over all rows; sums are of integers (`UNIT` is 1), so
that the order of rows and tasks cannot change a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNIT = 1 << 40
#: Rows of a table that sum one histogram together.
PART_ROWS = 50_000


def _leaf(gradient: np.ndarray, weight: np.ndarray) -> float:
    return float(gradient.sum() / (weight.sum() + 1.0))


def _tree(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple:
    """(feature, cut, low, high) or (value,): splits that gain most of the squared gradient."""
    best = (1e-6, None, None)
    total_g, total_w = gradient.sum(), weight.sum()
    if depth and len(rows) >= 10:
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            place = np.searchsorted(edges, rows[:, f])
            g = np.cumsum(np.bincount(place, gradient, len(edges) + 1))[:-1]
            w = np.cumsum(np.bincount(place, weight, len(edges) + 1))[:-1]
            gain = g * g / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - total_g ** 2 / (total_w + 1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, edges[i])
    if best[1] is None:
        return (_leaf(gradient, weight),)
    low = rows[:, best[1]] <= best[2]
    return (best[1], float(best[2]), _tree(rows[low], gradient[low], weight[low], cuts, depth - 1),
            _tree(rows[~low], gradient[~low], weight[~low], cuts, depth - 1))


def _add(tree: tuple, rows: np.ndarray, index: np.ndarray, rate: float, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[index] += rate * tree[0]
        return
    low = rows[index, tree[0]] <= tree[1]
    _add(tree[2], rows, index[low], rate, out)
    _add(tree[3], rows, index[~low], rate, out)


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> dict:
    """A model of P(label = 1). One class only, or no rows: a constant."""
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    model = {"start": float(np.log(share / (1 - share))), "rate": rate, "trees": []}
    if not 0 < labels.sum() < len(labels):
        return model
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, 33)[:-1])) for f in range(rows.shape[1])]
    logit = np.full(len(rows), model["start"])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        tree = _tree(rows, labels - p, p * (1 - p), cuts, depth)
        model["trees"].append(tree)
        _add(tree, rows, np.arange(len(rows)), rate, logit)
    return model


def _split(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """(feature, bin) of the split that gains most, by the sums (gradient, weight, rows) per feature and bin of a node."""
    best, found = 1e-6, None
    total_g, total_w, rows = sums[0].sum(0)
    if rows < 10:
        return None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        g, w = sums[f, :len(edges), 0].cumsum() / UNIT, sums[f, :len(edges), 1].cumsum() / UNIT
        all_g, all_w = total_g / UNIT, total_w / UNIT
        gain = g * g / (w + 1) + (all_g - g) ** 2 / (all_w - w + 1) - all_g ** 2 / (all_w + 1)
        i = int(gain.argmax())
        if gain[i] > best:
            best, found = gain[i], (f, i)
    return found


def _nested(node: dict, number: dict[int, float] | None = None) -> tuple:
    """The tree below `node` as `_add` takes it, cuts as bins; with `number`, leaves hold that of theirs or 0."""
    if node["split"]:
        return (*node["split"], _nested(node["low"], number), _nested(node["high"], number))
    return (node["sums"][0] / (node["sums"][1] + UNIT),) if number is None else (number.get(id(node), 0.0),)


def _with_cuts(tree: tuple, cuts: list[np.ndarray]) -> tuple:
    if len(tree) == 1:
        return (float(tree[0]),)
    return (tree[0], float(cuts[tree[0]][tree[1]]), _with_cuts(tree[2], cuts), _with_cuts(tree[3], cuts))


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bins from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def in_parts(binned: DataFrame, rows: int) -> DataFrame:
    """`binned`, of at most `rows` rows, in one part per `PART_ROWS` of them.

    Each part gives a row per cell of its histogram on every level. Spread over more parts the same rows
    give the same sums in many more rows, up to one per row and feature.
    """
    return binned.coalesce(max(1, -(-rows // PART_ROWS)))


def _partial_sums(binned: DataFrame, model: dict, tree: tuple, open_nodes: int, width: int, bins: int) -> DataFrame:
    """Sums (slot, gradient, weight, n) of each part of `binned`, without its empty cells."""
    slots = open_nodes * width * bins

    def run(batches):
        sums = np.zeros((3, slots), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unpacked(batch.column("bins"), width)
            weight, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "n"))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            p, node = predict(model, rows), np.zeros(len(rows))
            _add(tree, rows, np.arange(len(rows)), 1.0, node)
            at = np.flatnonzero(node)
            parts = [np.rint(x[at]).astype(np.int64) for x in ((label - p) * weight, p * (1 - p) * weight, count)]
            first = (node[at].astype(np.int64) - 1) * width * bins
            for f in range(width):
                place = first + f * bins + rows[at, f]
                for held, part in zip(sums, parts):
                    np.add.at(held, place, part)
        met = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), *[pa.array(x[met]) for x in sums]], ["slot", "gradient", "weight", "n"])

    return binned.mapInArrow(run, "slot long, gradient long, weight long, n long")


def _histograms(binned: DataFrame, model: dict, tree: tuple, open_nodes: int, width: int, bins: int) -> np.ndarray:
    """Sums (gradient, weight, rows) by open node, feature and bin over all rows."""
    parts = _partial_sums(binned, model, tree, open_nodes, width, bins)
    found = parts.groupBy("slot").agg(F.sum("gradient"), F.sum("weight"), F.sum("n"))
    out = np.zeros((open_nodes * width * bins, 3), np.int64)
    for slot, *sums in found.collect():
        out[slot] = sums
    return out.reshape(open_nodes, width, bins, 3)


def grow(binned: DataFrame, cuts: list[np.ndarray], trees: int = 40, depth: int = 3, rate: float = 0.3) -> tuple[dict, dict]:
    """The model that `fit` describes from all rows (bins, label, weight in `UNIT`, n) of a written table; it and its form on bins.

    A row's bins are bytes, one a feature: the number of its cuts below the value. The table is best written `in_parts`.
    """
    weights = {r["label"]: r["weight"] / UNIT for r in binned.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
    share = (weights.get(True, 0.0) + 0.5) / (sum(weights.values()) + 1.0)
    model = {"start": float(np.log(share / (1 - share))), "rate": rate, "trees": []}
    width, bins = len(cuts), max([len(c) for c in cuts], default=0) + 1
    for _ in range(trees if len(weights) == 2 else 0):
        root = {"split": None, "sums": None}
        level = [root]
        for _ in range(depth):
            if not level:
                break
            numbers = {id(node): k + 1.0 for k, node in enumerate(level)}
            below = []
            for node, sums in zip(level, _histograms(binned, model, _nested(root, numbers), len(level), width, bins)):
                node["sums"] = sums[0].sum(0)
                node["split"] = _split(sums, cuts)
                if node["split"]:
                    low = sums[node["split"][0], :node["split"][1] + 1].sum(0)
                    node["low"], node["high"] = {"split": None, "sums": low}, {"split": None, "sums": node["sums"] - low}
                    below += [node["low"], node["high"]]
            level = below
        model["trees"].append(_nested(root))
    return {**model, "trees": [_with_cuts(t, cuts) for t in model["trees"]]}, model


def predict(model: dict, rows: np.ndarray) -> np.ndarray:
    logit = np.full(len(rows), model["start"])
    for tree in model["trees"]:
        _add(tree, rows, np.arange(len(rows)), model["rate"], logit)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

"""Forests and boosted trees over the cells of binned features.

Trees split between bins, so rows with equal bins are a cell with two counts, and a fitted model is what it says of each cell.
The cells are bounded by the bins whatever the rows; boosting is a task for each model, a forest a task for each ``BATCH`` trees.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("forest", "boosted", "depthwise", "leafwise")

#: Bins of a feature, as MLlib has by default; most cells of a grid, which bounds a task's memory; trees of a task.
BINS, CELLS, BATCH = 32, 1 << 20, 25

#: Nodes whose counts are worked out at once, which stay in a processor's cache.
NODES = 1024

#: What each kind does where settings don't say otherwise, after the libraries that it stands in for.
DEFAULTS = {
    "forest": {"numTrees": 500, "minInstancesPerNode": 10, "maxDepth": None},
    "boosted": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 3, "subsamplingRate": 0.9},
    "depthwise": {"maxIter": 400, "stepSize": 0.05, "max_depth": 4, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
    "leafwise": {"maxIter": 400, "stepSize": 0.05, "num_leaves": 31, "min_child_samples": 30, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"},
}


@dataclass
class Cells:
    """Edges between the bins of each feature, and of each cell the training rows and those of label 1, and whether it is asked for."""

    features: list[str]
    edges: list[list[float]]
    n: np.ndarray | None = None
    pos: np.ndarray | None = None
    asked: np.ndarray | None = None

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.edges)

    def number(self) -> Column:
        """The cell of a row; a missing value is in the last bin."""
        out = F.lit(0)
        for feature, edges in zip(self.features, self.edges):
            value = F.coalesce(F.col(feature).cast("double"), F.lit(float("nan")))
            out = out * (len(edges) + 1)
            for e in edges:
                out = out + (value > F.lit(e)).cast("int")
        return out.alias("cell")

    def counts(self, rows: DataFrame, label: str = "label") -> tuple[np.ndarray, np.ndarray]:
        """Rows of each cell, and those of label 1."""
        found = rows.where(F.col(label).isNotNull()).select(self.number(), label).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).toArrow()
        n, pos = np.zeros(math.prod(self.sizes), np.int64), np.zeros(math.prod(self.sizes), np.int64)
        at = found["cell"].to_numpy()
        n[at], pos[at] = found["n"].to_numpy(), found["pos"].to_numpy()
        return n, pos


def edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Between values where a feature has up to ``BINS`` of them, else at quantiles (within a ten-thousandth of the rows)."""
    shares = [i / BINS for i in range(1, BINS)]
    values = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    quantiles = rows.agg(*[F.percentile_approx(values[f], shares, 10000).alias(f) for f in features]).first()
    found = {f: sorted(set(quantiles[f] or [])) for f in features}
    if few := [f for f in features if len(found[f]) < BINS - 1]:
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), values[f].alias("v")) for f in few])).alias("s")).select("s.*").where("v IS NOT NULL").distinct()
        first = each.withColumn("rn", F.row_number().over(Window.partitionBy("f").orderBy("v"))).where(F.col("rn") <= BINS + 1).collect()
        for f in few:
            if len(known := sorted(r["v"] for r in first if r["f"] == f)) <= BINS:
                found[f] = [(a + b) / 2 for a, b in zip(known, known[1:])]
    return [found[f] for f in features]


def cells(train: DataFrame, asked: DataFrame, features: list[str]) -> tuple[Cells, np.ndarray, np.ndarray] | None:
    """The cells of the training rows; the rows of each cell asked for, and those of label 1. None where bins make too many cells."""
    grid = Cells(features, edges(train, features))
    if math.prod(grid.sizes) > CELLS:
        return None
    grid.n, grid.pos = grid.counts(train)
    n, pos = grid.counts(asked)
    grid.asked = n > 0
    return grid, n[grid.asked], pos[grid.asked]


def _by_node(cells: np.ndarray, child: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in the order of their new nodes: pairs of nodes are in order already, so a running count is enough."""
    right, pair, sizes = (child & 1).astype(bool), child >> 1, np.bincount(child, minlength=nodes)
    lefts = np.cumsum(~right, dtype=np.int32)
    # a left cell follows all earlier left cells and the right cells of earlier pairs, and the other way round
    before_right, before_left = (np.cumsum(sizes[1::2]) - sizes[1::2] - 1).astype(np.int32), np.cumsum(sizes[::2]).astype(np.int32)
    to = np.where(right, np.arange(len(cells), dtype=np.int32) - lefts + before_left.take(pair), lefts + before_right.take(pair))
    out, node = np.empty_like(cells), np.empty_like(child)
    out[to], node[to] = cells, child
    return out, node


def tree(rng: np.random.Generator, bins: np.ndarray, sizes: tuple[int, ...], total: np.ndarray, positive: np.ndarray, asked: np.ndarray, most: int, least: int, depth: int | None) -> np.ndarray:
    """The share of label 1 in the leaf of each cell that is ``asked`` for: Gini splits of ``most`` features drawn for each node.

    A level of the tree is split at once, its cells in the order of their nodes. Counts below 2 ** 24 are exact as single floats, which are faster."""
    out, at = np.zeros(len(total)), np.flatnonzero((total > 0) | asked)
    kind = np.float32 if total.sum() < 1 << 24 else np.float64
    bins, w, y = bins[:, at], total[at], positive[at]
    node, size, pos, level = np.zeros(len(at), np.int32), np.array([total.sum()], kind), np.array([positive.sum()], kind), 0
    out[at] = pos[0] / max(1, size[0])
    while len(at) and (depth is None or level < depth):
        tried = np.flatnonzero((size >= 2 * least) & (pos > 0) & (pos < size))
        drawn = np.argsort(rng.random((len(tried), len(sizes)), np.float32), axis=1)[:, :most]
        base = pos * pos / np.maximum(size, 1)
        best, feature, cut = base + 1e-6 * np.maximum(base, 1), np.full(len(size), -1, np.int8), np.zeros(len(size), bins.dtype)
        left_size, left_pos = np.zeros_like(size), np.zeros_like(pos)
        for f, width in enumerate(sizes):
            which = tried[(drawn == f).any(1)]
            if width < 2 or not len(which):
                continue
            place = np.full(len(size), -1, np.int32)
            place[which] = np.arange(0, len(which) * width, width, dtype=np.int32)
            key = place.take(node)
            pick = np.flatnonzero((key >= 0) & (w > 0))
            key, binned, weight, hits = key.take(pick), bins[f].take(pick), w.take(pick), y.take(pick)
            ends = np.searchsorted(key, np.arange(NODES * width, (len(which) + NODES) * width, NODES * width))
            begin = 0
            for block, end in enumerate(ends.tolist()):
                nodes = which[block * NODES : (block + 1) * NODES]
                inside = key[begin:end] - block * NODES * width + binned[begin:end]
                t = np.bincount(inside, weight[begin:end], len(nodes) * width).astype(kind).reshape(-1, width).cumsum(1)[:, :-1]
                q = np.bincount(inside, hits[begin:end], len(nodes) * width).astype(kind).reshape(-1, width).cumsum(1)[:, :-1]
                begin = end
                rest, more = size[nodes, None] - t, pos[nodes, None] - q
                bad = np.minimum(t, rest) < least
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = q * q / t
                    more *= more
                    more /= rest
                gain += more
                gain[bad] = -1
                j = gain.argmax(1)
                found = gain[np.arange(len(nodes)), j]
                won = np.flatnonzero(found > best[nodes])
                to, j = nodes[won], j[won]
                best[to], feature[to], cut[to], left_size[to], left_pos[to] = found[won], f, j, t[won, j], q[won, j]
        split = feature >= 0
        size = np.stack([left_size[split], size[split] - left_size[split]], 1).ravel()
        pos = np.stack([left_pos[split], pos[split] - left_pos[split]], 1).ravel()
        goes = np.flatnonzero(split.take(node))
        old = node.take(goes)
        child = (2 * (np.cumsum(split, dtype=np.int32) - 1)).take(old)
        child += bins.ravel().take((feature.astype(np.int64) * len(at)).take(old) + goes) > cut.take(old)
        out[at.take(goes)] = (pos / np.maximum(size, 1).astype(float)).take(child)
        stays = np.flatnonzero(((size >= 2 * least) & (pos > 0) & (pos < size)).take(child))
        goes, node = _by_node(goes.take(stays), child.take(stays), len(size))
        at, bins, w, y = at.take(goes), bins.take(goes, axis=1), w.take(goes), y.take(goes)
        level += 1
    return out


def forest(grid: Cells, settings: dict, first: int, trees: int, seed: int) -> np.ndarray:
    """The sum over some trees of what they say of each cell; each tree draws its rows with replacement (a Poisson count each)."""
    s, out = DEFAULTS["forest"] | settings, np.zeros(len(grid.n))
    at = np.flatnonzero((grid.n > 0) | grid.asked)
    bins = np.stack(np.unravel_index(at, grid.sizes)).astype(np.int32)
    most = math.ceil(math.sqrt(len(grid.sizes)))
    for k in range(first, first + trees):
        rng = np.random.default_rng([seed, k])
        pos = rng.poisson(grid.pos[at]).astype(float)
        total = pos + rng.poisson(grid.n[at] - grid.pos[at])
        out[at] += tree(rng, bins, grid.sizes, total, pos, grid.asked[at], most, s["minInstancesPerNode"], s["maxDepth"])
    return out


def _split(stats: np.ndarray, box: tuple, whole: np.ndarray, used: list[int], over: int, penalty: float, least_rows: int, least_weight: float):
    """The best split of a box of cells, or None: gain, feature, the first bin of its right side, and the left side's totals.

    stats: gradient, curvature and rows by the bins of the first feature, of the second, and so on."""
    found, left, part = [], [], stats[(slice(None), *[slice(a, b) for a, b in box])]
    for f in range(len(box) - 1, -1, -1):
        if f in used and part.shape[-1] > 1:
            found.append((f, part.shape[-1] - 1))
            left.append(part.sum(axis=tuple(range(1, f + 1))).cumsum(1)[:, :-1])
        part = part.sum(axis=-1)
    if not found:
        return None
    left = np.concatenate(left, axis=1)
    right = whole[:, None] - left
    ok = (left[2] >= max(1, least_rows)) & (right[2] >= max(1, least_rows)) & (left[1] >= least_weight) & (right[1] >= least_weight)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[0] ** 2 / (left[over] + penalty) + right[0] ** 2 / (right[over] + penalty), -1.0) - whole[0] ** 2 / (whole[over] + penalty)
    j = best = int(gain.argmax())
    if not gain[j] > 1e-9:
        return None
    for f, width in found:
        if j < width:
            return float(gain[best]), f, box[f][0] + j + 1, left[:, best]
        j -= width


def _grown(stats: np.ndarray, used: list[int], depth: int, leaves: int, **rules) -> list[tuple[tuple, np.ndarray]]:
    """The leaves of a tree as boxes of cells with their totals; the leaf of the most gain is split first."""
    box, whole = tuple((0, b) for b in stats.shape[1:]), stats.reshape(3, -1).sum(1)
    done, queue, k = [], [], 0

    def ask(box, whole, level):
        nonlocal k
        found = _split(stats, box, whole, used, **rules) if level < depth else None
        k += 1
        if found is None:
            done.append((box, whole))
        else:
            heapq.heappush(queue, (-found[0], k, box, whole, level, found))

    ask(box, whole, 0)
    while queue and len(done) + len(queue) < leaves:
        _, _, box, whole, level, (_, f, at, left) = heapq.heappop(queue)
        ask((*box[:f], (box[f][0], at), *box[f + 1 :]), left, level + 1)
        ask((*box[:f], (at, box[f][1]), *box[f + 1 :]), whole - left, level + 1)
    return done + [(q[2], q[3]) for q in queue]


def _thinned(rng: np.random.Generator, counts: np.ndarray, rate: float):
    """A function that keeps each row of counts by chance; equal counts are drawn together, which is faster."""
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    ones, many = order[counts[order] == 1], order[counts[order] > 1]
    lots = counts[many]

    def draw() -> np.ndarray:
        out = np.zeros(len(counts))
        out[ones] = rng.random(len(ones)) < rate
        out[many] = rng.binomial(lots, rate)
        return out

    return draw


def boosted(grid: Cells, kind: str, settings: dict, seed: int) -> np.ndarray:
    """The probability of label 1 in each cell: Newton steps of the logistic loss from the training rows' log-odds.

    ``boosted`` picks splits by the residuals' variance, ``depthwise`` by curvature with a penalty of 1, and ``leafwise`` grows
    the leaf of the most gain up to ``num_leaves``."""
    s = DEFAULTS[kind] | settings
    rules = {
        "boosted": {"over": 2, "penalty": 0.0, "least_rows": 1, "least_weight": 0.0},
        "depthwise": {"over": 1, "penalty": 1.0, "least_rows": 1, "least_weight": 1.0},
        "leafwise": {"over": 1, "penalty": 0.0, "least_rows": s.get("min_child_samples", 1), "least_weight": 1e-3},
    }[kind]
    depth = {"boosted": s.get("maxDepth"), "depthwise": s.get("max_depth")}.get(kind, sum(grid.sizes))
    leaves = s["num_leaves"] if kind == "leafwise" else 1 << depth
    rng, width = np.random.default_rng([seed, KINDS.index(kind)]), len(grid.sizes)
    columns = math.ceil(float(s.get("featureSubsetStrategy", 1)) * width)
    keep_pos, keep_neg = _thinned(rng, grid.pos, s["subsamplingRate"]), _thinned(rng, grid.n - grid.pos, s["subsamplingRate"])
    share = min(max(grid.pos.sum() / max(1, grid.n.sum()), 1e-6), 1 - 1e-6)
    odds = np.full(grid.sizes, math.log(share / (1 - share)))
    for _ in range(s["maxIter"]):
        pos, p = keep_pos().reshape(grid.sizes), 1 / (1 + np.exp(-odds))
        rows = pos + keep_neg().reshape(grid.sizes)
        stats = np.stack([rows * p - pos, rows * p * (1 - p), rows])
        used = sorted(rng.choice(width, columns, replace=False).tolist())
        for box, (slope, bend, _) in _grown(stats, used, depth, leaves, **rules):
            if (bend := bend + rules["penalty"]) > 1e-12:
                odds[tuple(slice(a, b) for a, b in box)] -= s["stepSize"] * slope / bend
    return (1 / (1 + np.exp(-odds))).ravel()


def fits(spark: SparkSession, asked: list[tuple[Cells, str, dict]], seed: int = 42) -> list[np.ndarray]:
    """Of each model asked for, the probability of label 1 in each cell asked for, which its tasks send back.

    Boosting, which takes longest in a task, begins first."""
    jobs = [(k, 0, 0) for k, (_, kind, _) in enumerate(asked) if kind != "forest"]
    for k, (_, kind, settings) in enumerate(asked):
        trees = (DEFAULTS["forest"] | settings)["numTrees"] if kind == "forest" else 0
        jobs += [(k, at, min(BATCH, trees - at)) for at in range(0, trees, BATCH)]
    if not jobs:
        return []
    sent = spark.sparkContext.broadcast((asked, jobs, seed))

    def run(batches):
        import pyarrow as pa

        asked, jobs, seed = sent.value
        for batch in batches:
            for j in batch["id"].to_pylist():
                k, first, trees = jobs[j]
                grid, kind, settings = asked[k]
                p = forest(grid, settings, first, trees, seed) if kind == "forest" else boosted(grid, kind, settings, seed)
                yield pa.RecordBatch.from_pydict({"job": pa.array([j], pa.int64()), "p": pa.array([p[grid.asked].tobytes()], pa.binary())})

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "job long, p binary").toArrow()
    sent.destroy()
    told = dict(zip(found["job"].to_pylist(), found["p"].to_pylist()))
    out = [np.zeros(int(grid.asked.sum())) for grid, _, _ in asked]
    for j, (k, _, _) in enumerate(jobs):
        out[k] += np.frombuffer(told[j])
    return [p / (DEFAULTS["forest"] | settings)["numTrees"] if kind == "forest" else p for p, (_, kind, settings) in zip(out, asked)]


def average_precision(p: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float:
    """Steps at distinct scores, rounded as ``models.evaluate`` does; n and pos: the rows of each cell, and those of label 1."""
    scores, place = np.unique(-np.round(p, 6), return_inverse=True)
    hits, rows = np.bincount(place, pos, len(scores)), np.bincount(place, n, len(scores))
    return float((hits * hits.cumsum() / rows.cumsum()).sum() / hits.sum()) if hits.sum() else 0.0


def score(rows: DataFrame, grid: Cells, p: np.ndarray) -> DataFrame:
    """Adds ``p``, the probability that a model found for the row's cell; the table of cells is bounded, so it is sent round."""
    import pyarrow as pa

    at = np.flatnonzero(grid.asked)
    known = rows.sparkSession.createDataFrame(pa.table({"cell": pa.array(at, pa.int32()), "p": pa.array(p)}))
    return rows.withColumn("cell", grid.number()).join(F.broadcast(known), "cell").drop("cell")

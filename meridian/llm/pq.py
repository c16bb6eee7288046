"""Embedding near-duplicates by product quantisation.

Unit vectors are dealt to coarse lists; a vector's residual to its list's centroid is kept as one code for
each of several subspaces, with the exact length of what the codes leave out. A vector is compared with its
own list and with every other list whose cell comes nearer than ``REACH`` times the radius of the cosine
threshold. Of two vectors within the radius, the one on whose side of the plane between their lists the
midpoint doesn't lie is at most half the radius from that plane, so at a reach of a half or more no neighbour
can be missed. A pair counts in the list on whose side its midpoint lies, so once where both ask. Distances come from lookup tables of the asking vector; pairs that the left-out length can't rule
out are ranked again by their exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialise, release
from meridian.llm.components import components

#: Vectors the index is fitted on at most (those with the smallest hash of their id); all are indexed.
SAMPLE = 20_000
#: Most lists; vectors in a list on average, below that; most in one block: blocks, not lists, are what a task holds.
LISTS, PER_LIST, BLOCK = 4096, 400, 1024
#: Share of the radius up to which cells are probed, from both sides; below a half, pairs may be missed.
REACH = 0.5
#: Subspaces and centroids of each.
SUBSPACES, CODES = 16, 32


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centroids; fewer where there are fewer different vectors."""
    start = np.unique(x, axis=0)
    if len(start) <= k:
        return start
    centroids = start[np.random.default_rng(seed).choice(len(start), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T, 0)


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([squares(x[i : i + step], centroids).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Coarse centroids and the codebooks of residual subspaces."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = kmeans(x, lists)
        residual = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = [c for c in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(c)]
        self.books = [kmeans(residual[:, c], CODES) for c in self.cuts]
        self.between = np.sqrt(squares(self.coarse, self.coarse))

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector and the length of what they leave out."""
        residual = x - self.coarse[lists]
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)
        left = sum(((residual[:, c] - b[codes[:, m]]) ** 2).sum(1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)))
        return codes, np.sqrt(left)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's list, and the other lists whose cell is within ``radius``.

        The bisecting plane of two centroids is (far² - near²) / (2 * their distance) away."""
        d = squares(x, self.coarse)
        own = d.argmin(1)
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * self.between[own] + 1e-7
        near[np.arange(len(x)), own] = False
        return own, [np.flatnonzero(row) for row in near]

    def here(self, list_: int, homes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a pair counts in ``list_``: a of that list, b of the list ``homes``. Exactly one of the two lists says so."""
        lengths = (self.coarse * self.coarse).sum(1)
        side = ((a + b) * (self.coarse[homes] - self.coarse[list_])).sum(1) + (lengths[list_] - lengths[homes])
        return (side < 0) | ((side == 0) & (list_ < homes))

    def distances(self, list_: int, codes: np.ndarray, asking: np.ndarray) -> np.ndarray:
        """Asymmetric distances of asking vectors to coded members of a list, squared, from lookup tables."""
        residual = asking - self.coarse[list_]
        out = np.zeros((len(codes), len(asking)))
        for m, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += squares(residual[:, c], book).T[codes[:, m]]
        return out


def linked(index: Index, list_: int, a: np.ndarray, codes: np.ndarray, left: np.ndarray, b: np.ndarray, least: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose cosine is at least ``least``: always the sum of the products in order of components."""
    near = np.sqrt(index.distances(list_, codes, b)) <= (radius + left)[:, None] + 1e-9
    share = near.mean()
    if share > 0.02:
        near &= a @ b.T >= least - 1e-9
    i, j = np.nonzero(near)
    good = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        good[part] = (a[i[part]] * b[j[part]]).sum(1) >= least
    return i[good], j[good]


def _kind(embeddings: DataFrame) -> str:
    return "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, d, x (dimension and bytes, as wide as they came) of the vectors that can link: finite, not zero."""
    kind = _kind(embeddings)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e")).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("e").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0)).where(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).where(F.exists("e", lambda v: v != 0))
    width = 4 if kind == "float" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lists = batch.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
                edges = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), data], ["vec_id", "d", "x"])

    return rows.mapInArrow(run, "vec_id long, d int, x binary")


def _matrix(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    data = list(column)
    x = np.frombuffer(b"".join(data), dtype=np.float32 if kind == "float" else np.float64).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_vectors(embeddings: DataFrame, least: float = 0.95, lists: int | None = None, sample: int = SAMPLE, reach: float = REACH) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector: pairs link at a cosine of ``least`` or more.

    embeddings: ``vec_id, embedding``; other columns are ignored. A null, empty or zero vector, or one with a
    null or non-finite component, links with nothing; vectors of each dimension have an index of their own.
    Rows that share an id are one vector (the smallest array). A null id is a row without links or component.
    An empty table gives no rows. Lists are cut into blocks of ``BLOCK`` by hash; a task compares two blocks
    and gives counts and a spanning star per component, never pairs, so a list that holds a third of all
    vectors is many tasks."""
    kind = _kind(embeddings)
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    x = materialise(_valid(embeddings), "vectors")
    found = None
    for row in x.groupBy("d").count().where("count > 1").orderBy("d").collect():
        one = _links(x.where(F.col("d") == row["d"]), row["count"], kind, least, lists, sample, reach)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.where("vec_id <> star").select(F.col("star").alias("a"), F.col("vec_id").alias("b"))).withColumnRenamed("node", "vec_id")
    out = ids.join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _links(x: DataFrame, n: int, kind: str, least: float, lists: int | None, sample: int, reach: float) -> DataFrame:
    """vec_id, links, star of n vectors of one dimension: counts of links, and a smaller linked vector, by block."""
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    fitted = Index(_matrix(x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["x"].to_pylist(), kind), lists or min(LISTS, max(1, n // PER_LIST)))
    sent = x.sparkSession.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                v = _matrix(part.column(1).to_pylist(), kind)
                own, others = index.probes(v, radius * reach)
                codes, left = index.encode(v, own)
                rows = np.concatenate([np.arange(len(v)), np.repeat(np.arange(len(v)), [len(p) for p in others])])
                to = np.concatenate([own, *others])
                asks = np.arange(len(rows)) >= len(v)
                coded = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(own[rows].astype(np.int32)), pa.array(asks), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), coded, pa.array(left[rows])], ["list", "home", "asks", "vec_id", "x", "codes", "left"])

    placed = materialise(x.select("vec_id", "x").mapInArrow(place, "list int, home int, asks boolean, vec_id long, x binary, codes binary, left double"), "placed")
    # at most LISTS rows
    sizes = placed.groupBy("list").agg(F.count_if(~F.col("asks")).alias("members"), F.count_if(F.col("asks")).alias("asking"))
    sizes = sizes.select("list", F.ceil(F.col("members") / BLOCK).cast("int").alias("m"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("q"))
    dealt = placed.join(F.broadcast(sizes), "list").where("m > 0")
    block = F.pmod(F.xxhash64("vec_id"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("m"))).cast("int")
    dealt = dealt.withColumn("block", block)
    # a member meets every block of its list, from each side once; an asking vector every block of members
    members = dealt.where("NOT asks").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") + F.col("q") - 1)))
    members = members.select("list", F.when(F.col("other") < F.col("m"), F.least("block", "other")).otherwise(F.col("block")).alias("i"), F.when(F.col("other") < F.col("m"), F.greatest("block", "other")).otherwise(F.col("other")).alias("j"), "home", "asks", "block", "m", "vec_id", "x", "codes", "left")
    asking = dealt.where("asks").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    asking = asking.select("list", "i", (F.col("m") + F.col("block")).alias("j"), "home", "asks", "block", "m", "vec_id", "x", "codes", "left")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        index, list_, i, j = sent.value, int(key[0]), int(key[1]), int(key[2])
        asks, blocks = group["asks"].to_numpy(), group["block"].to_numpy()
        first = np.flatnonzero(~asks & (blocks == i))
        second = np.flatnonzero(asks) if asks.any() or j >= int(group["m"].iloc[0]) else np.flatnonzero(blocks == j)
        empty = pd.DataFrame({"vec_id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "star": np.empty(0, np.int64)})
        if not len(first) or not len(second):
            return empty
        names, v = group["vec_id"].to_numpy(), _matrix(group["x"], kind)
        codes = np.frombuffer(b"".join(group["codes"].iloc[first]), np.uint8).reshape(len(first), -1)
        a, b = linked(index, list_, v[first], codes, group["left"].to_numpy()[first], v[second], least, radius)
        a, b = first[a], second[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        elif asks.any() and len(a):
            here = index.here(list_, group["home"].to_numpy()[b], v[a], v[b])
            a, b = a[here], b[here]
        if not len(a):
            return empty
        n_links = np.bincount(a, minlength=len(group)) + np.bincount(b, minlength=len(group))
        star = names.copy()
        while True:
            before = star.copy()
            np.minimum.at(star, a, star[b])
            np.minimum.at(star, b, star[a])
            if (before == star).all():
                break
        who = np.flatnonzero(n_links)
        return pd.DataFrame({"vec_id": names[who], "links": n_links[who], "star": star[who]})

    found = members.unionByName(asking).groupBy("list", "i", "j").applyInPandas(compare, "vec_id long, links long, star long")
    found = materialise(found, "vector-links")
    release(placed)
    return found

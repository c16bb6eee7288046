"""N-gram Jaccard join by vertical partitioning.

The global order of shingles (by hash) is cut into fragments. Two sets alike by t or more differ in at most
(1 - t) / t of either's size, so of that many fragments and one more at least one is the same in both: each
set announces its largest fragments, that many, and sets that announce the same fragment are candidates.
The fragment that is the same may be empty in both, but only if neither has more fragments that aren't empty
than may differ. Such a set (a small one, as a rule) also announces single shingles: its first in the global
order, one more than may differ. Before the first one that two alike sets share, each has only shingles that
differ, so both announce it.
A candidate pair's overlap is counted fragment by fragment and the partial counts are summed.

Near copies share most fragments, so most fragments are announced by the same list of sets: a list is kept
once, however many fragments have it. Only components are wanted, so the members of a list are first compared
with one leader each, in rounds. Sets that are still in different components are compared by outlines (a
byte of hash and one of size for every fragment), which bound from below how much two sets differ; only pairs
that the outlines can't tell apart have their overlap counted. Short lists pair up by a join; longer ones that
lean on the same component are merged, so that its members meet an outsider once, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.buckets import PACKED, bucket_bits, by_bucket, pack
from meridian.llm.common import materialise, release
from meridian.llm.components import components
from meridian.llm.substrings import NULL_ID, _stretches
from meridian.llm.words import Words, mix

#: Up to this many members of a list pair up by a join; more meet in blocks of at most ``BLOCK``. Most members in a row.
FEW, BLOCK, CHUNK = 16, 512, 4096
#: Ids that may be sent to every executor: 32 MB of them.
SENT_IDS = 4_000_000
#: Rounds in which members are compared with leaders only.
ROUNDS = 1
#: Bytes of text whose shingles are hashed, or whose sets are sent on, at once.
PART = 2 << 20
#: Parts in which overlaps are counted.
PARTS = 4

_SET, _SAME, _FRAGMENT = 0, 1, 2
#: Keeps signatures of single shingles apart from those of fragments.
_SINGLE = np.uint64(0x2545F4914F6CDD1D)
_IDENTITY = np.uint64(0x5851F42D4C957F2D)


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""

    def unshift(y: np.ndarray, k: int) -> np.ndarray:
        out = y
        for _ in range(64 // k):
            out = y ^ (out >> np.uint64(k))
        return out

    x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    return unshift(unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)), 30)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has.

    Texts are worked on ``PART`` bytes at a time: what hashing and sorting need meanwhile is many times a text's size."""
    parts = [_shingle_sets(batch.column(0), n) for batch in _stretches([pa.RecordBatch.from_arrays([texts], ["text"])], 0, PART)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, sizes = zip(*parts, strict=True)
    return np.concatenate(hashes), np.concatenate(sizes)


def _shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, lower=True)
    per = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    rows = np.repeat(np.arange(len(per)), per)
    at = words.first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
    hashes = np.empty(len(rows), dtype=np.uint64)
    full = words.counts[rows] >= n
    if full.any():
        hashes[full] = words.windows(n)[at[full]]
    for k in range(1, n):
        short = words.counts[rows] == k
        if short.any():
            hashes[short] = words.windows(k)[at[short]]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.empty(0, bool)
    return hashes[new], np.bincount(rows[new], minlength=len(per))


def _octaves(size: int, t: float) -> list[int]:
    """The size classes that a set announces in: its octave, and the one below if a set there can be alike."""
    k = size.bit_length() - 1
    return [k] + ([k - 1] if k and math.floor(size * t) < 1 << k else [])


def _cut(hashes: np.ndarray, k: int, t: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of the global order in size class k: how many, and of those that a set has, place, size and content hash."""
    fragments = math.floor((1 << k + 1) / t * (1 - t) / t + 1e-9) + 1
    place = ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return fragments, place[start], np.diff(np.append(start, len(hashes))), np.add.reduceat(mix(hashes), start)


def _announce(hashes: np.ndarray, k: int, t: float) -> np.ndarray:
    """Signatures of a set's largest fragments in size class k, one more than can differ; of shingles too where it hasn't so many."""
    _, place, sizes, sums = _cut(hashes, k, t)
    least = math.floor(len(hashes) * (1 - t) / t + 1e-9) + 1
    most = np.lexsort((place, sizes))[::-1][:least]
    found = mix(sums[most] + mix(place[most].astype(np.uint64) * np.uint64(64) + np.uint64(k)))
    if len(place) >= least:
        return found
    return np.concatenate([found, mix(mix(hashes[:least] ^ _SINGLE) + np.uint64(k))])


def _outline(hashes: np.ndarray, k: int, t: float) -> bytes:
    """A byte of size and a byte of hash for every fragment; zeros where the set has none."""
    fragments, place, sizes, sums = _cut(hashes, k, t)
    out = np.zeros((fragments, 2), dtype=np.uint8)
    out[place, 0] = np.minimum(sizes, 255)
    out[place, 1] = mix(sums) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound by which fragments differ (outlines on the last axis): nothing where hashes are equal, else by their
    sizes' difference, or by two where sizes are equal."""
    gap = np.abs(a[..., 0].astype(np.int16) - b[..., 0].astype(np.int16)).astype(np.uint8)
    gap[gap == 0] = 2
    gap[a[..., 1] == b[..., 1]] = 0
    return gap


def _least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For outlines a (m, f, 2) and b (n, f, 2): a lower bound of the symmetric differences, (m, n)."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    step = max(1, (4 << 20) // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        out[i : i + step] = _gaps(a[i : i + step, None], b[None]).sum(2, dtype=np.int64)
    return out


def _announced(rows: DataFrame, n: int, t: float, bits: int) -> DataFrame:
    """Packed: each set's identity, copies within a stretch of input, and the announcements of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches, 1):
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            hashes, sizes = shingle_sets(batch.column(1), n)
            first = np.cumsum(sizes) - sizes
            known: dict[tuple, int] = {}
            sets, same, found = [], [], []
            for i in order[sizes[order] > 0].tolist():
                mine = hashes[first[i] : first[i] + sizes[i]]
                identity = (int(np.add.reduce(mix(mine ^ _IDENTITY))), len(mine))
                head = known.setdefault(identity, i)
                if head != i:
                    same.append((int(ids[head]), int(ids[i])))
                    continue
                sets.append((identity[0], int(ids[i]), len(mine)))
                for k in _octaves(len(mine), t):
                    found.append((_announce(mine, k, t), ids[i], len(mine) << 6 | k))
            if sets:
                h, d, s = zip(*sets, strict=True)
                yield pack(np.array(h, np.uint64), np.array(d, np.int64), np.array(s, np.int64), _SET, bits)
                per = [len(x[0]) for x in found]
                yield pack(np.concatenate([x[0] for x in found]), np.repeat(np.array([x[1] for x in found], np.int64), per), np.repeat(np.array([x[2] for x in found], np.int64), per), _FRAGMENT, bits)
            if same:
                a, b = (np.array(x, np.int64) for x in zip(*same, strict=True))
                yield pack(mix(a.view(np.uint64)), b, np.zeros(len(b), np.int64), _SAME, bits)

    return rows.mapInArrow(run, PACKED)


MET = "kind int, key long, octave int, chunk int, weight long, docs binary, values binary"


def _bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of runs of 64-bit numbers."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(8 * sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _met(packed: DataFrame) -> DataFrame:
    """``MET``: of equal sets, leaders (docs) and the sets equal to them (values); of announcements that more than one
    document makes, lists of documents and their sets' sizes. ``key`` is a list's own hash, not the announcement."""

    def rows(kind: int, key: np.ndarray, octave: np.ndarray, chunk: np.ndarray, weight: np.ndarray, docs: pa.Array, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(octave.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(weight.astype(np.int64)), docs, values], ["kind", "key", "octave", "chunk", "weight", "docs", "values"])

    def equal(leaders: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(docs), 1 << 20):
            part = slice(at, at + (1 << 20))
            one = np.zeros(1, np.int64)
            yield rows(_SAME, one, one, one, one, _bytes(leaders[part].astype(np.int64), np.array([len(docs[part])])), _bytes(docs[part].astype(np.int64), np.array([len(docs[part])])))

    def work(hashes, docs, places, kinds) -> Iterator[pa.RecordBatch]:
        which = kinds == _SAME
        if which.any():
            yield from equal(_unmix(hashes[which]).view(np.int64), docs[which])
        which = kinds == _SET
        h, d, s = hashes[which], docs[which], places[which]
        order = np.lexsort((d, s, h))
        h, d, s = h[order], d[order], s[order]
        if len(h):
            head = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
            leaders = d[np.flatnonzero(head)[np.cumsum(head) - 1]]
            yield from equal(leaders[~head], d[~head])
        which = kinds == _FRAGMENT
        h, d, s = hashes[which], docs[which], places[which]
        order = np.lexsort((s, d, h))
        h, d, s = h[order], d[order], s[order]
        if not len(h):
            return
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(start, len(h)))
        names = np.add.reduceat(mix(d.view(np.uint64) ^ mix(s.astype(np.uint64))), start) + mix(n.astype(np.uint64))
        # sorted by document, so the first and the last differ where any two do
        names, at, weight = np.unique(np.where(d[start] != d[start + n - 1], names, np.uint64(0)), return_index=True, return_counts=True)
        names, at, weight = (x[names > 0] for x in (names, at, weight))
        if not len(names):
            return
        start, n = start[at], n[at]
        chunks = -(-n // CHUNK)
        of = np.repeat(np.arange(len(n)), chunks)
        chunk = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start, n = start[of] + chunk * CHUNK, np.minimum(n[of] - chunk * CHUNK, CHUNK)
        take = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield rows(_FRAGMENT, names[of], s[start] % 64, chunk, weight[of], _bytes(d[take], n), _bytes(s[take] // 64, n))

    return by_bucket(packed, work, MET)


def _pairs_of(met: DataFrame) -> DataFrame:
    """a, b: equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, values in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (docs, values)], ["a", "b"])

    return met.where(F.col("kind") == _SAME).select("docs", "values").mapInArrow(run, "a long, b long").where("a <> b")


def _members(met: DataFrame) -> DataFrame:
    """key, octave, weight, doc, size: the members of each list, once, and how many fragments have the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                docs, sizes = ([np.frombuffer(x.as_py(), np.int64) for x in part.column(i)] for i in (3, 4))
                rows = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in docs]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(3)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(sizes))], ["key", "octave", "weight", "doc", "size"])

    lists = met.where(F.col("kind") == _FRAGMENT).groupBy("key", "octave", "chunk").agg(F.sum("weight").alias("weight"), F.first("docs").alias("docs"), F.first("values").alias("sizes"))
    return lists.select("key", "octave", "weight", "docs", "sizes").mapInArrow(run, "key long, octave int, weight long, doc long, size long")


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the documents in ``wanted`` (doc, distinct, written): ids are sent round where they are few enough."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, "doc", "left_semi")


def _sets(rows: DataFrame, n: int, t: float) -> DataFrame:
    """doc, version, part, size, hashes: the sets of documents, cut into parts of the global order.

    version: the set's identity, as rows that share an id may have different sets. Part -1 - k holds the outline in size class k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches, 1, PART):
            hashes, sizes = shingle_sets(batch.column(1), n)
            out, at = [], 0
            for doc, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                mine = hashes[at : at + size]
                at += size
                if size:
                    version = int(np.add.reduce(mix(mine ^ _IDENTITY)).view(np.int64))
                    cut = np.searchsorted(mine, np.arange(PARTS + 1, dtype=np.float64)[1:-1] * 2.0 ** (64 - int(math.log2(PARTS))))
                    out += [(doc, version, i, size, x.tobytes()) for i, x in enumerate(np.split(mine, cut))]
                    out += [(doc, version, -1 - k, size, _outline(mine, k, t)) for k in _octaves(size, t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc", "version", "part", "size", "hashes"])

    return rows.select("doc", "text").mapInArrow(run, "doc long, version long, part int, size long, hashes binary")


def _side(rows: DataFrame, name: str) -> DataFrame:
    """The columns of one side of a pair: its document becomes ``name``."""
    return rows.withColumnsRenamed({"doc": name, **{c: f"{c}_{name}" for c in ("version", "size", "hashes")}})


def _wanted(pairs: DataFrame) -> DataFrame:
    return materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")


def _alike(pairs: DataFrame, outlines: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: those of ``pairs`` (a, b, octave) that are alike, written to the shared folder: partial overlaps by part, summed per pair."""
    pairs = materialise(pairs, "pairs")
    wanted = _wanted(pairs)
    near = materialise(_told_apart(pairs, _only(outlines, wanted), percent).distinct(), "pairs")
    found = _counted(near, sets, percent)
    release(pairs, wanted, near)
    return found


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(5), batch.column(6), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())], ["a", "b", "version_a", "version_b", "sizes", "shared"])

    wanted = _wanted(pairs)
    sets = _only(sets, wanted)
    both = pairs.join(_side(sets, "b"), "b").join(_side(sets, "a"), ["a", "part"])
    both = both.select("a", "b", "version_a", "version_b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "hashes_a", "hashes_b")
    summed = both.mapInArrow(run, "a long, b long, version_a long, version_b long, sizes long, shared long").groupBy("a", "b", "version_a", "version_b", "sizes").agg(F.sum("shared").alias("shared"))
    found = materialise(summed.where(F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent).select("a", "b").distinct(), "alike")
    release(wanted)
    return found


def _comparable(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _one_row_each(named: DataFrame) -> DataFrame:
    """``doc, text`` rows without repeated pairs; only rows of repeated ids move."""
    repeated = materialise(named.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "repeated")
    if repeated.isEmpty():
        return named
    return named.join(repeated, "doc", "left_anti").unionByName(named.join(repeated, "doc", "left_semi").distinct())


def near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of texts whose shingle sets are alike.

    docs: ``doc_id, text``; other columns are ignored. Two rows link when 100 times the intersection of their
    sets is at least ``percent`` times the union. A text of fewer than ``n`` words has its whole sequence as
    one shingle; a null or empty one has none and links with nothing, its component is its own id. Equal sets
    are linked before anything else. Rows that share an id share a component: it links with whatever any of
    them links with. A null id is its own row with a null component. An empty table gives no rows."""
    t = percent / 100
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = _one_row_each(rows.where(F.col("doc") != NULL_ID))
    met = materialise(_met(_announced(named, n, t, bucket_bits(docs))), "met")
    members = materialise(_members(met), "members")
    links = [materialise(_pairs_of(met), "links")]
    release(met)
    wanted = materialise(members.select("doc").distinct(), "wanted")
    stored = materialise(_sets(_only(named, wanted), n, t), "sets")
    release(wanted)
    sets, outlines = stored.where("part >= 0"), stored.where("part < 0").withColumn("octave", -1 - F.col("part")).drop("part")
    known = materialise(components(links[0]), "components")
    for round_ in range(ROUNDS + 1):
        sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("weighs"))
        now = members.join(known.join(sizes, "component").withColumnRenamed("node", "doc"), "doc", "left").withColumns({"component": F.coalesce("component", "doc"), "weighs": F.coalesce("weighs", F.lit(1))})
        # the leader: of the largest component, the document that most lists agree on
        lead = F.max_by(F.struct("doc", "size", "component"), F.struct("weighs", F.xxhash64("component"), F.xxhash64("doc", F.lit(round_))))
        mixed = now.groupBy("key", "octave").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"), lead.alias("lead")).where("least < most").drop("least", "most")
        now = materialise(now.join(mixed, ["key", "octave"]).drop("weighs"), "mixed")
        release(members)
        members = now.drop("component", "n", "lead")
        members._scratch = now._scratch
        if round_ < ROUNDS:
            pairs = now.where(F.col("component") != F.col("lead.component")).where(_comparable("size", "lead.size", percent)).select("doc", F.col("lead.doc").alias("lead"), "octave", "weight")
            # one pair a set and round: where it shares most fragments
            pairs = pairs.groupBy("doc", "lead").agg(F.sum("weight").alias("n"), F.min("octave").alias("octave")).groupBy("doc").agg(F.max_by(F.struct("lead", "octave"), F.struct("n", -F.col("lead"))).alias("s"))
            pairs = pairs.select(F.least("doc", "s.lead").alias("a"), F.greatest("doc", "s.lead").alias("b"), "s.octave").distinct()
        else:
            pairs = _remaining(now, outlines, percent)
        found = _alike(pairs, outlines, sets, percent)
        if found.isEmpty():
            release(found)
            continue
        links.append(found)
        all_links = links[0]
        for more in links[1:]:
            all_links = all_links.unionByName(more)
        before, known = known, materialise(components(all_links), "components")
        release(before)
    release(members, stored, *links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shingle_sets(batch.column(1), n)[1].astype(np.int64))], ["doc", "n_shingles"])

    sizes = rows.mapInArrow(run, "doc long, n_shingles long")
    out = sizes.join(known.withColumnRenamed("node", "doc"), "doc", "left")
    own = F.col("doc") != NULL_ID
    return out.select(F.when(own, F.col("doc")).alias("doc_id"), "n_shingles", F.when(own, F.coalesce("component", "doc")).alias("component_id"))


def _possible(differ: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with so many elements together, that differ by so many at least, can be alike."""
    return differ * (100 + percent) <= (100 - percent) * sizes


def _outlines(column) -> np.ndarray:
    data = [x.as_py() if isinstance(x, pa.Scalar) else x for x in column]
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1, 2)


def _told_apart(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, octave) whose outlines leave open that they are alike."""
    both = pairs.join(_side(outlines, "a"), ["a", "octave"]).join(_side(outlines, "b"), ["b", "octave"]).select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "hashes_a", "hashes_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                one, two = ([x.as_py() for x in part.column(i)] for i in (3, 4))
                a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 2) for x in (one, two))
                starts = np.cumsum([0, *(len(x) // 2 for x in one)])[:-1]
                differ = np.add.reduceat(_gaps(a, b).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(_possible(differ, part.column(2).to_numpy(), percent), pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _remaining(now: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """a, b, octave: pairs across components that share a list, less those of long lists that their outlines tell apart."""
    few, many = now.where(F.col("n") <= FEW), now.where(F.col("n") > FEW)
    left, right = (few.select("key", "octave", F.col("doc").alias(x), F.col("size").alias(f"size_{x}"), F.col("component").alias(f"component_{x}")) for x in "ab")
    pairs = left.join(right, ["key", "octave"]).where("a < b AND component_a <> component_b").where(_comparable("size_a", "size_b", percent)).select("a", "b", "octave")
    return pairs.unionByName(_in_blocks(many, outlines, percent)).groupBy("a", "b").agg(F.min("octave").alias("octave"))


def _in_blocks(many: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The same for long lists. Those with the same leading component are one: tasks compare two blocks of outlines each."""
    outside = F.col("component") != F.col("cluster")
    members = materialise(many.select(F.col("lead.component").alias("cluster"), "octave", "doc", "component").distinct(), "clusters")
    counts = members.groupBy("cluster", "octave").agg(F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("p"), F.ceil(F.count_if(~outside) / BLOCK).cast("int").alias("q"))
    wanted = materialise(members.select("doc").distinct(), "wanted")
    rows = members.join(counts, ["cluster", "octave"]).where("p > 0").join(_only(outlines, wanted), ["doc", "octave"])
    block = F.pmod(F.xxhash64("doc"), F.when(outside, F.col("p")).otherwise(F.col("q"))).cast("int")
    rows = rows.withColumn("block", block).withColumnsRenamed({"hashes": "outline"})
    apart = rows.where(outside).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1)))
    inner = F.col("other") < F.col("p")
    kept = ("doc", "size", "component", "outline")
    apart = apart.select("cluster", "octave", F.when(inner, F.least("block", "other")).otherwise(F.col("block")).alias("i"), F.when(inner, F.greatest("block", "other")).otherwise(F.col("other")).alias("j"), F.col("block").alias("mine"), *kept)
    others = rows.where(~outside).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("cluster", "octave", "i", (F.col("p") + F.col("block")).alias("j"), (F.col("p") + F.col("block")).alias("mine"), *kept)

    def compare(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        octave, i, j, mine = table["octave"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py(), table["mine"].to_numpy()
        docs, sizes, parts = table["doc"].to_numpy(), table["size"].to_numpy(), table["component"].to_numpy()
        first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        if not len(first) or not len(second):
            return
        outline = _outlines(table["outline"].to_pylist())
        sums = sizes[first][:, None] + sizes[second][None, :]
        good = _possible(_least_difference(outline[first], outline[second]), sums, percent) & (parts[first][:, None] != parts[second][None, :])
        a, b = np.nonzero(np.triu(good, 1) if i == j else good)
        if len(a):
            a, b = docs[first[a]], docs[second[b]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), octave, np.int32))], ["a", "b", "octave"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if keys[at] != current and held:
                    yield from compare(held)
                    held = []
                current = keys[at]
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield from compare(held)

    return apart.unionByName(others).repartition("cluster", "octave", "i", "j").sortWithinPartitions("cluster", "octave", "i", "j").mapInArrow(run, "a long, b long, octave int")

"""Substring deduplication by difference-cover anchors.

{0, 1, 3, 9} is a difference cover modulo 13: for any two places there is a shift below 13 that brings both
to a cover position. Two equal windows of 20 words therefore share, at the same offset in both, an anchor of
20 - 12 = 8 words that begins at a cover position. Only anchors are hashed everywhere, four in thirteen
words; where an anchor occurs twice, the match is extended: the windows around it are hashed whole, and of
each window's occurrences all but the earliest are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.buckets import PACKED, bucket_bits, by_bucket, pack
from meridian.llm.common import materialise
from meridian.llm.words import Words

PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text whose entries are summed up before they move.
STRETCH = 12 << 20
#: The id that stands for a null one: the smallest.
NULL_ID = -(1 << 63)
_ALWAYS, _ASK = 1, 0


def _stretches(batches: Iterator[pa.RecordBatch], column: int, most: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text column has about ``most`` bytes, at least a row each."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.cumsum(np.array(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)) if len(texts) else np.empty(0, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _within(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of ``length`` words inside one text: its first word, its row, its place in the text."""
    n = np.maximum(words.counts - length + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return words.first[rows] + places, rows, places


def _firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order: whether each is the first of its hash, and whether its hash occurs again."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    first, again = np.empty(len(hashes), bool), np.empty(len(hashes), bool)
    first[order] = np.concatenate([[True], ~same]) if len(hashes) else first
    again[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(hashes) else again
    return first, again


def _anchors(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """Packed anchors. Of one that a stretch of input has twice, the first asks for others' sake; none needs an answer."""
    length = window - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches, 1):
            ids, words = batch.column(0).to_numpy(), Words(batch.column(1))
            at, rows, places = _within(words, length)
            chosen = cover[places % PERIOD] & (words.counts[rows] >= window)
            at, rows, places = at[chosen], rows[chosen], places[chosen]
            if not len(at):
                continue
            hashes = words.windows(length)[at]
            order = np.lexsort((places, ids[rows]))
            hashes, rows, places = hashes[order], rows[order], places[order]
            first, again = _firsts(hashes)
            for kind, which in ((_ASK, first), (_ALWAYS, again)):
                if (out := pack(hashes[which], ids[rows[which]], places[which], kind, bits)) is not None:
                    yield out

    return docs.mapInArrow(run, PACKED)


def _found(batch_of: tuple[np.ndarray, np.ndarray], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_of[0]), pa.array(batch_of[1].astype(np.int32))], ["doc", name])


def _repeated_anchors(packed: DataFrame) -> DataFrame:
    """doc, at: anchors that occur at more than one place."""

    def work(hashes, docs, places, kinds) -> Iterator[pa.RecordBatch]:
        ask = kinds == _ASK
        _, again = _firsts(hashes[ask])
        yield _found((np.concatenate([docs[ask][again], docs[~ask]]), np.concatenate([places[ask][again], places[~ask]])), "at")

    return by_bucket(packed, work, "doc long, at int")


def _windows(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """Packed windows around repeated anchors (``ats``); all but a stretch's first of each are repeats already."""
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches((b.filter(b.column(2).is_valid()) for b in batches), 1):
            ids, words = batch.column(0).to_numpy(), Words(batch.column(1))
            lists = batch.column(2)
            sizes = np.array(pa.compute.list_value_length(lists), dtype=np.int64)
            ats = words.first[np.repeat(np.arange(len(batch)), sizes)] + lists.flatten().to_numpy()
            marks = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            starts, rows, places = _within(words, window)
            if not len(starts):
                continue
            # an anchor at p lies in the windows that start at p - (window - length) ... p
            np.add.at(marks, np.maximum(ats - (window - length), 0), 1)
            np.add.at(marks, ats + 1, -1)
            near = np.cumsum(marks)[starts] > 0
            starts, rows, places = starts[near], rows[near], places[near]
            hashes = words.windows(window)[starts]
            order = np.lexsort((places, ids[rows]))
            hashes, rows, places = hashes[order], rows[order], places[order]
            docs_of = ids[rows]
            first, _ = _firsts(hashes)
            for kind, which in ((_ASK, first), (_ALWAYS, ~first)):
                if (out := pack(hashes[which], docs_of[which], places[which], kind, bits)) is not None:
                    yield out

    return docs.mapInArrow(run, PACKED)


def _repeats(packed: DataFrame) -> DataFrame:
    """doc, start: windows whose words also start earlier."""

    def work(hashes, docs, places, kinds) -> Iterator[pa.RecordBatch]:
        ask = kinds == _ASK
        h, d, p = hashes[ask], docs[ask], places[ask]
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        later = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
        start = np.flatnonzero(~later)
        always = np.flatnonzero(~ask)
        if len(always) and len(h):
            known = h[start]
            at = np.minimum(np.searchsorted(known, hashes[always]), len(known) - 1)
            s = start[at]
            always = always[~((hashes[always] == known[at]) & (docs[always] == d[s]) & (places[always] == p[s]))]
        yield _found((np.concatenate([d[later], docs[always]]), np.concatenate([p[later], places[always]])), "start")

    return by_bucket(packed, work, "doc long, start int")


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether each of n words is in a window that starts at one of ``starts``."""
    marks = np.zeros(n + 1, dtype=np.int64)
    starts = starts[starts + window <= n]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return np.cumsum(marks)[:n] > 0


def _keyed(docs: DataFrame, others: list[str]) -> DataFrame:
    """doc, text, id, null and ``_in_0``...: ``docs`` with a key of its own for each row, in the order of ids.

    The key is the id where no two rows share one (a null id counts as the smallest). Else rows are sorted by id,
    then text, and numbered; they are written, so that a lost executor doesn't number them anew."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    text = F.col("text").cast("string")
    rows = docs.select(id_.alias("doc"), F.coalesce(text, F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("id"), text.isNull().alias("null"), *[docs[c].alias(f"_in_{i}") for i, c in enumerate(others)])
    if rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows
    in_order = rows.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"), "text")
    return materialise(in_order.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def _starts(rows: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """doc, starts: where repeated windows start in the texts of ``rows`` that have any."""
    if window < PERIOD + 2:
        raise ValueError(f"windows need {PERIOD + 2} words or more")
    bits, rows = bucket_bits(docs), rows.select("doc", "text")
    ats = _repeated_anchors(_anchors(rows, window, bits)).groupBy("doc").agg(F.collect_list("at").alias("ats"))
    around = rows.join(ats.hint("shuffle_hash"), "doc", "left").select("doc", "text", "ats")
    return _repeats(_windows(around, window, bits)).groupBy("doc").agg(F.collect_list("start").alias("starts"))


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``id, text, starts``: every row's id and text with the starts of its repeated windows (null: none).

    docs: ``doc_id, text``; a null id is the smallest id, a null text has no words. Rows that share an id are
    documents of their own, in the order of their texts; of equal rows one is the first. An empty table gives
    no rows. Texts move by their key; entries move by hash after each stretch of input has kept one per hash,
    so a passage in a third of all documents meets in a task once per stretch, not once per document. The
    joins build on the starts of a partition's documents, a few bytes for a word of repeated text at most."""
    rows = _keyed(docs, [])
    own = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    if hasattr(rows, "_scratch"):
        own = F.col("id")
    else:  # both joins then read one exchange of the texts
        rows = rows.select("doc", "text")
    return rows.join(_starts(rows, docs, window).hint("shuffle_hash"), "doc", "left").select(own.alias("id"), "text", "starts")


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[int], list[bytes]]]:
    for batch in _stretches(batches, 1):
        words = Words(batch.column(1), keep_places=True)
        n_removed, kept = [], []
        for i, found in enumerate(batch.column(2)):
            a, n = int(words.first[i]), int(words.counts[i])
            mask = None if not found.is_valid else _covered(found.values.to_numpy(), n, window)
            begin, end = words.starts[a : a + n], words.ends[a : a + n]
            if mask is not None and mask.any():
                begin, end = begin[~mask], end[~mask]
            n_removed.append(n - len(begin))
            data = words.data
            kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))
        yield batch, words.counts.tolist(), n_removed, kept


def digest(found: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of what ``repeats`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n_words, n_removed, kept in _kept(batches, window):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (``doc_id, text`` and any other columns) with repeated passages cut out of ``text``.

    A text that loses words becomes its kept words, joined by one space; others stay as they are."""
    names = docs.columns
    others = [c for c in names if c != "text"]
    rows = _keyed(docs, others)
    joined = rows.join(_starts(rows, docs, window).hint("shuffle_hash"), "doc", "left").select("doc", "text", "starts", "null", *[f"_in_{i}" for i in range(len(others))])
    schema = joined.drop("starts").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, n_removed, kept in _kept(batches, window):
            texts = [x.decode() if n else t for x, n, t in zip(kept, n_removed, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], schema.names)

    out = joined.mapInArrow(run, schema)
    renamed = {"text": F.when(~F.col("null"), F.col("text"))} | {c: F.col(f"_in_{i}") for i, c in enumerate(others)}
    return out.select(*[renamed[c].alias(c) for c in names])

"""Moves (hash, document, place) entries between executors in few bytes.

Entries are dealt by the top bits of their hash into buckets; a row of the shuffle is the entries that one
stretch of input has for one bucket, as byte planes (bytes of equal weight together), which compress well.
A bucket's share of all entries is fixed by the number of buckets, which grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, kind int, n int, data binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])

#: Bytes of text per bucket, and the least number of bits that number buckets.
TEXT_PER_BUCKET, LEAST_BITS = 4 << 20, 8


def bucket_bits(docs: DataFrame) -> int:
    """Bits that number the buckets, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(LEAST_BITS, math.ceil(math.log2(max(1, total / TEXT_PER_BUCKET))))


def _planes(x: np.ndarray, keep: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :keep].T.tobytes()


def _unplane(data: memoryview, n: int, keep: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :keep] = np.frombuffer(data, dtype=np.uint8).reshape(keep, n).T
    return out.view("<u8").ravel()


def pack(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, kind: int, bits: int) -> pa.RecordBatch | None:
    """Rows of ``PACKED`` for entries in ascending order of document and place. hashes, docs: 64 bits; places: below 2**40."""
    if not len(hashes):
        return None
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    buckets, hashes, docs, places = buckets[order], hashes[order], docs[order].astype(np.int64), places[order]
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = docs[a:b].view(np.uint64)
        step = np.diff(part, prepend=np.uint64(0))
        rows.append(_planes(hashes[a:b], 8) + _planes(step, 8) + _planes(places[a:b], 5))
    return pa.RecordBatch.from_arrays([pa.array(buckets[edges[:-1]], pa.int32()), pa.array(np.full(len(rows), kind, np.int32)), pa.array(np.diff(edges), pa.int32()), pa.array(rows, pa.binary())], schema=_SCHEMA)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(data)
    hashes, steps, places = _unplane(view[: 8 * n], n, 8), _unplane(view[8 * n : 16 * n], n, 8), _unplane(view[16 * n :], n, 5)
    return hashes, np.cumsum(steps).view(np.int64), places.astype(np.int64)


def by_bucket(packed: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Calls ``work(hashes, docs, places, kinds)`` with all entries of each bucket; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def finish() -> Iterator[pa.RecordBatch]:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            for bucket, kind, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket != current and held:
                    yield from finish()
                    held = []
                current = bucket
                held.append((*unpack(data.as_py(), n), np.full(n, kind, dtype=np.int8)))
        if held:
            yield from finish()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)

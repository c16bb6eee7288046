"""Packing by power-of-two decomposition.

A document of n tokens becomes floor(n / limit) pieces of ``limit`` tokens and one piece for each binary
digit of the rest, longest first. Every piece is a sequence of its own whose length is a power of two, so
sequences of one length form a bucket from which batches are drawn, nothing is padded and no sequence
crosses documents (attention never sees another document's text).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct chunks remembered by a task, and the longest of them: about 50 MB at most.
CACHE_CHUNKS, KEPT_CHARS = 200_000, 48

_CUT = re.compile(r"(?<=\S) (?=\S)")
_AWKWARD = re.compile(r" \s|\s ")


class ChunkTokenizer:
    """Token ids as little-endian 32-bit bytes, those of the JSON tokenizer.

    The vocabulary's splitting pattern always begins a new word at a single space between two characters
    that aren't white space, so a text may be cut before such spaces and its chunks encoded apart: ids are
    the same, memory is bounded for very long texts, and repeated chunks are looked up. A text that holds the
    literal of an added token is encoded whole by the JSON tokenizer, which gives that token's id for it."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)

        def whole(text: str) -> list[int]:
            return model.encode(text, add_special_tokens=False).ids

        self.whole = self.ids_of = whole
        added = [token.content for token in model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ids_of = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def _learn(self, chunk: str) -> bytes:
        ids = self.ids_of(chunk)
        coded = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= KEPT_CHARS:
            if len(self.known) >= CACHE_CHUNKS:
                self.known.clear()
            self.known[chunk] = coded
        return coded

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added is not None and self.added.search(text):
            ids = self.whole(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = _CUT.split(text) if text[0].isspace() or _AWKWARD.search(text) else text.split(" ")
        # each chunk but the first keeps the space before it
        parts = parts[:1] + [" " + x for x in parts[1:]]
        get = self.known.get
        coded = [get(x) for x in parts]
        if None in coded:
            learn = self._learn
            coded = [learn(x) if c is None else c for x, c in zip(parts, coded, strict=True)]
        return b"".join(coded)


def pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens, longest first."""
    out = [(at, limit) for at in range(0, n - limit + 1, limit)]
    at = len(out) * limit
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """One row per sequence: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket``.

    docs: ``doc_id`` (integer) and ``text``; other columns are ignored whatever their names. limit: a power
    of two. ranks_path: the same vocabulary as ranks, if there is one;
    the ids are the same, found faster. A literal of an added token is that token, as the tokenizer has it by default. A null or empty text is one piece holding ``end_id`` alone; rows with equal doc_id are packed
    apart, each with sequences of its own. An empty table gives no rows. ``sequence_id`` is unique in a
    result; ``bucket`` is log2 of the length. It is one narrow pass: no shuffle, and a lost executor's
    partitions are simply read again."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = ChunkTokenizer(tokenizer_path, ranks_path)
        model, end = _TOKENIZERS[tokenizer_path], struct.pack("<I", end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(model.encode(text.as_py() or "") + end)
                n = len(ids) // 4
                rows += [(doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, k.bit_length() - 1) for s, k in pieces(n, limit)]
            if rows:
                kinds = (pa.int64(),) * 5 + (pa.int32(),)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"])
        model.known.clear()  # the worker lives on

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket")

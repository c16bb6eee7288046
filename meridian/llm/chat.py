"""Chat formatting with typed content parts.

A visitor flattens a turn's text, image, audio and document parts into one string: texts in place, every
attachment as a numbered placeholder in order, its reference and expanded token count recorded beside it.
Turns stand between control strings; control strings inside texts and roles are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A control string opens with "<|"; in texts, one backslash more stands between the two than in the original.
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<ordinal:int,kind:string,reference:string,tokens:long,at:long>>, expanded_tokens long"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one turn; ordinals go on through a conversation."""

    def __init__(self, ordinal: int = 0, patch: int = 14, audio_rate: float = 12.5, page_tokens: int = 256):
        self.ordinal, self.patch, self.audio_rate, self.page_tokens = ordinal, patch, audio_rate, page_tokens
        self.text: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def _put(self, piece: str) -> None:
        self.text.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, reference: str | None, tokens: float) -> None:
        self.ordinal += 1
        self.attachments.append({"ordinal": self.ordinal, "kind": kind, "reference": reference, "tokens": max(1, math.ceil(tokens)), "at": self.length})
        self._put(f"<|{kind}:{self.ordinal}|>")

    def visit(self, part: dict) -> None:
        kind = (part.get("type") or "text") if isinstance(part, dict) else None
        handler = getattr(self, f"visit_{kind}", None) if isinstance(kind, str) else None
        if handler is None:
            self._put(escape(part if isinstance(part, str) else json.dumps(part, ensure_ascii=False)))
        else:
            handler(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part.get("reference"), math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part.get("reference"), (part.get("seconds") or 0) * self.audio_rate)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part.get("reference"), (part.get("pages") or 0) * self.page_tokens)


def parts_of(content: str | None, text: str) -> list:
    """The parts of a turn: of its JSON list; a null list has none; JSON that isn't a list, or no JSON, is one text part."""
    if content is None:
        return [{"type": "text", "text": text}]
    try:
        found = json.loads(content)
    except ValueError:
        found = content
    return found if isinstance(found, list) else [] if found is None else [{"type": "text", "text": content}]


def format_turns(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row per turn, in order within its conversation: see ``FORMATTED``.

    turns: ``conv_id, turn, role, text``; other columns are ignored. parts_col: a string column holding a
    JSON list of typed parts, used where it isn't null, else the text is the only part. A JSON null is a list
    without parts; a part of an unknown type, and whatever isn't a JSON list, is text as it stands. ``loss_start`` and
    ``loss_end`` bound an assistant turn's content in ``formatted`` (null for other roles);
    ``expanded_tokens`` sums the turn's attachments. A null text is empty; a null role is an empty role;
    a null conversation id is a conversation; rows tied on turn are ordered by role, then text. An empty
    table gives no rows. Conversations are dealt by id and sorted on disk where they must be, then streamed:
    a task holds one batch of turns, however long its conversation."""
    parts = F.lit(None).cast("string") if parts_col is None else F.col(parts_col).cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), parts.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conversation, ordinal = object(), 0
        for batch in batches:
            out = []
            for conv, turn, role, text, parts in zip(batch.conv_id.astype("Int64"), batch.turn.astype("Int64"), batch.role, batch.text, batch.parts, strict=True):
                conv, turn = (None if x is pd.NA else int(x) for x in (conv, turn))
                if conv != conversation:
                    conversation, ordinal = conv, 0
                visitor = PartVisitor(ordinal)
                for part in parts_of(parts if isinstance(parts, str) else None, text):
                    visitor.visit(part)
                ordinal = visitor.ordinal
                head, content = f"{START}{escape_role(role)}\n", "".join(visitor.text)
                for x in visitor.attachments:
                    x["at"] += len(head)
                span = (len(head), len(head) + len(content)) if role == "assistant" else (None, None)
                out.append((conv, turn, f"{head}{content}{END}\n", *span, visitor.attachments, sum(x["tokens"] for x in visitor.attachments)))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]).astype({c: "Int64" for c in ("conv_id", "turn", "loss_start", "loss_end", "expanded_tokens")})

    return rows.mapInPandas(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses what ``format_turns`` made, as it lies, into one digest row per conversation (``DIGESTS``).

    The formatted strings of a conversation are read in order; roles and texts come from the template, the
    loss text from the mask. State is a few counters and two running hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def done() -> tuple:
            conv, n, turns, loss_chars, loss, chars = state
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            out = []
            for conv, piece, a, b in zip(batch.conv_id.astype("Int64"), batch.formatted, batch.loss_start.astype("Int64"), batch.loss_end.astype("Int64"), strict=True):
                conv = None if conv is pd.NA else int(conv)
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(piece):
                    head = piece.index("\n", at)
                    end = piece.index(END, head)
                    if piece[at : at + len(START)] != START or piece[end + len(END)] != "\n":
                        raise ValueError("not a formatted turn")
                    state[1] += 1
                    state[2].update(f"{unescape_role(piece[at + len(START) : head])}\n{unescape(piece[head + 1 : end])}\n".encode("utf-8", "surrogatepass"))
                    at = end + len(END) + 1
                if a is not pd.NA:
                    text = unescape(piece[a:b])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([done()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, DIGESTS)

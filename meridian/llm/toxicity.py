"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give a word's probability after the word before it, from three
orders: the pair, the word itself, and its stem (its first bytes), so that rare and unseen forms of known
expressions keep weight. Counts are continuation counts: in how many different documents a pair, word or
stem occurs, whatever its frequency there. Each order loses an absolute discount; the mass that frees backs
off to the next order, at the end to stem counts that both classes share. The classes also share the mass
that backs off, so what neither has evidence for counts for nothing.

What is compared is the length-normalised difference of the two log-likelihoods over a stretch of at least
two words, the most toxic one that a document has. Discount, stem and stretch length are those that tell the
classes apart best on labelled documents that no count has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from meridian.llm.words import PUNCTUATION, Words, mix

#: Labelled documents of each class that a model is fitted on at most: those with the smallest hash of their id.
MAX_DOCS = 20_000
#: What is chosen from, and the discount of pairs. Entries that occur in no more documents than the discount are lost to it.
DISCOUNTS, STEMS, STRETCHES, PAIR_DISCOUNT = (2.0, 5.0, 8.0, 12.0), (4, 5), (2, 3, 4), 12.0
#: Bytes of text worked on at once.
STEP = 4 << 20

_WORD, _PAIR = 0, 1
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out, fold 1 chooses, the rest count."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(2)).cast("int")


def pairs(words: Words) -> np.ndarray:
    """A hash of each word and the one before it; of a text's first word alone."""
    return mix(before(words) * _SHIFT + words.hashes)


def before(words: Words) -> np.ndarray:
    """The hash of the word before each word; 0 for a text's first."""
    out = np.concatenate([np.zeros(1, np.uint64), words.hashes[:-1]])[: len(words.hashes)]
    out[words.first[words.counts > 0]] = 0
    return out


@dataclass
class Order:
    """Sorted hashes with, for each class (toxic, ordinary), in how many documents they occur; each class's total and
    the mass that each discount frees, shared by the classes."""

    keys: np.ndarray
    counts: np.ndarray
    totals: np.ndarray
    freed: dict[float, float]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, or the last one's (an entry of zeros) where it isn't known."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, at, len(self.keys))

    def kept(self, discount: float) -> np.ndarray:
        """Discounted relative counts, a column for each class, with a last row of zeros."""
        return np.vstack([np.maximum(self.counts - discount, 0) / self.totals, np.zeros(2)])

    def shares(self) -> np.ndarray:
        """What both classes back off to: the mean of their relative counts."""
        return np.append((self.counts / self.totals).mean(axis=1), 0.5 / self.totals.sum())

    def without(self, discount: float) -> Order:
        """Leaves out entries that this discount takes whole: they say the same of both classes."""
        which = self.counts.max(axis=1) > discount if len(self.keys) else np.empty(0, bool)
        return Order(self.keys[which], self.counts[which], self.totals, self.freed)


@dataclass
class Pairs:
    """Pairs that the discount leaves something of: their probabilities before backing off, by class, and the mass that their
    context frees. Any other pair is worth its word: the classes share the freed mass, so it cancels."""

    keys: np.ndarray
    kept: np.ndarray
    freed: np.ndarray


@dataclass
class Model:
    """pairs, words, stems (by stem length): the orders; the rest is chosen."""

    pairs: Pairs
    words: Order
    stems: dict[int, Order]
    discount: float = 5.0
    stem: int = 5
    stretch: int = 2
    threshold: float = 3.0
    slope: float = 1.0
    tables: dict = field(default_factory=dict)

    def ratios(self, words: Words, stem: int, discount: float) -> np.ndarray:
        """Log of toxic over ordinary probability of each word."""
        if (stem, discount) not in self.tables:
            lower = self.stems[stem]
            back = lower.kept(discount) + lower.freed[discount] * lower.shares()[:, None]
            self.tables[stem, discount] = self.words.kept(discount), back * self.words.freed[discount]
        upper, back = self.tables[stem, discount]
        p = upper[self.words.find(words.hashes)] + back[self.stems[stem].find(words.stems)]
        if len(self.pairs.keys):
            wanted = pairs(words)
            at = np.searchsorted(self.pairs.keys, wanted)
            at[at == len(self.pairs.keys)] = 0
            known = np.flatnonzero(self.pairs.keys[at] == wanted)
            at = at[known]
            p[known] = self.pairs.kept[at] + self.pairs.freed[at, None] * p[known]
        return np.log(p[:, 0] / p[:, 1])

    def chosen(self) -> Model:
        """What scoring needs of the model."""
        return replace(self, words=self.words.without(self.discount), stems={self.stem: self.stems[self.stem].without(self.discount)}, tables={})


def stretches(ratios: np.ndarray, first: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Each text's largest mean over ``length`` successive words (shorter texts: as if padded by zeros); 0 without words."""
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    out = np.zeros(len(first))
    short = (counts > 0) & (counts <= length)
    out[short] = (sums[first + counts] - sums[first])[short] / length
    full = np.flatnonzero(counts > length)
    if len(full):
        runs = (sums[length:] - sums[:-length]) / length
        edges = np.empty(2 * len(full), dtype=np.int64)
        edges[0::2], edges[1::2] = first[full], first[full] + counts[full] - length + 1
        if edges[-1] == len(runs):
            edges = edges[:-1]
        out[full] = np.maximum.reduceat(runs, edges)[0::2]
    return out


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text column has about ``STEP`` bytes, at least a row each."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            stop = min(len(texts), max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + STEP, "right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


def _count(labelled: DataFrame) -> DataFrame:
    """kind (words, pairs, else stem length), key, context, toxic, ordinary: in how many documents a hash occurs, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 0):
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for kind in (_WORD, _PAIR, *STEMS):
                words = Words(batch.column(0), lower=True, separators=PUNCTUATION, stem=kind if kind > _PAIR else 0)
                keys = words.stems if kind > _PAIR else pairs(words) if kind == _PAIR else words.hashes
                context = before(words) if kind == _PAIR else np.zeros(len(keys), np.uint64)
                docs = np.repeat(np.arange(len(batch)), words.counts)
                if kind == _PAIR:
                    inner = context > 0
                    keys, context, docs = keys[inner], context[inner], docs[inner]
                if not len(keys):
                    continue
                order = np.lexsort((keys, docs))
                keys, context, docs = keys[order], context[order], docs[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
                found, at, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
                side = toxic[docs[new]]
                n = [np.bincount(inverse[side == x], minlength=len(found)) for x in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.view(np.int64)), pa.array(context[new][at].view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], ["kind", "key", "context", "toxic", "ordinary"])

    counted = labelled.select("text", "toxic").mapInArrow(run, "kind int, key long, context long, toxic long, ordinary long")
    return counted.groupBy("kind", "key", "context").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``text, toxic, fold`` of labelled documents outside fold 0, at most ``max_docs`` of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    chosen = None
    for side in (True, False):
        part = known.where(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * max_docs rows of 9 bytes are sent round
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", fold(F.col("doc_id")).alias("fold"))


def _counts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([rows[c].to_numpy() for c in ("toxic", "ordinary")], axis=1).astype(float)[order], order


def _pairs(counted: DataFrame) -> Pairs:
    """The pairs that occur in more documents of a class than the discount, each with its context's totals."""
    all_ = counted.where(F.col("kind") == _PAIR)
    kept = all_.where(F.greatest("toxic", "ordinary") > PAIR_DISCOUNT)
    freed = sum(F.sum(F.least(F.col(c), F.lit(PAIR_DISCOUNT))) for c in ("toxic", "ordinary"))
    contexts = all_.join(kept.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.sum("toxic").alias("toxic_total"), F.sum("ordinary").alias("ordinary_total"), freed.alias("freed"))
    rows = kept.join(contexts, "context").select("key", "toxic", "ordinary", "toxic_total", "ordinary_total", "freed").toArrow()
    keys, counts, order = _counts(rows)
    totals = np.stack([rows[c].to_numpy() for c in ("toxic_total", "ordinary_total")], axis=1).astype(float)[order]
    return Pairs(keys, np.maximum(counts - PAIR_DISCOUNT, 0) / np.maximum(totals, 1), rows["freed"].to_numpy()[order] / np.maximum(totals.sum(axis=1), 1))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """The model, or None where either class has no labelled document with words.

    The sample of at most ``max_docs`` labelled documents a class bounds the model; no n-gram that a discount
    leaves something of is dropped."""
    labelled = sample(docs, labels, max_docs).persist()
    counted = _count(labelled.where("fold <> 1")).persist()
    freed = [F.sum(F.least(F.col(c), F.lit(d))).alias(f"{c}_{d}") for c in ("toxic", "ordinary") for d in DISCOUNTS]
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), *freed).collect()}
    model = None
    if _WORD in sums and sums[_WORD]["toxic"] and sums[_WORD]["ordinary"]:
        orders = {}
        for kind in (_WORD, *STEMS):
            keys, counts, _ = _counts(counted.where((F.col("kind") == kind) & (F.greatest("toxic", "ordinary") > min(DISCOUNTS))).select("key", "toxic", "ordinary").toArrow())
            totals = np.array([sums[kind]["toxic"], sums[kind]["ordinary"]], dtype=float)
            orders[kind] = Order(keys, counts, totals, {d: float(np.mean([sums[kind][f"{c}_{d}"] / totals[i] for i, c in enumerate(("toxic", "ordinary"))])) for d in DISCOUNTS})
        model = _choose(Model(_pairs(counted), orders[_WORD], {k: orders[k] for k in STEMS}), labelled.where("fold = 1"))
    counted.unpersist()
    labelled.unpersist()
    return model


def _choose(model: Model, labelled: DataFrame) -> Model:
    """Sets what tells the classes apart best on ``labelled``: the mean share found while 0.2 to 4 % of ordinary texts score more.

    The threshold then has the least misses plus three times false alarms, as shares of their class. It is above 0, the
    ratio of a text without evidence."""
    choices = [(d, s, k) for d in DISCOUNTS for s in STEMS for k in STRETCHES]
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in _parts(batches, 0):
            found = {}
            for s in STEMS:
                words = Words(batch.column(0), lower=True, separators=PUNCTUATION, stem=s)
                for d in DISCOUNTS:
                    ratios = known.ratios(words, s, d)
                    for k in STRETCHES:
                        found[d, s, k] = stretches(ratios, words.first, words.counts, k)
            rows = np.stack([found[c] for c in choices], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "values"])
        known.tables.clear()

    rows = labelled.select("text", "toxic").mapInArrow(run, "toxic boolean, values array<double>").toArrow()
    toxic = np.array(rows["toxic"].to_pylist(), dtype=bool)
    if toxic.any() and not toxic.all():
        values = np.array(rows["values"].to_pylist())
        best = None
        for choice, column in zip(choices, values.T, strict=True):
            yes, no = np.sort(column[toxic]), np.sort(column[~toxic])
            above = no[::-1][(np.linspace(0.002, 0.04, 20) * len(no)).astype(int)]
            found = 1 - np.searchsorted(yes, above, "right").mean() / len(yes)
            if best is not None and found <= best[0]:
                continue
            cuts = np.unique(column)
            at = int((np.searchsorted(yes, cuts) / len(yes) + 3 * (1 - np.searchsorted(no, cuts) / len(no))).argmin())
            below = no[max(0, np.searchsorted(no, cuts[at]) - 1)]
            middle = (cuts[at] + max(below, cuts[at - 1] if at else below)) / 2
            best = found, choice, max(0.01, float(middle)), float(np.median(yes))
        _, (model.discount, model.stem, model.stretch), model.threshold, typical = best
        model.slope = float(np.log(19) / max(typical - model.threshold, 0.05))
    sent.unpersist()
    return model.chosen()


def score(docs: DataFrame, model: Model | None, columns: list[str] | None = None, keep_below: float | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_ratio`` (the most toxic stretch's mean log ratio) after ``columns``.

    A column of ``docs`` with one of these names stays; the new one's name is then made longer by underscores.
    keep_below: leaves out rows that score this or more and adds no columns. A null or empty text has the ratio
    0 of no evidence, so a score below a half unless the threshold is below 0; without a model every score is
    0. One narrow pass; the model, bounded by the sample it was fitted on, is sent round once."""
    columns = columns if columns is not None else docs.columns
    rows = docs.select(*[docs[c] for c in columns])
    fields, names = list(rows.schema.fields), []
    for name in () if keep_below is not None else ("toxicity", "toxic_ratio"):
        while name in columns or name in names:
            name += "_"
        names.append(name)
    if model is None:
        return rows.withColumns({c: F.lit(0.0) for c in names})
    # the text moves once: as the column it is, or as one more where it isn't a string or isn't returned
    at = next((i for i, f in enumerate(fields) if f.name == "text" and f.dataType.simpleString() == "string"), None)
    if at is None:
        hidden = "_text"
        while hidden in columns:
            hidden += "_"
        rows, at = docs.select(*[docs[c] for c in columns], F.col("text").cast("string").alias(hidden)), len(fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*fields, *(StructField(c, DoubleType()) for c in names)])
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in _parts(batches, at):
            words = Words(batch.column(at), lower=True, separators=PUNCTUATION, stem=known.stem)
            ratio = stretches(known.ratios(words, known.stem, known.discount), words.first, words.counts, known.stretch)
            value = 1 / (1 + np.exp(-np.clip(known.slope * (ratio - known.threshold), -500, 500)))
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(value), pa.array(ratio)], schema.names)
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[:n], schema.names).filter(pa.array(value < keep_below))

    return rows.mapInArrow(run, schema)

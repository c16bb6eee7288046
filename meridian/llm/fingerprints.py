"""Document fingerprints as invertible Bloom lookup sketches, in SQL functions only.

A text's units are its paragraphs (lines), cut after sentence ends. Each unit's 44-bit digest, with a 16-bit
check that depends on it in no linear way, is added to one cell of each of three subtables; a cell keeps
how many entries it has and their exclusive or. The cells of two versions subtract; peeling cells that hold
one entry recovers the digests that differ, and with them how alike the versions are. Where peeling fails,
a larger sketch is tried: first of the whole sets, then by shards of the digest space, then by shards with
more cells, last (a shard that still resists) the sets themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of each of the three subtables: in a fingerprint and at the first try, and when a shard is tried again.
WIDTH, WIDER = 5, 17
#: Units a shard has on average, both versions together, and the most bits that number shards.
PER_SHARD, SHARD_BITS = 6, 14
#: Documents in one stretch of the id order, and the most stretches.
STRETCH, STRETCHES = 4096, 2048


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _units(text: str) -> str:
    key = "CAST(conv(substring(md5(CAST(u AS BINARY)), 1, 11), 16, 10) AS BIGINT)"
    entry = _let("k", key, "k * 65536L + ((k % 65521L) * (k % 32749L)) % 65536L")
    return rf"array_distinct(transform(filter(split(regexp_replace({text}, '([.!?]) ', '$1\n'), '\n'), u -> u <> ''), u -> {entry}))"


def _mask(entry: str, width: int) -> str:
    """One bit for each of the entry's three cells; ten bits of the digest tell its cell of a subtable."""
    return "(" + " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned({entry}, {16 + 10 * j}) % 1024L % {width}L AS INT) + {j * width})" for j in range(3)) + ")"


def _cells(units: str, width: int) -> str:
    zero = "named_struct('n', 0, 'x', 0L)"
    masked = f"transform({units}, e -> named_struct('x', e, 'm', {_mask('e', width)}))"
    return _let("masked", masked, f"transform(sequence(0, {3 * width - 1}), c -> aggregate(filter(masked, u -> getbit(u.m, c) = 1Y), {zero}, (a, u) -> named_struct('n', a.n + 1, 'x', a.x ^ u.x)))")


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x))"


def _peel(cells: str, width: int) -> str:
    """How many entries differ, or null where peeling stops before all cells are empty."""
    key = "shiftrightunsigned(d.x, 16)"
    pure = f"abs(d.n) = 1 AND d.x > 0 AND d.x % 65536L = (({key} % 65521L) * ({key} % 32749L)) % 65536L AND getbit({_mask('d.x', width)}, i) = 1Y"
    keys = f"array_distinct(filter(transform(s.cells, (d, i) -> CASE WHEN {pure} THEN named_struct('n', d.n, 'x', d.x, 'm', {_mask('d.x', width)}) END), d -> d IS NOT NULL))"
    less = f"transform(s.cells, (d, i) -> aggregate(filter(keys, k -> getbit(k.m, i) = 1Y), d, (a, k) -> named_struct('n', a.n - k.n, 'x', a.x ^ k.x)))"
    step = _let("keys", keys, f"CASE WHEN size(keys) = 0 THEN named_struct('cells', s.cells, 'found', s.found, 'over', true) ELSE named_struct('cells', {less}, 'found', s.found + size(keys), 'over', false) END")
    start = f"named_struct('cells', {cells}, 'found', 0, 'over', false)"
    return f"aggregate(sequence(1, {3 * width}), {start}, (s, r) -> CASE WHEN s.over THEN s ELSE {step} END, s -> CASE WHEN forall(s.cells, d -> d.n = 0 AND d.x = 0L) THEN s.found END)"


def _shards(units: str) -> str:
    """The units by the top ``bits`` of their digests, in two steps so that no unit is looked at by every shard."""
    group = "shiftrightunsigned(e, CAST(60 - half AS INT)) = g"
    within = "shiftrightunsigned(e, CAST(60 - bits AS INT)) % shiftleft(1L, bits - half) = h"
    inner = _let("part", f"filter({units}, e -> {group})", f"transform(sequence(0L, shiftleft(1L, bits - half) - 1L), h -> filter(part, e -> {within}))")
    return f"flatten(transform(sequence(0L, shiftleft(1L, half) - 1L), g -> {inner}))"


def _differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """Number of digests in one set only, found by peeling; columns ``a`` and ``b`` are unit arrays."""
    whole = f"CASE WHEN abs(size({a}) - size({b})) <= {2 * WIDTH} THEN {_peel(_subtract(cells_a, cells_b), WIDTH)} END"
    exact = "size(array_except(p, q)) + size(array_except(q, p))"
    tries = [_peel(_subtract(_cells("p", w), _cells("q", w)), w) for w in (WIDTH, WIDER)]
    shard = f"CASE WHEN size(p) = 0 OR size(q) = 0 THEN size(p) + size(q) ELSE coalesce({tries[0]}, {tries[1]}, {exact}) END"
    bits = f"CAST(greatest(0, least({SHARD_BITS}, ceil(log2((size({a}) + size({b})) / {PER_SHARD}D)))) AS INT)"
    sharded = _let("bits", bits, _let("half", "(bits + 1) div 2", f"aggregate(zip_with({_shards(a)}, {_shards(b)}, (p, q) -> {shard}), 0, (n, d) -> n + d)"))
    return f"coalesce({whole}, {sharded})"


def _likeness(a: str, b: str, differing: str) -> str:
    """Shared over all digests: (sizes - differing) / (sizes + differing); 1 for two texts without units."""
    sizes = f"(size({a}) + size({b}))"
    return f"CASE WHEN {sizes} = 0 THEN 1.0D ELSE ({sizes} - {differing}) / CAST({sizes} + {differing} AS DOUBLE) END"


def _hex(cells: str) -> str:
    return f"array_join(transform({cells}, d -> concat(lpad(hex(d.n), 6, '0'), lpad(hex(d.x), 15, '0'))), '')"


def _spans(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Cuts of the id order into stretches of about equal numbers of documents."""
    n = docs.agg(F.count(F.lit(1))).first()[0]
    cuts = max(0, min(STRETCHES, n // STRETCH) - 1)
    if not cuts:
        return docs, F.lit(0)
    at = [round((k + 1) / (cuts + 1), 9) for k in range(cuts)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] or []
    return docs, F.size(F.filter(F.array(*[F.lit(int(x)) for x in sorted(set(bounds))]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each document beside the next in ascending id (after the last, the first).

    Documents move once, by stretches of the id order; the last of a stretch looks up the first of the next
    among as many texts as there are stretches."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, stretch = _spans(docs)
    rows = docs.withColumn("stretch", stretch)
    firsts = rows.groupBy("stretch").agg(F.min("doc_id").alias("doc_id"))
    first_texts = docs.join(F.broadcast(firsts), docs["doc_id"].eqNullSafe(firsts["doc_id"])).select("stretch", "text").groupBy("stretch").agg(F.min("text").alias("text"))
    order = Window.partitionBy(F.lit(0)).orderBy("stretch")
    after = first_texts.select("stretch", F.coalesce(F.lead("text").over(order), F.first("text").over(order)).alias("after_text"))
    here = Window.partitionBy("stretch").orderBy("doc_id", "text")
    return rows.withColumn("lead_text", F.lead("text").over(here)).join(after, "stretch", "left").select("doc_id", "text", F.coalesce("lead_text", "after_text").alias("next_text"))


def likeness(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Adds ``out``: how alike the fingerprints of two text columns are (0 to 1), 1 for equal unit sets."""
    pairs = pairs.withColumns({"_ua": F.expr(_units(left)), "_ub": F.expr(_units(right))})
    pairs = pairs.withColumns({"_ca": F.expr(_cells("_ua", WIDTH)), "_cb": F.expr(_cells("_ub", WIDTH))})
    pairs = pairs.withColumn("_d", F.expr(_differing("_ua", "_ub", "_ca", "_cb")))
    return pairs.withColumn(out, F.expr(_likeness("_ua", "_ub", "_d"))).drop("_ua", "_ub", "_ca", "_cb", "_d")


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column: the cells of its sketch in hexadecimal."""
    return F.expr(_hex(_cells(_units(text), WIDTH)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half comes from the next document.

    docs: ``doc_id, text``; other columns are ignored. A null text is empty; a text without units has a
    sketch of empty cells and is alike only to another such; documents tied on id are taken in the order of
    their texts; a sole document is its own next; an empty table gives no rows."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 2 AS INT)), substring(next_text, 1, CAST(n_chars div 2 AS INT)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(_units("text")).alias("ut"), F.expr(_units("edited")).alias("ue"), F.expr(_units("next_text")).alias("un"))
    rows = rows.withColumns({f"c{x}": F.expr(_cells(f"u{x}", WIDTH)) for x in "ten"})
    rows = rows.withColumns({"de": F.expr(_differing("ut", "ue", "ct", "ce")), "dn": F.expr(_differing("ut", "un", "ct", "cn"))})
    return rows.select("doc_id", "n_chars", "edited_sha256", F.expr(_hex("ct")).alias("fingerprint"), F.expr(_hex("ce")).alias("edited_fingerprint"), F.expr(_likeness("ut", "ue", "de")).alias("near_edited"), F.expr(_likeness("ut", "un", "dn")).alias("near_next"))

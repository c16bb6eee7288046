"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words; each of its documents an expected number of copies. The whole
part of that number is certain. The rest is an inclusion probability p: documents are ranked by their
random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and taken in that order until the
words still due are met, so a source's sample has a fixed size. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridian.llm.common import WORD_PATTERN, materialise

#: Ranks are first counted in this many equal slices; only the slice where a source's sample ends is sorted.
SLICES = 4096


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet, keeping the left side's keys."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fill(table: DataFrame, within: list[str], size: str, weight: str, total: str, most: float, order: list[Column]) -> DataFrame:
    """Adds ``target``: ``total`` shared by weight, none above ``most`` times its size, the excess reshared.

    With rows in order of cap / weight, the level is the largest of (total - caps so far) / weights left."""
    cap = F.col(size) * F.lit(float(most))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    in_order = w.orderBy(cap / F.col(weight), *order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_rest", F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))).withColumn("_left", F.sum(weight).over(w) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    table = table.withColumn("_level", F.max(F.col("_rest") / F.col("_left")).over(w))
    return table.withColumn("target", F.least(cap, F.col("_level") * F.col(weight))).drop("_rest", "_left", "_level")


def uniform(seed: str, key: Column) -> Column:
    """A reproducible number between 0 and 1 for a key, from its MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where nothing is left to chance."""
    return F.when(p > 0, (u / (1.0 - u)) / (p / (1.0 - p)))


def _classes(docs: DataFrame, weight_col: str | None) -> Column:
    """Weight classes, eight to a doubling, so that their number is bounded."""
    return F.lit(0) if weight_col is None else F.coalesce(F.round(F.log2(F.greatest(F.col(weight_col).cast("double"), F.lit(1e-6))) * 8), F.lit(0.0)).cast("int")


def _keyed(docs: DataFrame, weight_col: str | None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _classes(docs, weight_col).alias("class"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", weight_col: str | None = None) -> DataFrame:
    """A row per source and weight class: what decides how often each document is taken.

    Sources in code point order, null last, weigh ``weights``, repeating. weight_col: expected copies within
    a source are in proportion to this positive number (null: 1), at most ``most``. The table has as many
    rows as there are sources times weight classes."""
    sized = materialise(_keyed(docs, weight_col), "sizes")
    per_class = sized.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    per_source = per_class.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    per_source = per_source.withColumn("weight", weigh).withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)))
    per_source = fill(per_source, [], "source_size", "weight", "total", most, [F.col("source").asc_nulls_last()]).select("source", "source_size", F.col("target").alias("source_target"))
    plan = _join(per_class, per_source, ["source"])
    if weight_col is None:
        plan = plan.withColumn("target", F.col("source_target"))
    else:
        plan = plan.withColumn("pull", F.greatest(F.col("class_size"), F.lit(1)) * F.pow(F.lit(2.0), F.col("class") / 8.0))
        plan = fill(plan, ["source"], "class_size", "pull", "source_target", most, [F.col("class").asc()]).drop("pull")
    copies = F.when(F.col("class_size") > 0, F.least(F.col("target") / F.col("class_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.col("whole"))
    plan = materialise(plan.select("source", "class", "class_size", "source_size", "source_target", "whole", "p"), "mix-rates")

    ranked = _join(sized, plan.select("source", "class", "p"), ["source", "class"]).select("source", "doc_id", "size", _rank(uniform(seed, F.col("doc_id")), F.col("p")).alias("rank")).where("rank IS NOT NULL")
    ranked = ranked.withColumn("slice", F.floor(F.col("rank") / (F.col("rank") + 1.0) * SLICES).cast("int"))
    due = plan.groupBy("source").agg(F.sum(F.col("p") * F.col("class_size")).alias("due"))
    slices = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    last = _join(slices, due, ["source"]).where((F.col("before") < F.col("due")) & (F.col("before") + F.col("words") >= F.col("due"))).select("source", "slice", "before", "due")
    near = _join(ranked, last, ["source", "slice"])
    # documents before the last slice are taken whatever the last slice gives: the cut never falls below its start
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("half", F.col("before") + F.sum("size").over(in_order) - F.col("size") / 2.0)
    edge = F.struct("rank", "doc_id", "size")
    cut = near.groupBy("source").agg(F.max(F.when(F.col("half") <= F.col("due"), edge)).alias("cut"), F.min(edge).alias("start"))
    cut = cut.select("source", F.col("cut.rank").alias("cut_rank"), F.col("cut.doc_id").alias("cut_doc"), F.col("cut.size").alias("cut_size"), F.col("start.rank").alias("start_rank"))
    return materialise(_join(plan, cut, ["source"], "left"), "mix-plan")


def _taken(docs: DataFrame, plan: DataFrame, seed: str, weight_col: str | None) -> DataFrame:
    """``_in_0``... (the columns of ``docs``), ``size, source_size, target, copies``: how often the mix takes each row.

    The plan has a row per source, so the documents don't move where it is small enough to send round."""
    plan = plan.select(*[F.col(c).alias(f"plan_{c}") for c in plan.columns])
    inner = [f"_in_{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, inner, strict=True)], word_count(F.col("text")).alias("size"), _classes(docs, weight_col).alias("class"), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc"))
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("class") == F.col("plan_class")))
    rank = _rank(uniform(seed, F.col("doc")), F.col("plan_p"))
    here = F.struct(rank.alias("rank"), F.col("doc").alias("doc_id"), "size")
    cut = F.struct(F.col("plan_cut_rank").alias("rank"), F.col("plan_cut_doc").alias("doc_id"), F.col("plan_cut_size").alias("size"))
    taken = rank.isNotNull() & F.when(F.col("plan_cut_rank").isNotNull(), here <= cut).otherwise(F.coalesce(rank < F.col("plan_start_rank"), F.lit(False)))
    return joined.select(*inner, "size", F.col("plan_source_size").alias("source_size"), F.col("plan_source_target").alias("target"), (F.col("plan_whole") + taken.cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", weight_col: str | None = None) -> DataFrame:
    """Every row of ``docs`` once, with how often it is taken: ``mix_size, mix_source_size, mix_target, mix_copies``.

    docs: ``doc_id, source, text`` and any other columns, which pass through; a new column whose name ``docs``
    has already gets underscores after it. A null or empty text has size 0; a null source is a source of its
    own, last in order; a source without words has target 0 and none of its rows is taken beyond nothing. Rows
    equal in id, source and size are taken alike. An empty table gives an empty one. The same rows and seed
    give the same copies whatever the partitioning."""
    out = _taken(docs, mix_plan(docs, weights, share, most, seed, weight_col), seed, weight_col)
    names = list(docs.columns)
    for name in ("mix_size", "mix_source_size", "mix_target", "mix_copies"):
        while name in names:
            name += "_"
        names.append(name)
    return out.toDF(*names)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1", weight_col: str | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    out = _taken(docs, mix_plan(docs, weights, share, most, seed, weight_col), seed, weight_col).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Unit cases of the relational and analytic operators."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridian.config import DEFAULT
from meridian.functions import identity
from meridian.operators import asof, encode, linkage, metrics, profile, queue, ranks


def one(frame, column):
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("Mr. Mohan BASHA", "mohan basha"), (None, ""), ("Smt Anitha  Rao.", "anitha rao")])
def test_names(spark, name, want):
    assert one(spark.createDataFrame([(name,)], "n string"), identity.normal_name(F.col("n"))) == want


@pytest.mark.parametrize(("phone", "want", "last"), [("+91 99836-09751", "9983609751", "9751"), ("9751", "9751", "9751"), (None, "", ""), ("XXXXXX5988", "5988", "5988"), ("12", "12", "")])
def test_phones(spark, phone, want, last):
    rows = spark.createDataFrame([(phone,)], "p string")
    assert one(rows, identity.normal_phone(F.col("p"))) == want and one(rows, identity.last4(F.col("p"))) == last


@pytest.mark.parametrize(("a", "b", "want"), [("mohn laxman", "mohan laxman", 0.875), ("a b", "a", 0.5), ("", "x", 0.0), ("rao x", "raa x", 0.5)])
def test_name_similarity(spark, a, b, want):
    records = spark.createDataFrame([("s", "1", a, "x1234", "v", "f", 1)], "source_system string, source_id string, name string, mobile string, village string, gender string, age int")
    entities = spark.createDataFrame([(1, b, "1234", "v", "f", 1)], "entity_id long, name string, phone4 string, village string, gender string, age int")
    assert linkage.scored(records, entities).first()["name_s"] == pytest.approx(want)


def test_village_and_age_similarity(spark):
    rows = spark.createDataFrame([("kondamallepalli", "kondamallepally"), ("abcd", "abce"), ("x", "x"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(identity.village_similarity(F.col("a"), F.col("b"))).collect()] == [0.9, 0.0, 1.0, 0.0]
    ages = spark.createDataFrame([(30, 30), (30, 32), (30, 35), (30, 36), (None, 3)], "a int, b int")
    assert [r[0] for r in ages.select(identity.age_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.25, 0.0, 0.0]


def test_decisions(spark):
    rows = spark.createDataFrame([(0.95, 0.06), (0.95, 0.04), (0.80, 0.13), (0.60, 0.25), (0.60, 0.10)], "score double, margin double").withColumns({"p4": F.lit("1"), "e_p4": F.lit("1"), "phone": F.lit(1.0), "name_s": F.lit(0.5)})
    assert [r["confidence"] for r in linkage.decide(rows).collect()] == ["high", "none", "medium", "low", "none"]
    assert [r["confidence"] for r in linkage.decide(rows.withColumn("name_s", F.lit(0.4))).collect()] == ["none"] * 5


def test_crosswalk_has_one_row_per_source_id(spark):
    rows = spark.createDataFrame([("s", "1", 1, 10, 0.9, "medium"), ("s", "1", 1, 11, 0.8, "high"), ("s", "2", 0, None, 0.0, "none")], "source_system string, source_id string, matched int, entity_id int, match_score double, confidence string")
    assert [tuple(r) for r in linkage.crosswalk(rows).collect()] == [("s", "1", 11, "high")]


def registers(spark, copies=1, seed=5):
    """Records and entities of few distinct values, some of them missing; every entity ``copies`` times under other ids."""
    import random

    deal = random.Random(seed)
    names = ["mohan basha", "mohn basha", "anitha rao", "anita rao", "rao", "mo li", "", None, "anitha anitha", "basha mohan rao"]
    phones, villages = ["1234", "5678", "0000", None, ""], ["kondapur", "kondapurr", "vil", "", None]
    pick = lambda *more: (deal.choice(names), *more, deal.choice(villages), deal.choice(["f", "m", None]), deal.choice([30, 31, 34, 60, None]))
    records = spark.createDataFrame([("s", str(i), *pick(deal.choice(["1234", "x5678", "9999", None]))) for i in range(150)], "source_system string, source_id string, name string, mobile string, village string, gender string, age int")
    rows = [pick(deal.choice(phones)) for _ in range(80)]
    entities = spark.createDataFrame([(i + 1000 * k, *row) for k in range(copies) for i, row in enumerate(rows)], "entity_id long, name string, phone4 string, village string, gender string, age int")
    return records, entities


@pytest.mark.parametrize(("cap", "weights"), [(300, (0.45, 0.35, 0.12, 0.05, 0.03)), (5, (0.45, 0.1, 0.1, 0.1, 0.1)), (0, (0.2, 0.1, 0.1, 0.3, -0.2))])
def test_best_is_that_of_all_pairs(spark, cap, weights):
    records, entities = registers(spark, copies=2)
    settings = replace(DEFAULT, candidate_cap=cap, weights=weights)
    order = Window.partitionBy("identity").orderBy(F.desc("score"), "entity_id")
    want = linkage.scored(records, entities, settings).select("identity", "entity_id", "score", F.row_number().over(order).alias("rn"), F.coalesce(F.lead("score").over(order), F.lit(0.0)).alias("runner_up")).where("rn = 1").drop("rn")
    found = linkage.best(records, entities, settings).select("identity", "entity_id", "score", "runner_up")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_best_compares_distinct_values(spark):
    met = []
    for copies in (2, 6):
        records, entities = registers(spark, copies)
        ids, known = linkage._sides(records, entities)
        routed, (by_phone, by_name) = linkage._routed(ids, known), linkage._placed(known)
        questions = linkage._questions(routed, known)
        pairs = linkage._phone_pairs(questions, by_phone).unionByName(linkage._name_pairs(questions, known, by_name, 10000))
        met.append((pairs.count(), linkage._hopeful(pairs, DEFAULT).count()))
    assert met[0] == met[1] and met[0][1] < met[0][0]


def test_best_meets_near_ages_and_equal_genders(spark):
    """Many genders and ages in one group: an identity meets those near its own, with the same best two; texts are normalised once."""
    schema = "entity_id long, name string, phone4 string, village string, gender string, age int"
    records = spark.createDataFrame([("s", str(i), "anitha rao", "1234", "vil", g, a) for i, (g, a) in enumerate([("g3", 7), ("g0", None), (None, 29), ("other", 99)])], "source_system string, source_id string, name string, mobile string, village string, gender string, age int")
    met = []
    for n in (12, 24):
        entities = spark.createDataFrame([(a * n + g, "anitha rao", "1234", "vil", f"g{g}", a) for g in range(n) for a in range(n)], schema)
        ids, known = linkage._sides(records, entities)
        placed = linkage._numbered(linkage._placed(known)[0])
        met.append(linkage._met(ids.crossJoin(placed.select("gid").distinct()), placed, DEFAULT).count())
        order = Window.partitionBy("identity").orderBy(F.desc("score"), "entity_id")
        want = linkage.scored(records, entities).select("identity", "entity_id", "score", F.lead("score").over(order).alias("runner_up"), F.row_number().over(order).alias("rn")).where("rn = 1").drop("rn")
        assert sorted(map(tuple, linkage.best(records, entities).select("identity", "entity_id", "score", "runner_up").collect())) == sorted(map(tuple, want.collect()))
    assert max(met) <= 4 * (4 + 4 * 3 * linkage.BUCKET)
    assert "regexp" not in linkage.audit(records, entities)._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_candidates(spark):
    for cap in (0, 20, 300):
        records, entities = registers(spark, copies=2)
        ids, known = linkage._sides(records, entities)
        want = linkage.candidates(ids, known, cap).groupBy("identity", "via").agg(F.count(F.lit(1)).alias("candidates"))
        assert sorted(map(tuple, linkage.counts(ids, known, cap).collect())) == sorted(map(tuple, want.collect()))


def test_pairs_by_phone_in_lists(spark, monkeypatch):
    columns = ["identity", F.round("name_s", 6), F.round("village_s", 6), "age_s"]
    rows = []
    for copies in (1, 4):
        monkeypatch.setattr(linkage, "IDS", 2)
        records, entities = registers(spark, copies)
        found = linkage.by_phone(records, entities)
        want = linkage.scored(records, entities).where("via = 'phone4'").select(*columns, "entity_id")
        assert sorted(map(tuple, found.select(*columns, F.explode("entity_ids")).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        monkeypatch.setattr(linkage, "IDS", 4096)
        rows.append(linkage.by_phone(records, entities).count())
    assert rows[0] == rows[1] > 0


def test_pairs_by_phone_normalise_distinct_rows_once(spark, monkeypatch):
    """Missing and equal-but-for-spelling values; records are read once, and nothing that is read last is normalised."""
    read, columns = spark.sparkContext.accumulator(0), ["identity", F.round("name_s", 6), F.round("village_s", 6), "age_s"]

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    records = spark.createDataFrame([("s", str(i), n, p, v, None, a) for i, (n, p, v, a) in enumerate([("Mr. Rao Laxman", "XX1234", "Vil.", 7), ("rao laxman", "XX1234", "vil", 7), (None, "XX1234", None, None), ("rao laxmn", "XX1235", "vila", 9), ("x", None, "v", 1), ("x", "99", "v", 1)])], "source_system string, source_id string, name string, mobile string, village string, gender string, age int")
    entities = spark.createDataFrame([(i, n, p, v, "g", a) for i, (n, p, v, a) in enumerate([("RAO laxman", "1234", "vil", 7), ("rao laxman", "1234", "vil.", 7), ("rao laxman", "1234", "vil.", 7), (None, "1234", None, None), (None, "1234", None, None), ("rao", "1235", "vila", 5), ("y", None, "v", 1), ("y", "", "v", 1)] * 3)], "entity_id long, name string, phone4 string, village string, gender string, age int")
    monkeypatch.setattr(linkage, "IDS", 2)
    found = linkage.by_phone(records.mapInArrow(seen, records.schema), entities)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = linkage.scored(records, entities).where("via = 'phone4'").select(*columns, "entity_id")
    assert sorted(map(tuple, found.select(*columns, F.explode("entity_ids")).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert read.value == records.count()


def day(n):
    return datetime(2024, 1, n)


def test_history_counts_only_strictly_earlier_rows(spark):
    rows = spark.createDataFrame([(1, "k", day(1)), (2, "k", day(2)), (3, "k", day(2)), (4, "k", day(3)), (5, None, day(9))], "id int, k string, t timestamp")
    found = {r["id"]: r["n"] for r in asof.history(rows, "k", "t", {"n": F.count("id")}).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 3, 5: 0}


def test_latest_and_latest_k(spark):
    spine = spark.createDataFrame([(1, "k", day(5)), (2, "k", day(1)), (3, "z", day(5))], "id int, k string, t timestamp")
    events = spark.createDataFrame([("k", day(n), n) for n in (1, 2, 3, 4, 5, 6)], "k string, t timestamp, v int")
    got = {r["id"]: r["latest"] and r["latest"]["v"] for r in asof.latest(spine, events, "k", "t", ["v"]).collect()}
    assert got == {1: 4, 2: None, 3: None}
    last = asof.latest_k(spine, events, "k", "t", ["v"], ["v"], 3).groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    assert {r["id"]: r["v"] for r in last} == {1: [2, 3, 4]}


def test_future_events_never_change_a_feature(spark):
    spine = spark.createDataFrame([(n, "k", day(n)) for n in range(1, 9)], "id int, k string, t timestamp")
    events = spark.createDataFrame([("k", day(n), n) for n in (2, 4, 6)], "k string, t timestamp, v int")
    more = events.union(spark.createDataFrame([("k", day(20), 99)], events.schema))
    before, after = (sorted(asof.latest(spine, e, "k", "t", ["v"]).select("id", "latest.v").collect(), key=str) for e in (events, more))
    assert before == after


def test_band_bounds(spark):
    left = spark.createDataFrame([(1, "k", day(10))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("k", day(n), n) for n in range(1, 29)], "k string, u timestamp, n int")
    assert sorted(r["n"] for r in asof.band(left, right, "k", "t", "u", -1, 3).collect()) == [9, 10, 11, 12, 13]
    assert sorted(r["n"] for r in asof.band(left, right, "k", "t", "u", 0, 3, open_lower=True).collect()) == [11, 12, 13]


def test_ranking_metrics(spark):
    perfect = spark.createDataFrame([(i / 10, int(i >= 6)) for i in range(10)], "s double, y int")
    assert tuple(metrics.ranking(perfect, F.col("s"), F.col("y")).first()) == (1.0, 1.0)
    constant = perfect.withColumn("s", F.lit(0.5))
    auc, ap = metrics.ranking(constant, F.col("s"), F.col("y")).first()
    assert auc == 0.5 and ap == pytest.approx(0.4)
    assert tuple(metrics.ranking(perfect.where("y = 0"), F.col("s"), F.col("y")).first()) == (None, None)
    top = metrics.at_top(perfect, F.col("s"), F.col("y"), "s", [0.01, 0.5]).orderBy("share").collect()
    assert [(r["k"], r["precision"]) for r in top] == [(1, 1.0), (5, pytest.approx(0.8))]


def test_tier_ranks_are_at_least_one(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(3)], "id int, s double")
    assert tuple(queue.cut_offs(rows, "s").first()) == (2.0, 2.0, 2.0)


def test_quantiles_and_running_totals(spark):
    values = [3.0, -1.5, 0.0, 0.0, 1e300, float("inf"), float("-inf"), 2.0, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.0, 0.3, 0.5, 0.75):
        assert ranks.quantile(rows.where("v < 1e200 AND v > -1e200"), "v", share, "q").first()["q"] == rows.where("v < 1e200 AND v > -1e200").agg(F.percentile("v", share)).first()[0]
    assert ranks.quantile(rows.where("v IS NULL"), "v", 0.5, "q").first()["q"] is None
    counts = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = [r["run_n"] for r in ranks.running(counts, "v", ["n"]).orderBy("v").collect()]
    assert got == [1, 2, 4, 5, 6, 7, 8, 9]
    assert [r["run_n"] for r in ranks.running(counts, "v", ["n"], descending=True).orderBy(F.desc("v")).collect()] == [1, 2, 3, 4, 5, 7, 8, 9]


def test_top_share_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 2 else 0.5, int(i in (0, 2, 9))) for i in range(10)] + [(10, None, 1)], "k long, s double, y int")
    got = {r["share"]: (r["k"], r["precision"], r["recall"]) for r in metrics.at_top(rows, F.col("s"), F.col("y"), "k", [0.1, 0.3, 1.0]).collect()}
    assert got == {0.1: (1, 1.0, 0.25), 0.3: (3, pytest.approx(2 / 3), 0.5), 1.0: (11, pytest.approx(4 / 11), 1.0)}


def test_confusion_has_every_class(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "a")], "y string, p string")
    assert [tuple(r) for r in metrics.confusion(rows, "y", "p", ["a", "b", "c"]).collect()] == [("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 0, 0, 0)]


def test_verdicts_go_by_table_and_column(spark):
    rows = spark.createDataFrame([("x", "y"), ("z", "y"), ("z", "v"), ("x", "v"), ("s", "y"), ("e", "y"), ("z", "q")], "table_name string, column_name string")
    got = {(r[0], r[1]): r[2] for r in encode.verdicts(rows, {("x", "y"): ("label", "")}, {("x", "v"): ""}, {("z", "y")}, {"v"}, {"s"}, {"e"}).collect()}
    assert got == {("x", "y"): "label", ("z", "y"): "available", ("z", "v"): "history only", ("x", "v"): "history only", ("s", "y"): "available", ("e", "y"): "available", ("z", "q"): "conditional"}


def test_strict_cast_and_condition_count(spark):
    rows = spark.createDataFrame([("1.5", "A+B"), (None, "NONE"), ("2", None)], "a string, c string")
    assert [tuple(r) for r in rows.select(encode.strict_number(F.col("a")), encode.condition_count(F.col("c"))).collect()] == [(1.5, 2), (None, 0), (2.0, 1)]
    with pytest.raises(Exception, match="not a number: x"):
        spark.createDataFrame([("x",)], "a string").select(encode.strict_number(F.col("a"))).collect()


def test_inclusive_latest_k(spark):
    spine = spark.createDataFrame([(1, "k", day(2))], "id int, k string, t timestamp")
    events = spark.createDataFrame([("k", day(n), n) for n in (1, 2, 3)], "k string, t timestamp, v int")
    for inclusive, want in ((False, [1]), (True, [1, 2])):
        assert sorted(r["v"] for r in asof.latest_k(spine, events, "k", "t", ["v"], ["v"], 3, inclusive).collect()) == want


def test_compare_refit_and_reload(spark, tmp_path):
    from meridian.operators import models
    from meridian.sources import files

    rows = spark.createDataFrame([(i, float(i % 4 > 1), float(i % 4), float(i % 7)) for i in range(200)], "id int, label double, a double, b double")
    kinds = {"logistic": [{"C": 0.5}], "depthwise": [{"max_depth": d, "maxIter": 2} for d in (1, 2)], "leafwise": [{"maxIter": 2}]}
    found = models.compare(rows, rows, ["a", "b"], kinds, (rows, rows))
    ap = [m.first()["average_precision"] for _, _, m in found]
    assert [n for n, _, _ in found] == ["prevalence", *kinds] and ap[0] == pytest.approx(0.5) and min(ap[1:]) == pytest.approx(1.0)
    model = models.refit(rows, ["a", "b"], "logistic", {"C": 0.5})
    files.save_model(model, f"{tmp_path}/m", {"kind": "logistic"})
    back, about = files.load_model(spark, f"{tmp_path}/m")
    assert about == {"kind": "logistic"}
    assert [r["p"] for r in models.score(back, rows).orderBy("id").collect()] == [r["p"] for r in models.score(model, rows).orderBy("id").collect()]


def test_orders_are_joined_without_broadcast(spark, monkeypatch):
    from meridian.plans import learning

    tables = {
        "orders": spark.createDataFrame([(1, day(1), "F", 100.0, "1-URGENT", 7), (2, day(2), "O", 200.0, "5-LOW", 8), (3, day(3), "O", 300.0, "2-HIGH", None)], "o_orderkey long, o_orderdate timestamp, o_orderstatus string, o_totalprice double, o_orderpriority string, o_custkey long"),
        "customer": spark.createDataFrame([(7, 1000.0)], "c_custkey long, c_acctbal double"),
    }
    monkeypatch.setattr(learning, "table", lambda spark, sf_dir, name: tables[name])
    rows = learning._orders(spark, "")
    assert {r["o_orderkey"]: r["balance"] for r in rows.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_judging_scores_each_row_once(spark):
    from meridian.operators import models

    scored_rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scored_rows.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(0.9, 1.0), (0.4, 0.0), (0.6, 0.0), (0.7, 1.0)], "p double, label double")
    found = models.judge(rows.mapInArrow(seen, rows.schema)).first()
    assert found == models.evaluate(rows).first() and scored_rows.value == 4


def test_model_comparison_fits_what_was_surveyed():
    from meridian.plans import learning

    kinds = learning._CANDIDATES
    assert [(s["numTrees"], s["maxDepth"]) for s in kinds["forest"]] == [(500, None)] * 3
    assert [s["maxIter"] for k in ("boosted", "depthwise", "leafwise") for s in kinds[k]] == [300] + [400] * 7
    assert kinds["boosted"][0]["stepSize"] == 0.05 and kinds["logistic"] == [{"C": 0.5, "maxIter": 2000}]


def test_trees_grow_over_cells(spark):
    from meridian.operators import celltrees, models

    rows = spark.createDataFrame([(float(i % 8), float(i % 3), float("nan") if i % 5 == 0 else i / 7, float((i % 8 > 3) == (i % 3 > 0))) for i in range(960)], "a double, b double, c double, label double").persist()
    features = ["a", "b", "c"]
    grid, n, pos = celltrees.cells(rows, rows, features)
    # as many bins as values; where there are more than 32 of these, 32, with the missing ones in the last
    assert grid.sizes == (8, 3, 32) and grid.n.sum() == n.sum() == 960 and pos.sum() == rows.where("label = 1").count()
    assert rows.where("isnan(c)").select(F.pmod(grid.number(), F.lit(32))).distinct().collect() == [(31,)]
    settings = {"forest": {"numTrees": 30, "minInstancesPerNode": 1}, "boosted": {"maxIter": 60, "stepSize": 0.3}, "depthwise": {"maxIter": 40, "stepSize": 0.3}, "leafwise": {"maxIter": 40, "stepSize": 0.3, "min_child_samples": 5}}
    found = celltrees.fits(spark, [(grid, k, s) for k, s in settings.items()])
    for p, kind in zip(found, settings):
        assert celltrees.average_precision(p, n, pos) > 0.99, kind
        again = models.predict(rows.repartition(3), rows, features, kind, settings[kind])
        assert again.count() == 960 and models.average_precision(again) == pytest.approx(celltrees.average_precision(p, n, pos), abs=1e-9), kind
    rows.unpersist()


def test_cell_tree_without_limit_ends_in_pure_leaves():
    import numpy as np

    from meridian.operators import celltrees

    bins = np.stack(np.unravel_index(np.arange(32 * 32), (32, 32))).astype(np.int32)
    rng = np.random.default_rng(1)
    label, total, every = rng.integers(0, 2, 1024), rng.integers(1, 1000, 1024).astype(float), np.ones(1024, bool)
    deep = celltrees.tree(rng, bins, (32, 32), total, label * total, every, 2, 1, None)
    assert (deep == label).all()
    flat = celltrees.tree(rng, bins, (32, 32), total, label * total, every, 2, 1, 1)
    assert len(set(flat)) == 2 and (flat * total).sum() == pytest.approx((label * total).sum())
    least = celltrees.tree(rng, bins, (32, 32), total, label * total, every, 2, 20000, None)
    assert min(total[least == v].sum() for v in set(least)) >= 20000


def test_masked_argmax(spark):
    rows = spark.createDataFrame([([0.2, 0.5, 0.5], [True, True, True]), ([0.9, 0.1, 0.0], [False, True, True]), ([1.0, 1.0, 1.0], [False] * 3)], "p array<double>, m array<boolean>")
    found = [r[0] for r in rows.select(queue.masked_argmax(F.col("p"), F.col("m"), ["a", "b", "c"], "none")).collect()]
    assert found == ["b", "b", "none"]


def test_capacity_and_reasons(spark):
    rows = spark.createDataFrame([(i, "x" if i < 12 else None, float(i)) for i in range(24)], "id int, site string, s double")
    out = queue.with_capacity(rows, "site", "s", "id").groupBy("site").agg(F.count_if("overflow").alias("n")).collect()
    assert [r["n"] for r in out] == [2, 2]
    told = rows.select(queue.reasons([(F.col("s") > 5, F.lit("big")), (F.lit(None).cast("boolean"), F.lit("never")), (F.col("id") % 2 == 0, F.lit("even"))])).collect()
    assert (told[0][0], told[1][0], told[6][0]) == ("even", "General follow-up", "big; even")


def test_encodings(spark):
    rows = spark.createDataFrame([("1.5", "Yes", 1.0), ("x", None, None), ("nan", "No", 5.0)], "a string, b string, c double")
    assert [r[0] for r in rows.select(encode.number(F.col("a"))).collect()] == [1.5, None, None]
    assert [r[0] for r in rows.select(encode.flag(F.col("b"), "Yes")).collect()] == [1, 0, 0]
    assert [r["c"] for r in encode.impute_median(rows, ["c"]).collect()] == [1.0, 3.0, 5.0]
    coded = encode.one_hot(rows.select("b"), "b", ["No", "Other", "Yes", "__missing__"]).collect()
    assert tuple(coded[1]) == (0.0, 0.0, 0.0, 1.0)
    with pytest.raises(ValueError):
        encode.assert_usable(["a", "label"], ["label"], [])


def test_intervals_and_histogram(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 10, 10.5, 50, 40)], "v double")
    assert [r[0] for r in rows.select(profile.interval(F.col("v"), [0, 10, 40])).collect()] == [None, "(0, 10]", "(10, 40]", None, "(10, 40]"]
    assert sum(r["n"] for r in profile.histogram(rows, "v", 5).collect()) == 5


def test_files(spark, tmp_path):
    from meridian.sources import files

    rows = spark.createDataFrame([(1, "a|b", float("nan")), (2, None, 0.5)], "id int, name string, x double")
    files.write_csv(rows, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", rows.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a|b", None), (2, None, 0.5)]
    assert [r[0] for r in files.markdown(rows.where("id = 1")).collect()] == ["| 1 | a\\|b | NaN |"]
    files.write_json(rows, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2 and '"id": 1' in files.document(rows.where("id = 1"))
    assert files.clean_names(spark.createDataFrame([(1,)], ["﻿ id "])).columns == ["id"]


def test_attributions_add_up():
    import numpy as np

    from meridian.operators.treeshap import _expected, attributions

    tree = [(0, 0.5, 1, 4, 0.0, 1.0), (1, 0.5, 2, 3, 0.0, 0.5), (-1, 0, -1, -1, 1.0, 0.25), (-1, 0, -1, -1, 2.0, 0.75), (-1, 0, -1, -1, 6.0, 0.5)]
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    values = attributions([(1.0, tree)], x)
    assert np.allclose(values.sum(1) + _expected(tree, x, frozenset()), [1.0, 2.0, 6.0])


def test_catalogue_has_sql_for_all_but_models():
    import __spark_entry__ as entry

    names = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert {n for n in names if n not in entry.oracle_sql()} == {n for n in names if n.startswith("ml_") or n in ("permutation_importance", "tree_attributions")}

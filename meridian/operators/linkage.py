"""Entity linkage: blocks of candidates, weighted scores, an accept and margin policy, an audit row per record.

Records: ``source_system, source_id, name, mobile, village, gender, age``. Entities: ``entity_id, name,
phone4, village, gender, age``. Equal identities are scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridian.config import DEFAULT, Settings
from meridian.functions import identity

FIELDS = ["name", "mobile", "village", "gender", "age"]


def prepare_records(records: DataFrame) -> DataFrame:
    """Adds the normalised identity of each record and a key of it."""
    out = records.withColumns({"toks": identity.tokens(F.col("name")), "p4": identity.last4(F.col("mobile")), "vil": identity.normal_village(F.col("village")), "gen": F.lower(F.trim(F.coalesce("gender", F.lit("")))), "yrs": F.col("age").cast("double")})
    return out.withColumn("identity", F.md5(F.to_json(F.struct("toks", "p4", "vil", "gen", "yrs")).cast("binary")))


def prepare_entities(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", identity.tokens(F.col("name")).alias("e_toks"), F.col("phone4").alias("e_p4"), identity.normal_village(F.col("village")).alias("e_vil"), F.lower(F.trim(F.coalesce("gender", F.lit("")))).alias("e_gen"), F.col("age").cast("double").alias("e_age")).withColumns({"e_set": _hashed("e_toks"), "e_shortest": F.array_min(F.transform("e_toks", F.length))})


def _kept(rows: DataFrame) -> DataFrame:
    """Computes rows once and cuts their plan: in the checkpoint folder where there is one, else on the executors."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _hashed(tokens: str):
    """Distinct tokens as 64-bit hashes, which compare faster."""
    return F.transform(F.array_distinct(tokens), lambda t: F.xxhash64(t))


IDENTITY = ["identity", "toks", "p4", "vil", "gen", "yrs"]
ENTITY = ["entity_id", "e_toks", "e_p4", "e_vil", "e_gen", "e_age", "e_set", "e_shortest"]
#: What the likeness of names and villages depends on, apart from the phone.
QUESTION, GROUP = ["block", "name", "vil"], ["place", "e_name", "e_vil"]
SIMILAR = ["phone", "name_s", "village_s", "gender_s", "age_s"]


def _prefixes(tokens: str):
    return F.array_distinct(F.transform(tokens, lambda t: F.substring(t, 1, 4)))


def _words(name: str):
    """The tokens that were joined by one space."""
    return F.filter(F.split(name, " "), lambda t: t != "")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deals rows over all cores: a few bytes of them make many pairs, so their size says nothing about the work."""
    context = rows.sparkSession.sparkContext
    n = max(2 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def _taken(names: DataFrame, entities: DataFrame, cap: int) -> DataFrame:
    """``name, taken``: the prefixes of a name's tokens that entities have, in order, until more than ``cap`` candidates
    have been gathered (counted per token before); no row for a name without any. A row of ``entities`` with ``n`` counts as so many."""
    count = "n" if "n" in entities.columns else F.lit(1).alias("n")
    sizes = entities.select(F.explode(_prefixes("e_toks")).alias("prefix"), count).groupBy("prefix").agg(F.sum("n").alias("n"))
    asked = names.select("name", F.posexplode(_prefixes("toks")).alias("at", "prefix")).join(sizes, "prefix")
    before = F.sum("n").over(Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    kept = asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= cap)
    return kept.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "prefix"))), lambda x: x["prefix"]).alias("taken"))


def _first():
    """Whether a pair that shares several taken prefixes is looked at by the first of them."""
    return (F.size("taken") == 1) | (F.element_at(F.array_intersect("taken", "e_prefixes"), 1) == F.col("prefix"))


def _routed(identities: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``name`` and ``block``: # and the last four digits where entities have them, else ! or nothing, by whether there are any."""
    phones = entities.select(F.col("e_p4").alias("p4"), F.lit(True).alias("_listed")).where("p4 <> ''").distinct()
    block = F.when(F.col("_listed"), F.concat(F.lit("#"), "p4")).otherwise(F.when(F.col("p4") != "", "!").otherwise(""))
    return identities.join(phones, "p4", "left").withColumns({"name": F.array_join("toks", " "), "block": block}).drop("_listed")


def candidates(identities: DataFrame, entities: DataFrame, cap: int = DEFAULT.candidate_cap) -> DataFrame:
    """Pairs of all columns of both sides and ``via``: entities with the same last four digits; for identities without
    any, entities that share the first four letters of a name token. Tokens are taken in order until more than
    ``cap`` candidates have been gathered (counted per token before). A pair that shares several taken tokens is made at
    the first of them only, so nothing is deduplicated. Their number grows with the square of a block: ``counts``, ``best``
    and ``by_phone`` do without them."""
    routed = _routed(identities, entities)
    by_phone = _spread(routed.where("block LIKE '#%'"), "identity").join(entities, F.col("p4") == F.col("e_p4")).withColumn("via", F.lit("phone4"))
    rest = routed.where("block NOT LIKE '#%'")
    named = _spread(rest.join(_taken(rest.select("name", "toks").distinct(), entities, cap), "name"), "identity").withColumn("prefix", F.explode("taken"))
    by_name = named.join(entities.withColumn("e_prefixes", _prefixes("e_toks")).withColumn("prefix", F.explode("e_prefixes")), "prefix").where(_first())
    columns = [c for c in identities.columns if c not in IDENTITY]
    return by_phone.unionByName(by_name.withColumn("via", F.lit("name")).select(*by_phone.columns)).select(*IDENTITY, *columns, *ENTITY, "via")


def counts(identities: DataFrame, entities: DataFrame, cap: int = DEFAULT.candidate_cap) -> DataFrame:
    """``identity, via, candidates``: how many ``candidates`` each identity has (none: no row), without making the pairs.

    Entities are counted by phone, and by the set of their tokens' prefixes; a name meets each such set once."""
    routed = _routed(identities, entities).select("identity", "name", "toks", "p4", "block")
    phones = entities.groupBy(F.col("e_p4").alias("p4")).agg(F.count(F.lit(1)).alias("candidates"))
    by_phone = routed.where("block LIKE '#%'").join(phones, "p4").select("identity", F.lit("phone4").alias("via"), "candidates")
    rest = routed.where("block NOT LIKE '#%'")
    taken = _taken(rest.select("name", "toks").distinct(), entities, cap)
    sets = entities.groupBy(F.array_sort(_prefixes("e_toks")).alias("e_prefixes")).agg(F.count(F.lit(1)).alias("n"))
    met = _spread(taken.select("taken").distinct(), "taken").withColumn("prefix", F.explode("taken")).join(sets.withColumn("prefix", F.explode("e_prefixes")), "prefix").where(_first())
    found = met.groupBy("taken").agg(F.sum("n").alias("candidates"))
    by_name = rest.join(taken.join(found, "taken"), "name").select("identity", F.lit("name").alias("via"), "candidates")
    return by_phone.unionByName(by_name)


def near_tokens(identities: DataFrame, entities: DataFrame, key: str = "identity") -> DataFrame:
    """``key, near``: of each identity's tokens, those that entity tokens are one edit away from (three letters or more), with
    these tokens. Only distinct tokens are compared, where they share a variant."""
    def words(rows: DataFrame, tokens: str, name: str) -> DataFrame:
        return rows.select(F.explode(tokens).alias(name)).distinct().where(F.length(name) >= 2).withColumn("variant", F.explode(identity.variants(F.col(name))))

    pairs = words(identities, "toks", "token").where(F.length("token") >= 3).join(words(entities, "e_toks", "other"), "variant")
    pairs = pairs.where((F.col("token") != F.col("other")) & (F.levenshtein("token", "other", 1) >= 0)).groupBy("token").agg(F.collect_set("other").alias("away"))
    used = identities.select(key, F.explode(F.array_distinct("toks")).alias("token")).join(pairs, "token")
    hashed = F.struct(F.xxhash64("token").alias("token"), F.transform("away", lambda t: F.xxhash64(t)).alias("away"))
    return used.groupBy(key).agg(F.collect_list(hashed).alias("near"))


def _similarities() -> dict:
    return {"phone": ((F.col("p4") == F.col("e_p4")) & (F.col("p4") != "")).cast("double"), "name_s": identity.name_similarity(F.col("set"), F.col("e_set"), F.col("near"), F.col("e_shortest")), "village_s": identity.village_similarity(F.col("vil"), F.col("e_vil")), "gender_s": identity.same(F.col("gen"), F.col("e_gen")), "age_s": identity.age_similarity(F.col("yrs"), F.col("e_age"))}


def _with_near(rows: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Adds ``near`` and ``set`` to rows of ``key`` and ``toks``."""
    near = near_tokens(rows.select(key, "toks").distinct(), entities, key)
    return rows.join(near, key, "left").withColumns({"near": F.coalesce("near", F.array().cast("array<struct<token:bigint,away:array<bigint>>>")), "set": _hashed("toks")})


def _sides(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prepare_records(records).dropDuplicates(["identity"]).select(*IDENTITY), prepare_entities(entities)


def _few(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct raw rows of the records, prepared; the two smallest ids of each distinct raw entity, prepared; the number of
    entities of each distinct name.

    Both tables are read in a pass of plain columns; what is normalised is what is left of them, once."""
    raw = _kept(prepare_records(records.select(*FIELDS).distinct()))
    fields = ["name", "phone4", "village", "gender", "age"]
    entities = entities.select("entity_id", *fields)
    two = entities.withColumn("rn", F.row_number().over(Window.partitionBy(*fields).orderBy("entity_id"))).where("rn <= 2").drop("rn")
    names = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(identity.tokens(F.col("name")).alias("e_toks"), "n")
    return raw, _kept(prepare_entities(two)), names


def scored(records: DataFrame, entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Every candidate pair of every distinct identity with its similarities, score and evidence."""
    ids, known = _sides(records, entities)
    return _with_score(candidates(_with_near(ids, known, "identity"), known, settings.candidate_cap), settings)


def _score(settings: Settings, columns: list[str]):
    return F.round(sum((F.lit(w) * F.col(c) for w, c in zip(settings.weights[1:], columns[1:], strict=True)), F.lit(settings.weights[0]) * F.col(columns[0])), 9)


def _with_score(pairs: DataFrame, settings: Settings) -> DataFrame:
    return _with_evidence(pairs.withColumns(_similarities()), settings)


def _with_evidence(pairs: DataFrame, settings: Settings) -> DataFrame:
    evidence = F.array_compact(F.array(F.when(F.col("phone") > 0, "phone4"), F.when(F.col("name_s") >= 1, "name_exact").when(F.col("name_s") >= 0.75, "name_fuzzy"), F.when(F.col("village_s") > 0, "village"), F.when(F.col("gender_s") > 0, "gender"), F.when(F.col("age_s") == 1, "age_exact")))
    return pairs.withColumns({"score": _score(settings, SIMILAR), "evidence": F.concat_ws(";", evidence)})


def _placed(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with ``e_name`` and ``place``, where identities look for them: by phone (# and the digits), by name (! for those
    whose phone is null)."""
    named = known.withColumn("e_name", F.array_join("e_toks", " ")).drop("e_toks", "e_set", "e_shortest")
    return named.where("e_p4 <> ''").withColumn("place", F.concat(F.lit("#"), "e_p4")), named.withColumn("place", F.when(F.col("e_p4").isNull(), "!").otherwise(""))


def _key(rows: DataFrame, number: str, columns: list[str]) -> list[str]:
    """What tells questions or groups apart: their number where they have one."""
    return [number] if number in rows.columns else columns


def _numbered(placed: DataFrame) -> DataFrame:
    """Placed entities with the number of their group, which is quicker to join and sort by."""
    groups = _kept(placed.select(*GROUP).distinct().withColumn("gid", F.monotonically_increasing_id()))
    return _kept(placed.join(groups, GROUP))


def _groups(placed: DataFrame) -> DataFrame:
    keys = dict.fromkeys([*_key(placed, "gid", GROUP), *GROUP])
    groups = _spread(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), *keys).withColumn("e_toks", _words("e_name"))
    return groups.withColumns({"e_set": _hashed("e_toks"), "e_shortest": F.array_min(F.transform("e_toks", F.length))})


def _group_pairs(pairs: DataFrame, phone) -> DataFrame:
    similar = _similarities()
    return pairs.select(*_key(pairs, "qid", QUESTION), *_key(pairs, "gid", GROUP), "n", phone.alias("phone"), similar["name_s"].alias("name_s"), similar["village_s"].alias("village_s"))


def _phone_pairs(questions: DataFrame, by_phone: DataFrame) -> DataFrame:
    """Distinct names and villages of either side that share a phone."""
    asked = _spread(questions.where("block LIKE '#%'"), *QUESTION)
    return _group_pairs(asked.join(_groups(by_phone), F.col("block") == F.col("place")), F.lit(1.0))


def _name_pairs(questions: DataFrame, names: DataFrame, by_name: DataFrame, cap: int) -> DataFrame:
    """Distinct names and villages of either side that share a taken prefix. names: all entities, or their names counted."""
    rest = questions.where("block NOT LIKE '#%'")
    named = _spread(rest.join(_taken(rest.select("name", "toks").distinct(), names, cap), "name"), *QUESTION).withColumn("prefix", F.explode("taken"))
    met = named.join(_groups(by_name).withColumn("e_prefixes", _prefixes("e_toks")).withColumn("prefix", F.explode("e_prefixes")), "prefix").where(_first())
    return _group_pairs(met, F.when((F.col("block") != "!") | (F.col("place") != "!"), F.lit(0.0)))


def _questions(routed: DataFrame, known: DataFrame) -> DataFrame:
    return _with_near(routed.select(*QUESTION).distinct().withColumn("toks", _words("name")), known, "name")


def _hopeful(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Those of a question's groups that can hold one of its two best entities, whatever gender and age are asked for.

    Two entities at least reach ``sure`` before these two count; it is taken from a group of two or more, or from the best groups
    of two halves, so it is the second best or below."""
    phone, name, village, *rest = settings.weights
    base = F.coalesce(F.lit(phone) * F.col("phone") + F.lit(name) * F.col("name_s") + F.lit(village) * F.col("village_s"), F.lit(float("-inf")))
    bits = F.xxhash64(*_key(pairs, "gid", GROUP))
    question = Window.partitionBy(*_key(pairs, "qid", QUESTION))
    halves = [F.least(*[F.coalesce(F.max(F.when(F.shiftright(bits, k).bitwiseAND(1) == half, F.col("base"))).over(question), F.lit(float("-inf"))) for half in (0, 1)]) for k in range(4)]
    sure = F.greatest(F.coalesce(F.max(F.when(F.col("n") > 1, F.col("base"))).over(question), F.lit(float("-inf"))), *halves)
    room = sum(abs(w) for w in rest) + 1e-6
    return pairs.withColumn("base", base).withColumn("sure", sure).where(F.col("base") + room >= F.col("sure")).drop("base", "sure", "n")


#: Width of an age bucket: ages five apart lie in neighbouring ones, also after rounding.
BUCKET = 6


def _bucket(age: str):
    return F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(age))) / BUCKET)


def _smallest(placed: DataFrame, *keys: str) -> DataFrame:
    """The two smallest ids of each group and ``keys``."""
    rank = F.row_number().over(Window.partitionBy("gid", *keys).orderBy("entity_id"))
    return placed.select("gid", "e_gen", "e_age", "e_p4", "entity_id").withColumn("rn", rank).where("rn <= 2").drop("rn")


def _met(asked: DataFrame, placed: DataFrame, settings: Settings) -> DataFrame:
    """Asked identities, each with ``gen``, ``yrs`` and a group, beside entities of the group, all those among its two best included;
    an entity may come twice.

    Where neither gender nor age lowers a score, of all entities of a group, of one gender, of one age, or of both, only the two
    smallest ids can count that are no better than these; so an identity meets its own gender and the ages near its own."""
    if min(settings.weights[3:]) < 0:
        return asked.join(_smallest(placed, "e_gen", "e_age"), "gid")
    anyone, gender = F.lit("*"), F.concat(F.lit("="), "e_gen")
    aged = placed.where("e_age IS NOT NULL")
    shelves = [
        _smallest(placed).withColumns({"g": anyone, "b": F.lit(None).cast("long")}), _smallest(placed, "e_gen").withColumns({"g": gender, "b": F.lit(None).cast("long")}),
        _smallest(aged, "e_age").withColumns({"g": anyone, "b": _bucket("e_age")}), _smallest(aged, "e_gen", "e_age").withColumns({"g": gender, "b": _bucket("e_age")}),
    ]
    shelf = shelves[0]
    for more in shelves[1:]:
        shelf = shelf.unionByName(more)
    far = F.lit(1 << 60)
    shelf = shelf.withColumn("b", F.coalesce("b", far))
    genders = F.array(anyone, F.concat(F.lit("="), "gen"))
    ages = F.when(F.col("yrs").isNull(), F.array(far)).otherwise(F.array(far, *[_bucket("yrs") + k for k in (-1, 0, 1)]))
    return asked.withColumn("g", F.explode(genders)).withColumn("b", F.explode(ages)).join(shelf, ["gid", "b", "g"]).drop("g", "b")


def best(records: DataFrame, entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per identity the best candidate with its columns, the runner-up's score (0 without one) and the margin; ties go to the
    smaller id.

    Of entities with equal fields only the two smallest ids can be among an identity's two best. Names and villages are
    compared once for all identities and entities that have them (per phone, or per name); gender and age only in the groups
    that can hold the two best. So the work grows with distinct values of a block, not with the square of its rows."""
    raw, known, names = _few(records, entities)
    return _best(raw, known, names, settings)


def _best(raw: DataFrame, known: DataFrame, names: DataFrame, settings: Settings) -> DataFrame:
    routed = _kept(_routed(raw.select(*IDENTITY).distinct(), known).withColumn("iid", F.monotonically_increasing_id()))
    by_phone, by_name = _placed(known)
    placed = _numbered(by_phone.unionByName(by_name))
    by_phone, by_name = placed.where("place LIKE '#%'"), placed.where("place NOT LIKE '#%'")
    questions = _kept(_questions(routed, known).withColumn("qid", F.monotonically_increasing_id()))
    pairs = _phone_pairs(questions, by_phone).unionByName(_name_pairs(questions, names, by_name, settings.candidate_cap))
    hopeful = _kept(_hopeful(pairs, settings))
    asked = routed.join(questions.select(*QUESTION, "qid"), QUESTION).select("iid", "qid", "gen", "yrs").join(hopeful, "qid")
    similar = _similarities()
    met = _met(asked, placed, settings).withColumns({c: similar[c] for c in ("gender_s", "age_s")})
    met = met.select("iid", "entity_id", "e_p4", *SIMILAR, _score(settings, SIMILAR).alias("score"))
    order = Window.partitionBy("iid").orderBy(F.desc("score"), "entity_id")
    two = met.withColumn("rank", F.dense_rank().over(order)).where("rank <= 2")
    runner_up = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("iid"))
    top = two.withColumns({"runner_up": F.coalesce(runner_up, F.lit(0.0)), "rn": F.row_number().over(order)}).where("rn = 1").drop("rank", "rn", "score")
    found = _with_evidence(routed.select(*IDENTITY, "iid").join(top, "iid"), settings)
    return found.withColumn("margin", F.round(F.col("score") - F.col("runner_up"), 9))


#: Most ids in a row of ``by_phone``, and what it asks of entities.
IDS, PLAIN = 4096, ["name", "phone4", "village", "age"]


def _kinds(entities: DataFrame) -> DataFrame:
    """The distinct raw entities with how many there are (``n``), prepared once; their number stands in for an id."""
    plain = _kept(entities.groupBy(*PLAIN).agg(F.count(F.lit(1)).alias("n")).withColumn("entity_id", F.monotonically_increasing_id()))
    prepared = prepare_entities(plain.withColumn("gender", F.lit(None).cast("string")))
    return _kept(prepared.join(plain.select("entity_id", "n", *[F.col(c).alias(f"_{c}") for c in PLAIN]), "entity_id"))


def _listed(entities: DataFrame, kinds: DataFrame) -> DataFrame:
    """``PLAIN, entity_ids``: the ids of equal raw entities, ``IDS`` or so in a row."""
    many = kinds.where(F.col("n") > IDS).select(F.ceil(F.col("n") / IDS).cast("int").alias("rows"), *[f"_{c}" for c in PLAIN])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLAIN]
    dealt = entities.select("entity_id", *PLAIN).join(many, same, "left").withColumn("row", F.pmod(F.xxhash64("entity_id"), F.coalesce("rows", F.lit(1))))
    return dealt.groupBy(*PLAIN, "row").agg(F.collect_list("entity_id").alias("entity_ids")).drop("row")


def by_phone(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Every pair of an identity and an entity with the same last four digits: the identity's columns, ``name_s``, ``village_s`` and
    ``age_s``, and in ``entity_ids`` those of the entities that are equal as they stand in name, phone, village and age (``IDS`` or so in a row).

    Distinct raw rows of either side are normalised once; ids are only listed per raw entity and looked up last."""
    raw = _kept(prepare_records(records.select(*FIELDS).distinct()))
    ids, known = raw.dropDuplicates(["identity"]).select(*IDENTITY), _kinds(entities)
    routed, (placed, _) = _kept(_routed(ids, known).where("block LIKE '#%'")), _placed(known)
    pairs = _phone_pairs(_questions(routed, known), placed).select(*QUESTION, *GROUP, "name_s", "village_s")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLAIN]
    lists = _listed(entities, known).join(placed, same).select(*GROUP, "e_age", "entity_ids")
    met = _spread(routed, "identity").join(pairs, QUESTION).join(lists, GROUP)
    return met.withColumn("age_s", _similarities()["age_s"]).select(*IDENTITY, "name_s", "village_s", "age_s", "entity_ids")


def decide(top: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``confidence``: high, medium, low or none."""
    possible = (F.col("p4") == F.col("e_p4")) & ~((F.col("phone") > 0) & (F.col("name_s") < settings.phone_only_name_floor))
    rule = F.when(~possible, "none")
    for name, (score, margin) in (("high", settings.high), ("medium", settings.medium), ("low", settings.low)):
        rule = rule.when((F.col("score") >= score) & (F.col("margin") >= margin), name)
    return top.withColumn("confidence", rule.otherwise("none"))


def audit(records: DataFrame, entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per record: match, score, runner-up, margin, confidence, evidence."""
    raw, known, names = _few(records, entities)
    decided = decide(_best(raw, known, names, settings), settings).select("identity", "entity_id", "score", "runner_up", "margin", "confidence", "evidence")
    decided = _kept(raw.select(*FIELDS, "identity").join(decided, "identity", "left").drop("identity").withColumn("confidence", F.coalesce("confidence", F.lit("none"))))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in FIELDS]
    out = records.select("source_system", "source_id", *FIELDS).alias("r").join(decided.alias("d"), same).select("r.*", *[f"d.{c}" for c in decided.columns if c not in FIELDS])
    matched = F.col("confidence") != "none"
    return out.select("source_system", "source_id", "mobile", matched.cast("int").alias("matched"), F.when(matched, F.col("entity_id")).alias("entity_id"), *[(F.rint(F.coalesce(c, F.lit(0.0)) * 1000) / 1000).alias(n) for c, n in (("score", "match_score"), ("runner_up", "runner_up_score"), ("margin", "margin"))], "confidence", F.coalesce("evidence", F.lit("")).alias("evidence"))


def crosswalk(found: DataFrame) -> DataFrame:
    """One row per (system, source id): its most confident match; so joins on it never multiply rows."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    order = Window.partitionBy("source_system", "source_id").orderBy(rank, F.desc("match_score"), "entity_id")
    return found.where("matched = 1").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("source_system", "source_id", "entity_id", "confidence")


def metrics(found: DataFrame, by: list[str]) -> DataFrame:
    """Match rate, share of high confidence among matches, entities reached; overall for an empty ``by``."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(F.col("matched").cast("double")), 6).alias("match_rate"), F.round(F.count_if(F.col("confidence") == "high") / F.greatest(F.sum("matched"), F.lit(1)), 6).alias("high_share"), F.countDistinct("entity_id").alias("entities"))


def transitivity(found: DataFrame) -> DataFrame:
    """One row: of groups of matched records with the same phone, the share that reach one entity only."""
    groups = found.where("matched = 1").withColumn("phone", identity.normal_phone(F.col("mobile"))).where("phone <> ''").groupBy("phone").agg(F.countDistinct("entity_id").alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg((F.col("n") <= 1).cast("double")), 6).alias("consistent"))

"""Brute-force twins and edge cases of the operators on texts."""

import hashlib
import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stretch int, _text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for i in range(0, n, 7):
        texts[i] += " " + passage
    for i in range(1, n, 9):
        words = texts[i - 1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts[5] = texts[2]
    return texts + ["", None, "  \t\n ", "one two", "one two", "ONE  two", "a b c d e f g", "É ü\u00a0x  y\tz", "w1 " * 3000]


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def test_jaccard_components(spark):
    from meridian.llm.jaccard import near_copies

    texts = corpus()
    assert sorted(map(tuple, near_copies(frame(spark, texts)).collect())) == brute_components(texts)


def test_jaccard_many_borderline_members(spark):
    """Groups larger than a pair join takes, whose members are alike or not by small changes."""
    from meridian.llm.jaccard import near_copies

    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"m{rng.randrange(6)}"
        texts.append(" ".join(words))
    assert sorted(map(tuple, near_copies(frame(spark, texts)).collect())) == brute_components(texts)


def test_jaccard_alike_sets_share_an_announcement():
    """All pairs of sizes up to 20 that can be alike, as different as they may be."""
    import numpy as np

    from meridian.llm.jaccard import _announce, _octaves

    rng = np.random.default_rng(5)
    for n in range(1, 21):
        for m in range(n, 21):
            shared = -(-80 * (n + m) // 180)
            for _ in range(300 if shared <= n else 0):
                x = rng.integers(0, 1 << 64, n + m - shared, dtype=np.uint64)
                a, b = np.sort(x[:n]), np.sort(x[n - shared :])
                assert any(len(np.intersect1d(_announce(a, k, 0.8), _announce(b, k, 0.8))) for k in set(_octaves(n, 0.8)) & set(_octaves(m, 0.8))), (n, m)


def test_jaccard_sets_are_made_in_parts(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from meridian.llm import jaccard

    texts = pa.array([" ".join(f"w{(i * 7919 + k * 31) % 5000}" for k in range(1500)) for i in range(900)])
    tracemalloc.start()
    hashes, sizes = jaccard.shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * texts.nbytes
    monkeypatch.setattr(jaccard, "PART", 20_000)
    again, counts = jaccard.shingle_sets(texts, 5)
    assert (hashes == again).all() and (sizes == counts).all() and sizes.sum() == len(hashes)
    assert [len(x) for x in jaccard.shingle_sets(pa.array([], pa.string()), 5)] == [0, 0]
    assert jaccard.shingle_sets(pa.array([None, "a b", ""]), 5)[1].tolist() == [0, 1, 0]


def test_jaccard_short_near_copies(spark):
    """Pairs of 4 and 5 shingles: a text and the same with a word more."""
    from meridian.llm.jaccard import near_copies

    rng = random.Random(2)
    texts = []
    for i in range(400):
        words = [f"s{i}x{rng.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    assert sorted(map(tuple, near_copies(frame(spark, texts)).collect())) == brute_components(texts)


def test_jaccard_null_id_and_empty_table(spark):
    from meridian.llm.jaccard import near_copies

    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, near_copies(docs).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (None, 2, None)]
    assert near_copies(docs.limit(0)).count() == 0


def brute_repeats(texts):
    seen, out = set(), []
    for text in texts:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substring_repeats(spark):
    from meridian.llm.substrings import digest, remove_repeats, repeats

    texts = corpus()
    found = sorted(map(tuple, digest(repeats(frame(spark, texts))).collect()))
    assert found == [(i, *x) for i, x in enumerate(brute_repeats(texts))]
    cut = {r["doc_id"]: r["text"] for r in remove_repeats(frame(spark, texts)).collect()}
    for i, (_, removed, sha) in enumerate(brute_repeats(texts)):
        if removed:
            assert hashlib.sha256(cut[i].encode()).hexdigest() == sha
        else:
            assert cut[i] == texts[i]
    assert digest(repeats(frame(spark, texts).limit(0))).count() == 0


def test_cover_brings_any_two_places_together():
    from meridian.llm.substrings import COVER, PERIOD

    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER for d in range(PERIOD))


def test_words_and_windows():
    import pyarrow as pa

    from meridian.llm import words as w

    texts = [t for t in corpus(n=30)]
    step, w.STEP = w.STEP, 11
    try:
        found = w.Words(pa.array(texts), keep_places=True)
    finally:
        w.STEP = step
    assert found.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    flat = [x for t in texts for x in WORD.findall(t or "")]
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends, strict=True)] == flat
    known = {}
    for key, h in zip((tuple(flat[i : i + 5]) for i in range(len(flat) - 4)), found.windows(5).tolist(), strict=True):
        assert known.setdefault(key, h) == h
    assert len(set(known.values())) == len(known)


def test_toxicity_learns_words_and_stems(spark):
    from meridian.llm.toxicity import fit, fold, score
    from pyspark.sql import functions as F

    rng = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", f"veju{rng.choice('abcdefgh')}{rng.choice('abc')}"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic), 1))
    docs, marks = frame(spark, [*texts, "", None, "veju-zz " * 5000]), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = fit(docs, marks)
    found = {r["doc_id"]: r for r in score(docs, model, ["doc_id"]).withColumn("held", fold(F.col("doc_id")) == 0).collect()}
    assert len(found) == len(texts) + 3 and all(0 <= r["toxicity"] <= 1 for r in found.values())
    held = [i for i in range(600) if found[i]["held"]]
    assert sum((found[i]["toxicity"] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert found[600]["toxicity"] < 0.5 and found[601]["toxicity"] < 0.5 and found[602]["toxicity"] >= 0.5
    kept = score(docs, model, keep_below=0.5)
    assert kept.count() == sum(r["toxicity"] < 0.5 for r in found.values())


def test_toxicity_without_labels(spark):
    from meridian.llm.toxicity import fit, score

    docs = frame(spark, ["a b", None])
    model = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None and [r["toxicity"] for r in score(docs, model).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("weight", [None, "n_chars"])
def test_mixing_meets_targets(spark, weight):
    from meridian.llm.mixing import mix, mixed
    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = ["w " * rng.randint(0, 80) for _ in range(900)] + [None, ""]
    docs = frame(spark, texts, {i: None if i % 10 == 9 else f"s{i % 10 // 4}" for i in range(902)})
    out = mix(docs, weight_col=weight)
    rows = out.collect()
    assert len(rows) == 902 and {r["mix_copies"] for r in rows} <= {0, 1, 2}
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(3), weight_col=weight).collect()))
    by = {}
    for r in rows:
        x = by.setdefault(r["source"], [0, r["mix_target"], r["mix_source_size"]])
        x[0] += r["mix_size"] * r["mix_copies"]
    total = sum(x[2] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken - target) <= 80 and target <= 2 * size + 1e-9 for taken, target, size in by.values())
    assert mixed(docs, weight_col=weight).count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mix(docs.limit(0)).count() == 0


def test_cells_are_placed_once_per_unit(spark):
    """Cells equal those of a plain model; a unit's three cells are worked out before the cells are gone through."""
    import random

    from pyspark.sql import functions as F

    from meridian.llm.fingerprints import WIDER, WIDTH, _cells

    deal = random.Random(3)
    units = [deal.randrange(1 << 60) for _ in range(40)]
    rows = spark.createDataFrame([(units,), ([],)], "u array<bigint>")
    for width in (WIDTH, WIDER):
        want = [[0, 0] for _ in range(3 * width)]
        for e in units:
            for j in range(3):
                cell = want[j * width + (e >> (16 + 10 * j)) % 1024 % width]
                cell[0], cell[1] = cell[0] + 1, cell[1] ^ e
        full, empty = (r["c"] for r in rows.select(F.expr(_cells("u", width)).alias("c")).collect())
        assert [[d["n"], d["x"]] for d in full] == want and {(d["n"], d["x"]) for d in empty} == {(0, 0)}
        place, walk = _cells("u", width).split("sequence(")[0], _cells("u", width).split("sequence(")[1]
        assert (place + walk).count("shiftrightunsigned") == 3 and "shiftrightunsigned" not in walk.split(", c ->")[1]


def test_fingerprints_peel_to_the_exact_difference(spark):
    from meridian.llm.fingerprints import fingerprint_edits, likeness

    rng = random.Random(5)
    lines = [f"Line {i} says so." for i in range(300)]
    sides = []
    for n in (0, 1, 2, 5, 20, 120, 300):
        a = rng.sample(lines, n)
        for change in (0, 1, 3, n):
            sides.append(("\n".join(a), "\n".join(a[: max(0, n - change)] + [f"New {i}." for i in range(change)])))
    pairs = spark.createDataFrame(sides, "l string, r string")

    def units(text):
        return {u for u in re.sub(r"([.!?]) ", "\\1\n", text).split("\n") if u}

    for row in likeness(pairs, "l", "r", "near").collect():
        a, b = units(row["l"]), units(row["r"])
        assert row["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    docs = frame(spark, ["a. b", "a. b", None, "", "c\nd" * 50])
    found = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    assert found[0]["fingerprint"] == found[1]["fingerprint"] and found[0]["near_next"] == 1.0
    assert found[2]["fingerprint"] == found[3]["fingerprint"] and found[2]["near_next"] == 1.0 and found[2]["n_chars"] == 0
    assert found[4]["edited_sha256"] == hashlib.sha256((("c\nd" * 50)[:75] + "a. b").encode()).hexdigest()
    assert fingerprint_edits(docs.limit(0)).count() == 0


def test_packing_round_trip(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from meridian.llm.packing import ChunkTokenizer, pack
    from tokenizers import Tokenizer

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = Tokenizer.from_file(path)
    texts = [*corpus(n=40), " a  b\n\nc d's 12 é½ x", "a \n b", "<|endoftext|> hi", "a <|endoftext|>b <|endoftext|", "́ x y\u3000z  ", "x" * 5000]
    chunks = ChunkTokenizer(path, ranks)
    ids = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    for t, want in zip(texts, ids, strict=True):
        assert np.frombuffer(chunks.encode(t or ""), "<u4").tolist() == want
    rows = pack(frame(spark, texts), path, ranks_path=ranks).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0 for r in rows)
    for i, want in enumerate(ids):
        want = [*want, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *(r["length"] for r in mine)])[:-1]) and sum(r["length"] for r in mine) == len(want)
        for r in mine:
            part = np.array(want[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(want)
    with pytest.raises(ValueError):
        pack(frame(spark, texts), path, limit=1000)


def test_substring_rows_that_share_an_id(spark):
    """Each row is a document of its own: a passage that occurs once stays, whatever other rows with its id hold."""
    from meridian.llm.substrings import digest, remove_repeats, repeats

    u, w = (" ".join(f"{x}{i}" for i in range(25)) for x in "uw")
    docs = spark.createDataFrame([(1, w, 0), (2, u, 0), (2, w, 1), (None, "n " * 3, 0), (None, u, 1), (None, None, 2)], "doc_id long, text string, starts int")
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in digest(repeats(docs)).collect()), key=str)
    assert found == sorted([(1, 25, 0), (2, 25, 25), (2, 25, 25), (None, 3, 0), (None, 25, 0), (None, 0, 0)], key=str)
    kept = {(r["doc_id"], r["starts"]): r["text"] for r in remove_repeats(docs).collect()}
    assert kept == {(1, 0): w, (2, 0): "", (2, 1): "", (None, 0): "n " * 3, (None, 1): u, (None, 2): None}


def test_jaccard_rows_that_share_an_id(spark):
    from meridian.llm.jaccard import near_copies

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (5, b), (3, b + " more"), (4, a + " tail"), (9, c), (8, c + " end"), (5, a)], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in near_copies(docs).collect()}
    assert found == {(5, 3), (3, 3), (4, 3), (9, 8), (8, 8)}


def test_mixing_and_toxicity_keep_clashing_columns(spark):
    from meridian.llm.mixing import mix, mixed
    from meridian.llm.toxicity import fit, score

    docs = spark.createDataFrame([(i, "w " * 5, "s", 7, 8, 9, 1.5) for i in range(20)], "doc_id long, text string, source string, _size int, _copy int, mix_copies int, toxicity double")
    out = mix(docs)
    assert out.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies_"]
    assert {(r["_size"], r["_copy"], r["mix_copies"]) for r in out.collect()} == {(7, 8, 9)}
    rows = mixed(docs)
    assert rows.columns == docs.columns and {(r["_size"], r["_copy"]) for r in rows.collect()} == {(7, 8)}
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    scored = score(docs, fit(docs, marks))
    assert scored.columns == [*docs.columns, "toxicity_", "toxic_ratio"] and {r["toxicity"] for r in scored.collect()} == {1.5}

"""Embeddings, pages, archives, conversations and the pipeline."""

import gzip
import hashlib
import io
import json
import random

import numpy as np
import pytest


def test_near_vectors_against_brute_force(spark):
    from meridian.llm.pq import near_vectors

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    vectors = [base[i % 60] + rng.normal(scale=0.12 if i % 3 else 0.0, size=16).astype(np.float32) for i in range(400)]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, [float("inf")] + [0.0] * 15, 0), (405, [1.0, None] + [0.0] * 14, 0), (406, [1.0] * 5, 0), (407, rows[0][1], 0), (407, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    found = {r["vec_id"]: r for r in near_vectors(frame, lists=12, reach=1.0).collect()}
    x = np.array([r[1] for r in rows[:400]] + [rows[0][1]], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(400), 407]
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    for i, name in enumerate(ids):
        assert (found[name]["n_links"], found[name]["component_id"], found[name]["kept"]) == (near[i].sum(), label[i], label[i] == name)
    for name in range(400, 407):
        assert (found[name]["n_links"], found[name]["component_id"], found[name]["kept"]) == (0, name, True)
    assert len(found) == 408 and near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_recall_at_the_default_reach(spark):
    from meridian.llm.pq import near_vectors

    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    vectors = np.concatenate([base, base + rng.normal(scale=0.28, size=base.shape), base + rng.normal(scale=0.1, size=base.shape)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r["n_links"] for r in near_vectors(frame, lists=30).collect())
    assert want > 0 and 0.9 * want <= found <= want


def test_near_vectors_miss_nothing_in_few_dimensions(spark):
    """Differences that lie across few planes, and many lists."""
    from meridian.llm.pq import near_vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4)) @ rng.normal(size=(4, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    found = {r["vec_id"]: r["n_links"] for r in near_vectors(frame, lists=150).collect()}
    assert want.sum() > 1000 and [found[i] for i in range(len(x))] == want.tolist()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><p>Site header text that is long enough to look like content, really long indeed.</p></header>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and would like to tell you all about them at great length, again and again.</p></div>
<div class="main-%d"><h1>Ti&amp;tle</h1><p><b>First   paragraph<br>goes &eacute; on &#233; and on until it is long.<p>Second <i>one</i>
 with a <a href="/x">link</a> in it, and more text after it to be long enough.</p><form><p>Your name?</p></form>
<ul><li>An item of the article</li><li>Another item</li></ul></div>
<aside><p>Sidebar text of some length that nobody wants to see in the result at all, ever.</p></aside>
<div id="comments"><p>Reader comment that is long and winded and has no place in the main text of this page.</p></div>
<footer>&copy; Foot</footer></body></html>"""


def test_html_extraction(spark):
    from meridian.llm.htmltext import extract_pages

    pages = [(i, f"https://Host.example:80/{i}", PAGE % i, 1) for i in range(6)] + [(6, None, None, 1), (7, "x", "", 1), (8, "https://other.example/", "<p>only &lt;this&gt;", 1), (9, "https://h.example/", "<nav><p>menu</p></nav>", 1), (10, "u", "plain <b text", 1), (10, "u", "<div>" * 3000 + "deep down here is text" , 1)]
    found = extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, host int")).collect()
    want = "Ti&tle\nFirst paragraph goes é on é and on until it is long.\nSecond one with a link in it, and more text after it to be long enough.\nAn item of the article\nAnother item"
    texts = {}
    for r in found:
        texts.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(texts[i] == [want] for i in range(6))
    assert texts[6] == [""] and texts[7] == [""] and texts[8] == ["only <this>"] and texts[9] == [""] and "deep down here is text" in texts[10]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip(spark):
    from meridian.llm.warc import archive_root, read_archives, write_archives

    long = "é" * 600
    rows = [(1, "http://a", long, 0), (2, "http://b\r\nX: y", long, 0), (3, None, "x" * 999, 0), (4, "u", "x" * 999, 0), (5, "u", None, 0), (6, "u", "", 0), (7, "u", long + "!", 0), (None, "u", long, 0), (2, "http://b", long, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    found = read_archives(write_archives(pages, archive_root(spark), archive_bytes=700)).collect()
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)
    sha = {k: hashlib.sha1((h or "").encode()).hexdigest() for k, _, h, _ in rows}
    want = [(k or 0, len((h or "").encode()), sha[k], "revisit" if k in (1, None) else "response", 2 if k in (1, None) else None) for k, _, h, _ in rows]
    assert got == sorted(want, key=str) and all(r["gap_start"] is None for r in found)
    assert {bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"} == {long, "x" * 999, "", long + "!"}
    assert read_archives(write_archives(pages.limit(0), archive_root(spark))).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_what_follows_damage(zipped):
    from meridian.llm.warc import Salvage, record

    rng = random.Random(6)
    members = []
    for i in range(20):
        payload = bytes(rng.randrange(256) for _ in range(500 + 40 * i))
        data = record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), None, "2024-01-01T00:00:00Z")
        members.append(gzip.compress(data) if zipped else data)
    starts = np.cumsum([0, *map(len, members)])
    whole = bytearray(b"".join(members))
    whole[starts[5] + 600] ^= 0xFF
    del whole[starts[12] + 700 : starts[12] + 730]
    for step in (64, 1 << 16):
        reader = Salvage(io.BytesIO(bytes(whole[:-25])), step)
        ids = [int(fields["x-page-id"]) for _, fields, _ in reader]
        assert ids == [i for i in range(19) if i not in (5, 12)]
        assert [g[0] for g in reader.gaps] == [starts[5], starts[12], starts[19] - 30]
        assert [g[1] for g in reader.gaps] == [starts[6], starts[13] - 30, len(whole) - 25]


def test_chat_round_trip_and_parts(spark):
    from meridian.llm.chat import escape, format_turns, read_back, unescape

    for text in ("", "<|im_end|>", "<\\|x", "<\\\\|<|", "a<b|c", "<<||"):
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    parts = json.dumps([{"type": "text", "text": "see <|"}, {"type": "image", "reference": "s3://a.png", "width": 28, "height": 15}, {"type": "audio", "reference": "b", "seconds": 2}, {"type": "document", "reference": "c", "pages": 3}])
    rows = [(1, 1, "assistant", "two <|im_end|>", None, 0), (1, 0, "user", "one", parts, 0), (1, 2, "user", "x", json.dumps([{"type": "image", "reference": "d", "width": 1, "height": 1}]), 0), (2, 0, None, None, None, 0), (None, 0, "as\nsis\\tant", "n", None, 0), (3, 0, "assistant", "b", None, 0), (3, 0, "assistant", "a", None, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string, parts int")
    out = format_turns(turns, "content").collect()
    first = next(r for r in out if r["conv_id"] == 1 and r["turn"] == 0)
    assert first["formatted"] == "<|im_start|>user\nsee <\\|<|image:1|><|audio:2|><|document:3|><|im_end|>\n"
    assert [(a["ordinal"], a["kind"], a["reference"], a["tokens"]) for a in first["attachments"]] == [(1, "image", "s3://a.png", 4), (2, "audio", "b", 25), (3, "document", "c", 768)] and first["expanded_tokens"] == 797
    assert all(first["formatted"][a["at"] :].startswith(f"<|{a['kind']}:{a['ordinal']}|>") for a in first["attachments"])
    assert next(r for r in out if r["conv_id"] == 1 and r["turn"] == 2)["attachments"][0]["ordinal"] == 4
    back = {r["conv_id"]: r for r in read_back(format_turns(turns)).collect()}
    assert back[1]["turns_sha256"] == hashlib.sha256("user\none\nassistant\ntwo <|im_end|>\nuser\nx\n".encode()).hexdigest()
    assert back[1]["loss_chars"] == 14 and back[3]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert back[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and back[None]["turns_sha256"] == hashlib.sha256(b"as\nsis\\tant\nn\n").hexdigest()
    assert read_back(format_turns(turns.limit(0))).count() == 0


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"v{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(200)]
    for i in range(0, 200, 4):
        texts[i] += " moron scum"
    texts[11] = texts[1]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert kept[0] == {i for i in range(200) if i % 4} and kept[1] == kept[0] - {11} and kept[2] == kept[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().count() == len(kept[3])


def _block(tag, text, attributes=""):
    return f"<{tag}{' ' + attributes if attributes else ''}>{text}</{tag}>"


def test_html_templates_against_known_text(spark):
    """Pages of many templates made from known blocks: headline and all sections stay, everything round them goes."""
    from meridian.llm.htmltext import extract_pages

    rng = random.Random(4)
    noise = ['<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other</a></li></ul></nav>', '<div class="sidebar"><p>Side text that is long and of no interest here at all.</p></div>', '<div class="ad-box">Buy this now, it is cheap and good and new.</div>', '<section id="comments"><p>I do not agree with this article in any way.</p></section>', '<div class="cookie-banner">We use cookies.</div>', "<form><p>Your mail</p></form>", "<footer><p>All rights reserved by the site.</p></footer>", "<script>var p = '<p>no</p>';</script>"]

    def sentence():
        return " ".join(rng.choice("alpha beta gamma delta épsilon zeta".split()) for _ in range(rng.randint(4, 30)))

    def page(template):
        head, parts = sentence(), [[sentence() for _ in range(rng.randint(1, 4))] for _ in range(3)]
        paragraphs = ["".join(_block("p", x) for x in part) for part in parts]
        if template == 0:
            body = _block("article", _block("h1", head) + "".join(paragraphs))
        elif template == 1:
            body = _block("div", _block("h1", head) + "".join(_block("div", x, f'class="part-{k}"') for k, x in enumerate(paragraphs)), 'class="post"')
        elif template == 2:
            body = _block("div", _block("h1", head) + _block("div", "".join(paragraphs), 'class="body"'), 'class="entry"')
        else:
            body = _block("main", _block("h2", head) + "".join(_block("section", x) for x in paragraphs))
        round_ = rng.sample(noise, 4)
        return "<html><body>" + "".join(round_[:2]) + body + "".join(round_[2:]) + "</body></html>", "\n".join([head, *(x for part in parts for x in part)])

    made = [(i, *page(i % 4)) for i in range(120)]
    rows = [(i, f"http://h{i % 7}.example/{i}" if i % 3 else "http://hot.example/", html) for i, html, _ in made]
    found = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: text for i, _, text in made}


def test_html_moves_by_host_beyond_the_sent_size(spark, monkeypatch):
    from meridian.llm import htmltext

    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", PAGE % i) for i in range(8)] + [(9, None, None)], "page_id long, url string, html string")
    want = sorted(map(tuple, htmltext.extract_pages(pages).collect()), key=str)
    monkeypatch.setattr(htmltext, "SENT_HOSTS", 0)
    monkeypatch.setattr(htmltext, "HOT", 2)
    assert sorted(map(tuple, htmltext.extract_pages(pages).collect()), key=str) == want


def test_near_vectors_of_several_dimensions(spark):
    """Equal vectors of a rare dimension link too; what the query's SQL says of the same table."""
    import duckdb
    from meridian.llm.pq import near_vectors
    from meridian.llm.q_pq import SQL

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [5.0, -1.0]), (13, [7.0]), (14, [1.0, 2.0, 3.0, 4.0])]
    found = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert found == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({SQL})").fetchall())
    assert (11, 1, 10, False) in found


def test_chat_parts_that_are_not_a_list(spark):
    from meridian.llm.chat import format_turns

    rows = [(1, 0, "user", "t", "null"), (2, 0, "user", "t", "{bad"), (3, 0, "user", "t", '[{"type": "video", "reference": "v"}, "plain", null]'), (4, 0, "user", "t", '{"a": 1}')]
    out = {r["conv_id"]: r["formatted"] for r in format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string"), "content").collect()}
    assert out == {1: "<|im_start|>user\n<|im_end|>\n", 2: "<|im_start|>user\n{bad<|im_end|>\n", 3: '<|im_start|>user\n{"type": "video", "reference": "v"}plainnull<|im_end|>\n', 4: '<|im_start|>user\n{"a": 1}<|im_end|>\n'}

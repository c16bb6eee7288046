"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text in them less their links. A page votes for the generalised
tag-class path of the smallest container that holds almost all of it, headline included; votes are summed per
host in Spark; every page is then read again and its text taken from the host's winning path that it has, or
from its own container where it has none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialise

#: Share of a page's text that its container holds, and the share of it that a host's path must hold to be taken.
WHOLE, ENOUGH = 0.9, 1 / 3
#: A container grows to its parent where that adds a headline before it and at most this share of text.
GROWTH = 0.25
#: Hosts whose paths may be sent round, and the most bytes of them; hosts with more pages than ``HOT`` are dealt over ``SALTS``.
SENT_HOSTS, SENT_BYTES, HOT, SALTS = 100_000, 32 << 20, 100_000, 64

# Fixed values of HTML: elements without content, with raw text, that begin a block, that are never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript iframe noembed noframes template head title nav header footer aside form menu dialog button select option textarea input svg canvas object audio video map".split())
#: Words in class, id or role names of what surrounds a main text.
AROUND = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side|nav|navbar|navigation|menu\w*|header|masthead|footer|foot|comments?|commentlist|replies|reply|respond|disqus|notices?|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|breadcrumbs?|pagination|pager|toolbar|skip|search|complementary|contentinfo|hidden)(?:$|[^a-z])")
#: Elements that a new start tag ends, if they stand open in the nearest block of the kind after the bar.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "step", "parent", "path", "blocks", "bad", "score", "order", "items", "linked")

    def __init__(self, tag: str, step: str, parent: Node | None, bad: bool, order: int):
        self.tag, self.step, self.parent, self.bad, self.order = tag, step, parent, bad, order
        self.path = f"{parent.path}>{step}" if parent else step
        self.score, self.items, self.linked = 0.0, 0, 0


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised path step of a start tag, and whether its names say that it surrounds the main text."""
    if "=" not in attributes:
        return tag, "hidden" in attributes.lower().split()
    names, around = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role"):
            value = unescape(m[2] or m[3] or m[4] or "").lower()
            around = around or bool(AROUND.search(value))
            if key == "class":
                names = ".".join(sorted({_DIGITS.sub("#", x) for x in value.split()}))
        elif key == "hidden" or key == "aria-hidden" and (m[2] or m[3] or m[4]) == "true" or key == "style" and "display:none" in (m[2] or m[3] or "").replace(" ", ""):
            around = True
    return f"{tag}.{names}" if names else tag, around


def parse(html: str) -> list[Block]:
    """The blocks of a page in page order; a block knows the element it stands in. Takes any string."""
    root = Node("#root", "", None, False, 0)
    root.path = ""
    open_: list[Node] = [root]
    blocks: list[Block] = []
    text: list[str] = []
    state = {"linked": 0, "order": 0, "links": 0}

    def flush(node: Node) -> None:
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line and not node.bad:
                blocks.append(Block(node, line, min(state["linked"], len(line))))
            text.clear()
        state["linked"] = 0

    def holder() -> Node:
        return next(n for n in reversed(open_) if n.tag in BLOCK or n is root or n.bad)

    def put(piece: str) -> None:
        if piece and not open_[-1].bad:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if state["links"]:
                state["linked"] += len(_SPACE.sub(" ", piece))

    def close(to: int) -> None:
        for node in open_[to:]:
            if node.tag == "a":
                state["links"] -= 1
        if any(n.tag in BLOCK or n.bad for n in open_[to:]):
            flush(holder())
        del open_[to:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if html.startswith("<![CDATA[", m.start()):
                put(html[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                put(" ")
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    close(i)
                    break
                if open_[i].tag in ("table", "article", "main") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush(holder())
            ends = ENDS.get(tag, ("p",))
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in ends:
                    close(i)
                    if tag not in ("tr", "td", "th"):
                        break
                elif open_[i].tag in SCOPE.get(tag, ()) or tag not in SCOPE and open_[i].tag in BLOCK:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            if tag == "textarea" or tag in DROPPED:
                continue
        if (m[3] or "").rstrip().endswith("/") and tag not in BLOCK and tag != "a":
            continue
        step, around = _step(tag, m[3] or "")
        state["order"] += 1
        parent = open_[-1]
        bad = parent.bad or tag in DROPPED or around and tag not in ("html", "body", "article", "main")
        if bad and not parent.bad:
            flush(holder())
        open_.append(Node(tag, step, parent, bad, state["order"]))
        if tag == "a":
            state["links"] += 1
    flush(holder())
    return _without_menus(blocks)


def _without_menus(blocks: list[Block]) -> list[Block]:
    """Leaves out lists of at least two items that are almost all links."""
    lists: dict[int, list] = {}
    member: list[int | None] = []
    for b in blocks:
        node = b.node
        while node is not None and node.tag not in ("ul", "ol", "dl"):
            node = node.parent
        member.append(node.order if node is not None else None)
        if node is not None:
            entry = lists.setdefault(node.order, [0, 0, 0])
            entry[0] += 1
            entry[1] += len(b.text)
            entry[2] += b.linked
    menus = {k for k, (n, chars, linked) in lists.items() if n >= 2 and linked >= 0.8 * chars}
    return [b for b, k in zip(blocks, member, strict=True) if k not in menus] if menus else blocks


def _worth(block: Block) -> int:
    """Characters outside links; none where links are more than half."""
    return 0 if block.linked > 0.5 * len(block.text) else len(block.text) - block.linked


def scores(blocks: list[Block]) -> dict[Node, int]:
    """The worth of all blocks in each container, from inside out."""
    found: dict[Node, int] = {}
    for b in blocks:
        if worth := _worth(b):
            node: Node | None = b.node
            while node is not None:
                found[node] = found.get(node, 0) + worth
                node = node.parent
    return found


_INLINE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt".split())


def container(blocks: list[Block], found: dict[Node, int]) -> Node | None:
    """The smallest container that holds almost all of the page's text, grown to take in a headline before it."""
    if not found:
        return None
    total = max(found.values())
    best = max((n for n, s in found.items() if s >= WHOLE * total), key=lambda n: n.order)
    while best.parent is not None and best.tag in _INLINE:
        best = best.parent
    while best.parent is not None and best.tag not in ("article", "main", "body"):
        inside = _inside(blocks, lambda n, best=best: n is best)
        above = _inside(blocks, lambda n, best=best: n is best.parent)
        first = inside.index(True)
        if not any(b.node.tag in ("h1", "h2") and x for b, x in zip(blocks[:first], above[:first], strict=True)) or found[best.parent] > (1 + GROWTH) * found[best]:
            break
        best = best.parent
    return best


def _inside(blocks: list[Block], chosen) -> list[bool]:
    """For each block, whether a container that is ``chosen`` holds it."""
    known: dict[int, bool] = {}

    def within(node: Node) -> bool:
        chain = []
        at: Node | None = node
        while at is not None and at.order not in known and not chosen(at):
            chain.append(at.order)
            at = at.parent
        answer = at is not None and (known[at.order] if at.order in known else True)
        known.update(dict.fromkeys(chain, answer))
        return answer

    return [within(b.node) for b in blocks]


def vote(html: str) -> str | None:
    """The path of a page's container; None for a page without text."""
    blocks = parse(html)
    best = container(blocks, scores(blocks))
    return None if best is None else best.path


def extract(html: str, paths: list[str]) -> str:
    """The text at the first of ``paths`` that holds enough of the page, else at the page's own container."""
    blocks = parse(html)
    found = scores(blocks)
    own = container(blocks, found)
    if own is None:
        return "\n".join(b.text for b in blocks if b.linked <= 0.5 * len(b.text))
    there = {n.path for n in found}
    total = sum(map(_worth, blocks))
    for path in (*(p for p in paths if p in there), own.path):
        inside = _inside(blocks, lambda n, path=path: n.path == path)
        if path == own.path or sum(_worth(b) for b, x in zip(blocks, inside, strict=True) if x) >= ENOUGH * total:
            break
    return "\n".join(b.text for b, x in zip(blocks, inside, strict=True) if x)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user or port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, pages, paths``: the paths that two pages or more of a host vote for, most votes first.

    Votes are summed before they move. A path with one vote is its page's own, so it needs no telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (path := vote(html.as_py() or "")) is not None:
                    sums[h, path] = sums.get((h, path), 0) + 1
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()), pa.int64())], ["host", "path", "votes"])

    cast = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, path string, votes long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes")).where("votes > 1")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))
    return summed.groupBy("host").agg(F.sum("votes").alias("pages"), F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``; other columns are ignored).

    A null or empty html, or one without main text, gives an empty text; a null url votes on the host "".
    Repeated rows are extracted each. An empty table gives no rows. The whole html is read whatever its
    length. Where all hosts' paths are small they are sent round and no page moves; else pages move by host,
    those of a host with many pages over ``SALTS`` keys."""
    paths = materialise(host_paths(pages), "host-paths")
    size = paths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.aggregate("paths", F.lit(0), lambda n, x: n + F.octet_length(x))), F.lit(0)).alias("bytes")).first()
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html.as_py() or "", known or []) for html, known in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size["n"] <= SENT_HOSTS and size["bytes"] <= SENT_BYTES:
        joined = keyed.join(F.broadcast(paths.select("host", "paths")), "host", "left")
    else:
        # as many hosts as the table has times HOT pages, at most
        hot = paths.where(F.col("pages") > HOT).select("host", F.lit(SALTS).alias("salts"))
        salts = F.coalesce("salts", F.lit(1))
        dealt = keyed.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts)).drop("salts")
        copied = paths.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).select("host", "salt", "paths")
        joined = dealt.join(copied, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")

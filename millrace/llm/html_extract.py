"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by the text that stands in their
paragraphs (long sentences count, links and short items don't), and the page votes
for the generalised path (tags with their first class, digits as #) of its best one.
Spark counts the votes of each host.  Second pass: each page is extracted from the
container at its host's winning path, if it has one of a fair score, else from its
own best container.

Text: character references decoded, white space inside a block one space, blocks in
page order joined by two line breaks; nothing is dropped but what is not the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Winning paths of more bytes than this are not broadcast.
BROADCAST_BYTES = 32_000_000
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^'\">]*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes select option canvas object audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption hr legend".split()
)
#: Elements that are never part of an article; roles that say the same.
DROP_TAGS = frozenset("nav footer aside menu dialog search button input label head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that mark what is not the article, where they are a class or id by themselves or with PLACES only ...
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
    "related recommended recommendations trending comment comments commentlist disqus replies respond discussion pagination pager copyright disclaimer search skip".split()
)
PLACES = frozenset(
    "box boxes area section list wrapper wrap container block inner outer left right top bottom primary secondary item items group panel slot unit bar button buttons link links form posts articles "
    "stories site page global desktop mobile sticky floating bottom body row col column text icon icons us this my".split()
)
#: ... and words that hint at it as a part of a class or id; such an element goes only if it holds a minor share of the page.
WEAK = STRONG | frozenset("side rail foot alert social popular reply reactions tag tags legal hidden toc feedback crumb crumbs bio byline recommendation".split())
#: Less than this share of the page's running text is minor.
MINOR = 1 / 3
#: Elements of the text itself: only a strong class drops them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody table dl dd dt ul ol figure figcaption caption".split())
_PARTS = re.compile(r"[\s_-]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Closing an element closes these when they were left open.
_CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "div", "article", "section")
_NONE, _HINT, _MARKED, _NEVER = range(4)


class Node:
    """An element.  ``block``, ``owner``: nearest element, itself included, that is a block, or a block or marked."""

    __slots__ = ("tag", "key", "parent", "place", "end", "mark", "block", "owner", "path", "run", "article", "dropped", "score")

    def __init__(self, tag: str, key: str, parent: Node | None, place: int, mark: int):
        self.tag, self.key, self.parent, self.place, self.end, self.mark = tag, key, parent, place, place, mark
        own = parent is None or tag in BLOCK
        self.block = self if own else parent.block
        self.owner = self if own or mark else parent.owner
        #: of the blocks from the root to here; compared in this process only
        self.path = 0 if parent is None else hash((parent.path, key)) if own else parent.path
        self.run = self.score = 0.0
        self.article = self.dropped = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _mark(tag: str, a: dict[str, str], classes: str, in_article: bool) -> int:
    if tag in DROP_TAGS or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in DROP_ROLES or _HIDDEN.search(a.get("style", "")):
        return _NEVER
    if tag in ("html", "body", "main"):
        return _NONE
    if tag in ("form", "fieldset") or tag == "header" and not in_article:
        return _MARKED
    mark = _NONE
    tokens = classes.lower().split()
    if tag in BLOCK and tag not in TEXTUAL:
        tokens += a.get("id", "").lower().split()
    for token in tokens:
        parts = [w for x in _PARTS.split(token) if (w := x.strip("0123456789"))]
        found = [w in STRONG for w in parts]
        if any(found) and all(f or w in PLACES for f, w in zip(found, parts)) and not (in_article and "header" in parts):
            return _MARKED
        if tag in BLOCK and tag not in TEXTUAL and tag != "article" and any(w in WEAK for w in parts) and not (in_article and "header" in parts):
            mark = _HINT
    return mark


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in one pass forward."""
    at, size = 0, len(page)
    broken = False  # some tag has no end outside quotes: from there on any ">" ends one
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            if end < 0:
                yield "text", page[at:], ""
                return
            at = end + 1
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            yield "text", "<", ""
            at += 1
            continue
        end = name.end()
        while not broken:
            end = _PLAIN.match(page, end).end()
            if end >= size:
                broken = True
            elif page[end] == ">":
                break
            else:
                end = page.find(page[end], end + 1) + 1
                broken = not end
        if broken:
            end = page.find(">", name.end())
            if end < 0:
                yield "text", page[at:], ""
                return
        tag, raw = name[0].lower(), page[name.end() : end]
        at = end + 1
        if closing:
            yield "close", tag, ""
        elif tag in RAW:
            if not raw.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
        else:
            yield "open", tag, raw


def parse(page: str) -> tuple[list[tuple[Node, list[tuple[Node, str, int]]]], list[Node]]:
    """Blocks (element, pieces) in page order, and all elements in page order.

    A block is a run of text between block elements; its pieces are (owner, raw text,
    characters in links), cut where something marked begins or ends.  Time grows with
    the length of the page, however deep it nests and whatever is left open.
    """
    root = Node("#root", "#root", None, 0, _NONE)
    stack, nodes = [root], [root]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    blocks: list[tuple[Node, list[tuple[Node, str, int]]]] = []
    pieces: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0

    def piece() -> None:
        nonlocal linked
        if text:
            pieces.append((stack[-1].owner, "".join(text), linked))
            text.clear()
        linked = 0

    def flush() -> None:
        piece()
        if pieces:
            blocks.append((stack[-1].block, pieces.copy()))
            pieces.clear()

    def close_to(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    for kind, tag, raw in _tags(page):
        open_at = places.setdefault(tag, []) if kind != "text" else None
        if kind == "text":
            text.append(tag)
            if places.get("a"):
                linked += len(tag)
        elif kind == "open":
            if tag == "br":
                text.append(" ")
            if tag in BLOCK:
                flush()
                # a block ends an open paragraph, with what stands open in it
                top = stack[-1].block
                if top.tag == "p":
                    close_to(places["p"][-1])
                for same in _CLOSES.get(tag, ()):
                    if places.get(same) and places[same][-1] > max((places[x][-1] for x in _LISTS if places.get(x)), default=0):
                        close_to(places[same][-1])
            if tag not in VOID and not raw.endswith("/"):
                a = _attributes(raw)
                classes = a.get("class", "")
                first = classes.split()[0] if classes.split() else ""
                mark = _mark(tag, a, classes, bool(places.get("article") or places.get("main")))
                node = Node(tag, tag + ("." + re.sub(r"\d+", "#", first.lower()) if first else ""), stack[-1], len(nodes), mark)
                if mark:
                    piece()
                open_at.append(len(stack))
                stack.append(node)
                nodes.append(node)
        elif not open_at:
            if tag in BLOCK:
                flush()
        else:
            i = open_at[-1]
            if tag in BLOCK:
                flush()
                close_to(i)
            elif stack[-1].block.tag == "#root" or stack[-1].block.place < stack[i].place:  # inline ends do not close blocks
                if stack[-1].owner.place >= stack[i].place:
                    piece()
                close_to(i)
    flush()
    for n in reversed(nodes[1:]):
        n.parent.end = max(n.parent.end, n.end)
    return blocks, nodes


def _clean(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw)).strip()


def _path(node: Node) -> str:
    keys = []
    while node.parent:
        if node.tag in BLOCK:
            keys.append(node.key)
        node = node.parent
    return "/".join(reversed(keys))


def _path_hash(path: str) -> int:
    at = 0
    for key in path.split("/") if path else ():
        at = hash((at, key))
    return at


def _value(text: str, linked: int, raw: int) -> float:
    """Words of running text: words of links don't count; length or a full stop tells running text."""
    words = text.count(" ") + 1
    return words * max(0.0, 1 - 2 * linked / max(raw, 1)) * (1.0 if words > 8 or text[-1] in ".!?…。" else 0.3)


def _decide(blocks, nodes: list[Node]) -> None:
    """Which elements are dropped.  What is marked stays if it holds the article: a heading of the page or an
    article element, and no minor share of the running text; what is only hinted at stays by such a share alone."""
    for n in nodes[1:]:
        n.dropped = n.parent.dropped or n.mark == _NEVER
    for _, pieces in blocks:
        for owner, raw, linked in pieces:
            if not owner.dropped and (t := _clean(raw)):
                owner.run += _value(t, linked, len(raw))
    for n in reversed(nodes[1:]):
        n.parent.run += n.run
        n.parent.article |= n.article or n.tag in ("article", "main", "h1") and not n.mark and not n.dropped
    least = MINOR * nodes[0].run
    kept = [n.dropped for n in nodes]
    for n in nodes[1:]:
        small = n.run < least
        n.dropped = n.dropped or n.parent.dropped or n.mark == _HINT and small or n.mark == _MARKED and (small or not n.article)
    if nodes[0].run and not any(not owner.dropped and raw.strip() for _, pieces in blocks for owner, raw, _ in pieces):
        for n, was in zip(nodes, kept):
            n.dropped = was


def texts_of(blocks, nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of the blocks that are not dropped; white space inside one is one space."""
    _decide(blocks, nodes)
    out = []
    for node, pieces in blocks:
        stay = [p for p in pieces if not p[0].dropped]
        if stay and (t := _clean("".join(p[1] for p in stay))):
            out.append((node, t, sum(p[2] for p in stay)))
    return out


def score(texts: list[tuple[Node, str, int]], nodes: list[Node]) -> Node | None:
    """Scores every container; returns the best one.

    A block's running words count for its container and, less the further up, for those around it.  A container that
    is no article or main takes in its neighbours where they are running text as well.
    """
    for node, text, linked in texts:
        up = node.parent if node.tag in TEXTUAL and node.parent is not None else node
        up.score += _value(text, linked, len(text))
    for n in reversed(nodes[1:]):
        n.parent.score += 0.9 * n.score
    best = None
    for n in nodes:
        if n.dropped or n.tag not in BLOCK and n.parent is not None or n.tag == "p":
            continue
        n.score *= {"article": 1.3, "main": 1.15}.get(n.tag, 1.0)
        if n.score > 0 and (best is None or n.score > best.score * 1.0001):
            best = n
    while best is not None and best.tag not in ("article", "main", "body", "html", "#root"):
        around = best.parent.block
        if around.tag in ("body", "html", "#root"):
            break
        more = [(t, linked) for n, t, linked in texts if around.place <= n.place <= around.end and not best.place <= n.place <= best.end]
        if any(3 * linked > len(t) or t.count(" ") < 8 for t, linked in more):
            break
        best = around
    return best


def text_of(texts: list[tuple[Node, str, int]], top: Node) -> str:
    return "\n\n".join(t for node, t, _ in texts if top.place <= node.place <= top.end)


def host_of(url):
    """A-Z lower-cased host of a url column; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for page in batch.column("html").to_pylist():
            best = None
            if page:
                blocks, nodes = parse(page)
                best = score(texts_of(blocks, nodes), nodes)
            paths.append(_path(best) if best is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])


def main_text(page: str | None, winner: str | None = None) -> str:
    """The text of a page at its host's winning path, if it has a container of a fair score there, else at its own best one."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    texts = texts_of(blocks, nodes)
    top = score(texts, nodes)
    if top is None:
        return ""
    if winner is not None:
        path = _path_hash(winner)
        there = [n for n in nodes if n.path == path and not n.dropped and n.tag in BLOCK and n.score >= 0.4 * top.score]
        if there:
            top = max(there, key=lambda n: n.score)
    return text_of(texts, top)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, winner) for page, winner in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path most pages of each host vote for; ties to the greatest path.

    Votes are counted with partial sums, so a host with a third of all pages is no burden.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string")
    counts = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    return counts.groupBy("host").agg(F.max(F.struct("n", F.col("path"))).alias("w")).select("host", F.col("w.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages`` (page_id, url, html).

    Null, empty and textless pages have an empty text.  Pages with a null url share the
    host ''.  Further columns are ignored; repeated rows stay; an empty table gives an
    empty one.  The winning paths are broadcast if their sizes, which are counted, allow it,
    so that pages aren't moved; else Spark joins by host and may split a hot one.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    won = Scratch(pages.sparkSession).save(consensus_paths(pages))
    size = won.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    keyed = pages.withColumn("host", host_of(F.col("url")))
    joined = keyed.join(F.broadcast(won) if size <= BROADCAST_BYTES else won, "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

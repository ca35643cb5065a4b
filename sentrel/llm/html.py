"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over tags and text slots. Pages of one host are
aligned one after another: tags that a page lacks, or has beyond the wrapper, become optional
groups, neighbours of one kind become a repeated group, and texts that differ become slots, while
texts equal on all pages stay part of the template. Aligning is associative enough to be done in
parts: each task aligns the pages it reads, and the tasks' wrappers are aligned with one another.

The wrapper then tells where a host may keep its article, in order of preference; every page gives
the texts in the first of these places that it fills. Pages of no host get a wrapper each. Which
places these are follows from tags, marks and the share of links in the wrapper; texts that nearly
all pages of a host have are its template's, wherever they stand, and are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.llm.common import slices, whole
from sentrel.llm.urls import host_of

#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav"
    " noscript ol optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead"
    " title tr ul video audio canvas object".split()
)
#: Elements without content, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg".split())
#: Elements that never hold main text.
BOILER = frozenset(
    "head nav header footer aside form script style noscript iframe button select template svg dialog menu"
    " textarea fieldset title video audio canvas object".split()
)
#: Words in a class, id or role that mark what is no main text, and those that mark main text.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar"
    " navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies"
    " consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social comment comments reply replies respondent disqus related recommended widget search pagination pager"
    " copyright disclaimer legal contentinfo complementary".split()
)
#: Marks that name a thing of the page only alone or beside one another or such neutral words: an
#: ``entry-header`` or a ``legal-opinion`` is neither a page's header nor its legal notice.
WEAK_WORDS = frozenset(
    "header legal notice alert search copyright disclaimer signup login popup modal overlay subscribe subscription"
    " recommended reply replies share sharing".split()
)
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box buttons container fixed form global group id inner item items js left link links list"
    " outer page panel right row section site sticky top wrap wrapper".split()
)
#: What follows such a word in a mark says what the element has or lacks, not what it is.
HAVING = frozenset("has have no not with without".split())
#: Elements that are never left out for their marks.
WHOLE = frozenset("html body main article".split())
MAIN_WORDS = frozenset("article articlebody main content post story entry body text".split())
#: Elements that may hold a whole article, and those that are menus if most of their text is links.
CONTAINERS = frozenset("html body div section table tbody tr td".split())
LISTS = frozenset("ul ol dl div table section".split())
#: Elements that end an open element of these kinds when they begin.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
#: A tag ends at its bracket or where the next one begins; nothing is read twice in search of an end.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))",
    re.DOTALL,
)
_MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Open elements of a page that are told apart; deeper ones belong to the last of these, with their texts.
DEEPEST = 200
#: Children of a place that keep their order; of more, those of one kind become one repeated group.
MOST_KIDS = 64
#: Share of a host's different pages that a template's text stands on, and the fewest such pages.
SHARED, LEAST_PAGES = 0.8, 8
#: Text of a slot that is kept to see whether it differs from page to page.
KEPT_CHARS = 200


class Node:
    """An element of a page or a group of a wrapper. ``kids`` are nodes and text slots in order.

    ``key`` is the tag with the words of its marks; ``#`` is a text slot. ``pages`` counts pages
    that have it, ``chars`` and ``linked`` the text in it and the part inside links.
    """

    __slots__ = ("key", "kids", "optional", "repeated", "text", "pages", "chars", "linked")

    def __init__(self, key: str):
        self.key, self.kids, self.optional, self.repeated = key, [], False, False
        self.text, self.pages, self.chars, self.linked = None, 1, 0, 0

    @property
    def tag(self) -> str:
        return self.key.partition(".")[0]

    def words(self) -> set[str]:
        return set(self.key.split(".")[1:])


def marks_of(said: str) -> set[str]:
    """Words of an element's class, id and role that say what it is."""
    out: set[str] = set()
    for mark in said.split():
        words = _WORDS.findall(mark)
        for i, word in enumerate(words):
            if word in HAVING:
                words = words[:i]
                break
        if any(w not in BOILER_WORDS and w not in NEUTRAL_WORDS for w in words):
            words = [w for w in words if w not in WEAK_WORDS]
        out.update(words)
    return out


def parse(html: str) -> Node:
    """The tree of a page's block elements and text slots; inline elements leave no trace.

    Open elements that HTML closes silently are closed, end tags without a start are skipped, and
    an end tag or a cut page closes whatever is open within. Elements below ``DEEPEST`` open ones
    begin and end blocks but are no nodes.
    """
    root = Node("")
    stack, parts, state = [root], [], {"links": 0, "linked": 0}
    below: Counter[str] = Counter()

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            slot = Node("#")
            slot.text, slot.chars, slot.linked = text, len(text), min(len(text), state["linked"])
            stack[-1].kids.append(slot)
        state["linked"] = 0

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    at = 0
    while True:
        found = _TOKEN.search(html, at)
        if found is None:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        closing, tag, marks = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag == "a":
            state["links"] = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if closing:
            if below[tag]:
                below[tag] -= 1
                flush()
            elif tag in BLOCKS and any(n.tag == tag for n in stack[1:]):
                flush()
                while stack.pop().tag != tag:
                    pass
                below.clear()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            flush()
            continue
        if tag not in BLOCKS:
            continue
        flush()
        for open_tag in CLOSES.get(tag, ("p",)):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == open_tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "body", "td"):
                    break
        if tag in VOID:
            continue
        if len(stack) > DEEPEST:
            if not marks.endswith("/"):
                below[tag] += 1
            continue
        said = " ".join(m[2] or m[3] or m[4] or "" for m in _MARK.finditer(marks)).lower()
        node = Node(".".join([tag, *sorted(marks_of(said))]))
        stack[-1].kids.append(node)
        stack.append(node)
        if marks.endswith("/"):
            stack.pop()
    flush()
    return root


def fold(node: Node) -> Node:
    """Make neighbours of one kind a repeated group, innermost first."""
    out: list[Node] = []
    for kid in map(fold, node.kids):
        if out and out[-1].key == kid.key and kid.key != "#":
            pages = out[-1].pages
            out[-1] = align(out[-1], kid)
            out[-1].repeated, out[-1].pages = True, pages
        else:
            out.append(kid)
    node.kids = gather(out)
    for kid in node.kids:
        node.chars += kid.chars if kid.key == "#" or node.key != "#" else 0
        node.linked += kid.linked
    return node


def gather(kids: list[Node]) -> list[Node]:
    """The children as they are or, of more than ``MOST_KIDS``, one repeated group of each kind."""
    if len(kids) <= MOST_KIDS:
        return kids
    kinds: dict[str, Node] = {}
    for kid in kids:
        first = kinds.get(kid.key)
        if first is None:
            kinds[kid.key] = kid
        else:
            pages = max(first.pages, kid.pages)
            kinds[kid.key] = align(first, kid)
            kinds[kid.key].repeated, kinds[kid.key].pages = kid.key != "#", pages
    return list(kinds.values())


def align(a: Node, b: Node) -> Node:
    """One expression for two of the same kind."""
    out = Node(a.key)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    out.pages, out.chars, out.linked = a.pages + b.pages, a.chars + b.chars, a.linked + b.linked
    out.text = a.text if a.text == b.text else None
    if not a.kids and not b.kids:
        return out
    mine, theirs = [k.key for k in a.kids], [k.key for k in b.kids]
    if mine == theirs:
        out.kids = [align(x, y) for x, y in zip(a.kids, b.kids, strict=True)]
        return out
    kids: list[Node] = []
    for kind, i, j, k, m in SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes():
        if kind == "equal":
            kids += [align(x, y) for x, y in zip(a.kids[i:j], b.kids[k:m], strict=True)]
        else:
            for lone in a.kids[i:j] + b.kids[k:m]:
                lone.optional = True
                kids.append(lone)
    # Mismatches may have put one kind side by side: that is a repeated group.
    for kid in kids:
        if out.kids and out.kids[-1].key == kid.key:
            pages = max(out.kids[-1].pages, kid.pages)
            out.kids[-1] = align(out.kids[-1], kid)
            out.kids[-1].repeated, out.kids[-1].pages = kid.key != "#", pages
        else:
            out.kids.append(kid)
    out.kids = gather(out.kids)
    return out


def pack(node: Node) -> list:
    flags = (1 if node.optional else 0) | (2 if node.repeated else 0)
    text = node.text if node.text is not None and len(node.text) <= KEPT_CHARS else None
    return [node.key, flags, text, node.pages, node.chars, node.linked, [pack(k) for k in node.kids]]


def unpack(packed: list) -> Node:
    node = Node(packed[0])
    node.optional, node.repeated = bool(packed[1] & 1), bool(packed[1] & 2)
    node.text, node.pages, node.chars, node.linked = packed[2:6]
    node.kids = [unpack(k) for k in packed[6]]
    return node


def expression(node: Node) -> str:
    """The wrapper written out: ``#`` for a slot, ``( )?`` and ``( )+`` for groups."""
    if node.key == "#":
        inner = "#" if node.text is None else json.dumps(node.text, ensure_ascii=False)
    else:
        inner = f"<{node.key}>" + "".join(map(expression, node.kids)) + f"</{node.tag}>" if node.key else "".join(
            map(expression, node.kids)
        )
    if node.repeated and node.optional:
        return f"({inner})*"
    return f"({inner})+" if node.repeated else f"({inner})?" if node.optional else inner


def _boiler(node: Node) -> bool:
    return node.tag in BOILER or (node.tag not in WHOLE and bool(node.words() & BOILER_WORDS))


def _gain(node: Node) -> int:
    """Characters that stand outside links and marked places."""
    if node.key == "#":
        return node.chars - node.linked
    return 0 if _boiler(node) else sum(map(_gain, node.kids))


def _container(node: Node) -> tuple[Node, tuple]:
    """The innermost container that holds most of the text that is not in links, and its path."""
    path: tuple = ()
    while True:
        total = _gain(node)
        inner = [k for k in node.kids if k.tag in CONTAINERS and 10 * _gain(k) >= 8 * total > 0]
        if not inner:
            return node, path
        node = inner[0]
        path = (*path, node.key)


def main_places(wrapper: Node) -> list[set[tuple[str, ...]]]:
    """Paths (keys from the root) of the wrapper's places that hold main text, by preference.

    Article and main elements come first, then elements whose marks say so, then what holds most
    of the text that is not in links, and last all places. Places marked as something else are
    taken out wherever they stand, and so are menus: groups with more text in links than beside
    them.
    """

    def named(node: Node, path: tuple, test) -> Iterator[tuple[Node, tuple]]:
        for kid in node.kids:
            if kid.key == "#" or _boiler(kid):
                continue
            if test(kid):
                yield kid, (*path, kid.key)
            else:
                yield from named(kid, (*path, kid.key), test)

    branches = [
        [(n, p) for n, p in named(wrapper, (), test) if _gain(n)]
        for test in (
            lambda n: n.tag == "article" or "articlebody" in n.words(),
            lambda n: n.tag == "main" or "main" in n.words(),
            lambda n: bool(n.words() & MAIN_WORDS) and n.tag not in ("html", "body"),
        )
    ]
    branches += [[_container(wrapper)], [(wrapper, ())]]

    def collect(node: Node, path: tuple, places: set) -> set[tuple[str, ...]]:
        for kid in node.kids:
            here = (*path, kid.key)
            if kid.key == "#":
                places.add(here)
            elif not _boiler(kid) and not (kid.linked * 2 > kid.chars and kid.tag in LISTS):
                collect(kid, here, places)
        return places

    found = [set().union(*[collect(n, p, set()) for n, p in branch]) for branch in branches]
    return [places for places in found if places]


def extract(page: Node, places: list[set[tuple[str, ...]]]) -> list[str]:
    """Texts of a page, in page order, in the first of the wrapper's main places that it fills.

    A page that only fills the last, all places of the wrapper, gives its own largest container.
    """

    def walk(node: Node, path: tuple, within: set) -> Iterator[str]:
        for kid in node.kids:
            here = (*path, kid.key)
            if kid.key != "#":
                yield from walk(kid, here, within)
            elif here in within:
                yield kid.text

    for within in places[:-1]:
        out = list(walk(page, (), within))
        if out:
            return out
    return list(walk(*_container(page), places[-1])) if places else []


def _texts(node: Node) -> Iterator[str]:
    for kid in node.kids:
        if kid.key == "#":
            yield kid.text
        elif not _boiler(kid):
            yield from _texts(kid)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def without_shared(texts: list[str], shared: set[int]) -> list[str]:
    """The texts that are not the template's. A page that would lose most of its text keeps all:
    it is a copy of the host's other pages."""
    own = [t for t in texts if _digest(t) not in shared]
    return own if 2 * sum(map(len, own)) >= sum(map(len, texts)) else texts


def shared_texts(pages: DataFrame) -> DataFrame:
    """(host, shared) from ``host, html`` rows: digests of the texts that stand on ``SHARED`` of the
    host's pages, counting pages of the same texts once. There are few: a text needs most pages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 22):
            found = [sorted(set(map(_digest, _texts(parse(h))))) for h in batch.column("html").to_pylist()]
            alike = [_digest(str(f)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(alike, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["host", "page", "texts"],
            )

    rows = pages.mapInArrow(each, "host string, page long, texts array<bigint>")
    # A row per page counts the pages (no text), one per text the text.
    with_page = F.explode(F.concat(F.array(F.lit(None).cast("long")), "texts")).alias("t")
    counted = rows.dropDuplicates(["host", "page"]).select("host", with_page).groupBy("host", "t").count()
    counted = materialise(counted.where(F.col("t").isNull() | (F.col("count") >= SHARED * LEAST_PAGES)))
    total = counted.where("t is null").select("host", F.col("count").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    often = counted.where("t is not null").join(total, "host").where(F.col("count") >= SHARED * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("t").alias("shared"))


def _merge(packed: list[str]) -> str:
    wrapper = unpack(json.loads(packed[0]))
    for other in packed[1:]:
        wrapper = align(wrapper, unpack(json.loads(other)))
    return json.dumps(pack(wrapper))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from ``host, html`` rows: one wrapper per host, as JSON.

    All pages take part. A task keeps one wrapper per host it meets; what tasks send is aligned in
    groups of (host, part) first and then per host, so a host with very many pages never meets in
    one task as pages, nor all at once as wrappers.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Node] = {}
        for batch in slices(batches, "html", 1 << 22):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = fold(parse(html))
                made[host] = align(made[host], tree) if host in made else tree
            if len(made) > 5000:
                yield _rows(made)
                made.clear()
        if made:
            yield _rows(made)

    def _rows(made: dict[str, Node]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"host": pa.array(made, pa.string()), "wrapper": pa.array([json.dumps(pack(n)) for n in made.values()])}
        )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["wrapper"])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [_merge(texts)]})

    parts = pages.mapInArrow(each, "host string, wrapper string")
    part = F.pmod(F.xxhash64("wrapper"), F.lit(32))
    some = parts.withColumn("part", part).groupBy("host", "part").applyInPandas(join, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(join, "host string, wrapper string")


def main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row of ``pages`` (``url``, ``html``): key, url, ``text`` and ``n_chars``.

    Null html counts as empty and gives an empty text. Pages without a host (a null url has
    none) may come from anywhere: each gets a wrapper of its own, and so does a host with one page. Rows stay as they are,
    repeated ones too; an empty table gives an empty table.
    """
    kind = pages.select(f"`{key}`").schema[0].dataType.simpleString()
    rows = pages.select(
        F.col(f"`{key}`").alias("id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    wrappers = infer(rows.where("host <> ''").select("host", "html")).withColumnRenamed("host", "h")
    shared = shared_texts(rows.where("host <> ''").select("host", "html")).withColumnRenamed("host", "h")
    wrappers = wrappers.join(shared, "h", "left")
    both = rows.join(wrappers, F.col("host") == F.col("h"), "left").select("id", "url", "html", "wrapper", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[set]] = {}
        for batch in slices(batches, "html", 1 << 22):
            texts = []
            for html, wrapper, common in zip(*[batch.column(c).to_pylist() for c in ("html", "wrapper", "shared")], strict=True):
                if wrapper is None:
                    places = main_places(fold(parse(html)))
                elif wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = main_places(unpack(json.loads(wrapper)))
                said = extract(parse(html), places if wrapper is None else known[wrapper])
                texts.append("\n".join(without_shared(said, set(common)) if common else said))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [key, "url", "text", "n_chars"],
            )

    return both.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars long")

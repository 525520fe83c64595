"""HTML extraction by wrapper induction: pages of a host are aligned by simple tree matching, and what varies is content.

Every page of a host has a say. A page becomes a DOM tree, without the elements that by tag, role or class hold menus,
headers, footers, sidebars, notices, adverts, forms, code or reader comments. Its texts are its article and main elements,
each whole, and every block outside them. Pages that name such an element and pages that name none are two kinds, each
with its own reference tree and counts.

1. Layouts: like siblings are folded to one node, so a tree has few nodes, each with a path of signatures (tag and
   classes). A host's commonest layout of a kind is its reference tree.
2. Alignment: simple tree matching of each page's tree with the reference: the most nodes that match in order. Since
   siblings differ after folding, a node can match one node only, and the best children are the heaviest rising
   subsequence; it is found without recursion in n log n.
3. Constants: a text is template where it stands in every page whose tree matches its node, and the node matches in more
   than half of the host's pages of that kind and in ``LEAST`` at least; every other text is slot. Pages count by content:
   copies under other urls count once. A host with fewer than ``LEAST`` different pages of a kind has no constant texts there.
4. Every page is then parsed by itself. Its text is its article and main elements that are slots, whole, whatever repeats
   inside; a page that names none has its blocks that are slots. So every such slot is in its text, however short. If all
   that a page names is template, names and matching disagree: both these elements and the slots outside them stay.

Counting: a task keeps for each (host, kind, path) the texts that all its pages so far share, and sends these with
counts, as hashes; sums by (host, kind, path, text) leave the constants. So a host with a third of all pages sends
small rows from each task. Reference trees and wrappers (hashes of a host's constants) are broadcast when counted to be
few, and joined by host otherwise. Copies are left out of the counting by a broadcast of the rows to skip or to take, whichever
are few, and by a join on the row's hash otherwise.

A null html is empty: its text is empty. Pages without a host (a null or odd url) form one group. Repeated rows
each get their text, and count once. Ties: of equally common layouts the least hash is the reference. Texts of any length and trees of
any depth are read whole. An empty table gives no rows; columns other than the three are not read, so their names cannot clash.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written

LEAST, BROADCAST_HOSTS, BROADCAST_ROWS = 5, 20_000, 500_000
#: Nodes of all reference trees together (16 bytes each) that are broadcast; more are joined by host.
BROADCAST_NODES = 2_000_000
#: (path, text) pairs that a task keeps before it sends them.
HELD = 200_000
ROOTS = ("article", "main")
#: Fixed values of HTML: elements without an end tag, with raw text, and that make blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, roles and words of class or id that are never the article; words that may stand beside these in a name.
_OUT_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog object".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended comment comments disqus respond replies reviews search toolbar pagination widget skip".split()
)
_BESIDE = frozenset("site page main top bottom left right box bar block container wrapper wrap section list item items area inner outer content primary secondary global post posts user buttons button links link icons area zone slot unit text message form panel column col header title global mobile desktop sticky fixed 1 2 3".split())
#: What an article element is, if its class says so: one of the readers' comments.
_COMMENTS = frozenset("comment comments respond reply replies".split())
#: A tag ends at the first > outside the quotes of an attribute's value.
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|$)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    __slots__ = ("tag", "sig", "out", "kids")

    def __init__(self, tag: str, sig: str, out: bool):
        self.tag, self.sig, self.out = tag, sig, out
        self.kids: list["Node | str"] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)}


def _says(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id is one of the words, alone or beside words that say where or how it is shown."""
    parts = [p for p in re.split(r"[-_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if p]
    return any(p in words for p in parts) and all(p in words or p in _BESIDE or p.isdigit() for p in parts)


@lru_cache(4096)
def _open(tag: str, raw: str) -> tuple[str, bool]:
    """Signature of an element, and whether it is never content."""
    a = _attributes(raw) if raw.strip(" /") else {}
    out = tag in _OUT_TAGS or a.get("role", "").lower() in _OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "main"):
        words = _COMMENTS if tag == "article" else _OUT_WORDS
        out = out or any(_says(name, words) for name in f"{a.get('class', '')} {a.get('id', '')}".split())
    return tag + "".join(f".{c}" for c in sorted(a.get("class", "").split())), out


def parse(text: str) -> Node:
    """A forgiving DOM: elements with their text and elements in order."""
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _BLOCK:  # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        sig, out = _open(tag, m[3])
        node = Node(tag, sig, out)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(text, at)
            if end is None:
                break
            at = end.end()
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _tidy(text: str) -> str:
    return " ".join(_html.unescape(text).split())


@lru_cache(1 << 16)
def _hashed(path: int, text: str) -> int:
    """A path and an element's signature as a path, or a path and a text as a key."""
    return int.from_bytes(blake2b(f"{path} {text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _key(path: int, text: str, named: bool) -> int:
    """Key of a text; whole articles are too long to be remembered."""
    return (_hashed.__wrapped__ if named else _hashed)(path, text)


def texts(root: Node, tops: list[Node], named: list[Node], layout: dict[int, int]) -> list[tuple[int, str, bool]]:
    """Texts in order, each with its path and whether it is a named element: each of these whole, and the blocks outside them.

    Nothing counts that is neither below ``tops`` nor in a named element. Paths begin at the kind's number at a top;
    ``layout`` takes each path's parent, in order of first sight.
    """
    out: list[tuple[int, str, bool]] = []
    parts: list[str] = []
    lines: list[str] = []  # of the named element at hand
    path, live, inside = int(bool(named)), False, False
    top_ids, named_ids = {id(x) for x in tops}, {id(x) for x in named}

    def flush() -> None:
        text = _tidy("".join(parts))
        parts.clear()
        if text and inside:
            lines.append(text)
        elif text:
            out.append((path, text, False))

    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            flush()
            if inside and not x[2]:
                out.append((path, "\n".join(lines), True))
                lines.clear()
            path, live, inside = x
        elif isinstance(x, str):
            if live or inside:
                parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif not x.out:
            top = id(x) in top_ids
            if top or id(x) in named_ids or x.tag in _BLOCK:
                flush()
                todo.append((path, live, inside))
            live = live or top
            if x.tag in _BLOCK and (live or inside or id(x) in named_ids):
                above, path = path, _hashed(path, x.sig)
                layout.setdefault(path, above)
            inside = inside or id(x) in named_ids
            if top:  # outside an article a header element is the page's
                for k in reversed(x.kids):
                    if isinstance(k, Node) and k.tag == "header" and not inside:
                        todo += [(path, True, False), k, (path, False, False)]
                    else:
                        todo.append(k)
            else:
                todo.extend(reversed(x.kids))
    flush()
    return out


def _heaviest_rising(places: list[int], weights: list[int]) -> list[int]:
    """Indices of the rising subsequence of different places with the greatest total weight, the earliest of equals."""
    rank = {p: k + 1 for k, p in enumerate(sorted(places))}
    best = [(0, -1)] * (len(places) + 1)  # Fenwick tree of (weight, index) maxima by rank
    before, total = [-1] * len(places), [0] * len(places)
    for i, (p, w) in enumerate(zip(places, weights)):
        k, found = rank[p] - 1, (0, -1)
        while k:
            if best[k][0] > found[0]:
                found = best[k]
            k &= k - 1
        before[i], total[i] = found[1], found[0] + w
        k = rank[p]
        while k < len(best):
            if total[i] > best[k][0]:
                best[k] = (total[i], i)
            k += k & -k
    at, out = max(range(len(places)), key=lambda i: (total[i], -i), default=-1), []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: dict[int, int], b: dict[int, int], root: int = 0) -> set[int]:
    """Simple tree matching of two folded trees, given as each path's parent in document order: the paths that match.

    Siblings have different signatures, so a node can match the node of the same path alone; of each matched pair's children
    those match that keep their order and hold the most matched nodes.
    """
    place = {path: k for k, path in enumerate(b)}
    kids: dict[int, list[int]] = {}
    for path, above in a.items():
        if path in place:
            kids.setdefault(above, []).append(path)
    size: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += kids.get(x, ())
    for x in reversed(order):  # children before their parents
        own = kids.get(x, [])
        take = _heaviest_rising([place[k] for k in own], [size[k] for k in own])
        chosen[x] = [own[i] for i in take]
        size[x] = 1 + sum(size[k] for k in chosen[x])
    out, todo = {root}, [root]
    while todo:
        for k in chosen.get(todo.pop(), ()):
            out.add(k)
            todo.append(k)
    return out


def _first_of(node: Node, tags: tuple[str, ...]) -> list[Node]:
    todo, out = [node], []
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.out:
            if x.tag in tags:
                out.append(x)
            else:
                todo.extend(reversed(x.kids))
    return out


def content(text: str) -> tuple[bool, list[tuple[int, str, bool]], dict[int, int]]:
    """Whether the page names its article; its texts (path, text, whether a named element); their layout."""
    root = parse(text)
    layout: dict[int, int] = {}
    named = _first_of(root, ROOTS)
    found = texts(root, _first_of(root, ("body",)) or [root], named, layout)
    return bool(named), found, layout


def extract(text: str, constant: frozenset[int] = frozenset()) -> str:
    """The main text of a page."""
    found = content(text)[1]
    slot = [not constant or _key(*x) not in constant for x in found]
    chosen = [x for x, s in zip(found, slot) if s and x[2]] or [x for x, s in zip(found, slot) if s or x[2]]
    return "\n".join(t for _, t, _ in chosen if t)


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _different(pages: DataFrame) -> DataFrame:
    """One of the rows (_rid, _host, _cid, _html) of each host and content."""
    on = ["_host", "_cid", "_rid"]
    rows = pages.where("_html is not null")
    each = written(rows.groupBy(*on).agg(F.count("*").alias("_n")), "rows")
    take = written(each.groupBy("_host", "_cid").agg(F.min("_rid").alias("_rid"), F.count("*").alias("_ids")), "contents")
    skip = each.join(take.where("_ids > 1").drop("_ids"), on, "left_anti").join(take.where("_ids > 1").select("_host", "_cid"), ["_host", "_cid"], "left_semi").select(*on)
    if skip.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        left = rows.join(F.broadcast(skip), on, "left_anti")
    else:
        take = take.select(*on)
        left = rows.join(F.broadcast(take) if take.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else take, on, "left_semi")
    # rows that repeat id, url and html
    return left if each.where("_n > 1").isEmpty() else left.dropDuplicates(on)


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (_host, _html): each host's layouts by kind, how many pages have each, and the tree."""
    state: dict[tuple[str, bool, int], list] = {}

    def sent() -> pa.RecordBatch:
        host, named, key = zip(*state)
        n, trees = zip(*state.values())
        state.clear()
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(named, pa.bool_()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([list(t) for t in trees], longs), pa.array([list(t.values()) for t in trees], longs)], ["_host", "_named", "_layout", "_n", "_paths", "_above"])

    held = 0
    for b in batches:
        for host, html in _pages(b):
            named, _, tree = content(html)
            key = int.from_bytes(blake2b(repr(list(tree)).encode(), digest_size=8).digest(), "little", signed=True)
            now = state.get((host, named, key))
            if now is None:
                state[host, named, key] = [1, tree]
                held += 1 + len(tree)
            else:
                now[0] += 1
            if held > HELD:
                yield sent()
                held = 0
    if state:
        yield sent()


def _pages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, a few pages at a time."""
    for i in range(0, batch.num_rows, 256):
        part = batch.slice(i, 256)
        yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)))


def _shared_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (_host, _html, _paths, _above: the kinds' reference trees): for each host, kind and matched path the pages (_key null), and the keys in all of them."""
    names = ["_host", "_named", "_path", "_key", "_n"]
    state: dict[tuple[str, bool, int | None], list] = {}

    def sent() -> pa.RecordBatch:
        rows = [(*at, key, n) for at, (n, keys) in state.items() for key in (None, *keys)]
        state.clear()
        host, kind, path, key, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(kind, pa.bool_()), *(pa.array(x, pa.int64()) for x in (path, key, n))], names)

    held = 0
    for b in batches:
        for host, html, paths, above in _pages(b):
            kind, found, tree = content(html)
            matched = align(tree, dict(zip(paths, above)), int(kind))
            own: dict[int | None, set[int]] = {None: set()}  # no path: the page itself
            for path, text, named in found:
                if path in matched:
                    own.setdefault(path, set()).add(_key(path, text, named))
            for path, keys in own.items():
                now = state.get((host, kind, path))
                if now is None:
                    state[host, kind, path] = [1, keys]
                    held += 1 + len(keys)
                else:
                    held -= len(now[1])
                    now[0] += 1
                    now[1] &= keys
                    held += len(now[1])
            if held > HELD:
                yield sent()
                held = 0
    if state:
        yield sent()


def wrappers(pages: DataFrame) -> DataFrame:
    """(_host, _constant: keys of its constant blocks) of pages (_rid, _host, _cid, _html)."""
    different = _different(pages).select("_host", "_html")
    longs = "array<long>"
    each = ["_host", "_named"]
    layouts = different.mapInArrow(_layouts, f"_host string, _named boolean, _layout long, _n long, _paths {longs}, _above {longs}").groupBy(*each, "_layout").agg(F.sum("_n").alias("_n"), F.any_value(F.struct("_paths", "_above")).alias("_tree"))
    common = layouts.groupBy(*each).agg(F.max_by("_tree", F.struct("_n", -F.col("_layout"))).alias("_tree"), F.sum("_n").alias("_n")).where(F.col("_n") >= LEAST)
    # the kinds' paths differ, so one map holds both trees
    both = common.groupBy("_host").agg(F.collect_list("_tree").alias("_trees"))
    trees = written(both.select("_host", F.flatten("_trees._paths").alias("_paths"), F.flatten("_trees._above").alias("_above")), "trees")
    few = trees.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS and (trees.agg(F.sum(F.size("_paths"))).first()[0] or 0) <= BROADCAST_NODES
    with_tree = different.join(F.broadcast(trees) if few else trees, "_host")
    sums = written(with_tree.mapInArrow(_shared_texts, "_host string, _named boolean, _path long, _key long, _n long").groupBy(*each, "_path", "_key").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= LEAST), "shared")
    total = sums.where("_path is null").select(*each, F.col("_n").alias("_pages"))
    paths = sums.where("_path is not null and _key is null").select(*each, "_path", "_n").join(total, each).where("2 * _n > _pages").select(*each, "_path", "_n")
    found = sums.where("_key is not null").join(paths, [*each, "_path", "_n"])
    return written(found.groupBy("_host").agg(F.array_sort(F.collect_list("_key")).alias("_constant")), "wrappers")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    html = F.col(f"`{html_col}`").cast("string")
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.xxhash64(F.col(f"`{id_col}`"), url).alias("_rid"), F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)).alias("_host"), F.xxhash64(html).alias("_cid"), html.alias("_html"))
    found = wrappers(rows.select("_rid", "_host", "_cid", "_html"))
    few = found.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    with_own = rows.join(F.broadcast(found) if few else found, "_host", "left").select("page_id", "url", "_html", "_constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract(h or "", frozenset(c or ())) for h, c in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_own.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

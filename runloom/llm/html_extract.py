"""Main text of web pages by wrapper induction.

1. One page per host, the one with the smallest id, is the host's seed.
2. Every page's DOM tree is aligned with its host's seed by simple tree matching. Per seed node the
   pages that have it, those with equal text, and the length of differing text are added up, in the
   task first and then over all tasks.
3. The wrapper of a host: the deepest container that holds most of the differing text is the content
   slot; an innermost block with the same text on nearly all of many pages is template.
4. On each page the node aligned with the slot is read, without template nodes and without what its
   own markup names as menu, header, footer, side bar, notice, advert, form, script or comments.
   Pages whose host has no evidence use their own landmarks (article, main).

Seeds and wrappers hold one page per host. They are broadcast while the seeds together hold at most
``BROADCAST_BYTES``, and joined by host beyond that.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.store import written

BROADCAST_BYTES = 32 << 20
BROADCAST_HOSTS = 200_000
SLOT_SHARE = 0.6
#: A node is template if this share of at least so many aligned pages repeats its text.
SAME_SHARE, SAME_PAGES = 0.8, 8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PART = re.compile(r"[a-z]+|\d+")

#: Fixed values of HTML: elements without content, with raw content, that stand as blocks, and what closes an open paragraph or item.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
BLOCK = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - set("br td th tr tbody thead tfoot caption optgroup option body html head".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
         "thead": {"table"}, "tbody": {"table"}}
#: Elements, roles and words in class or id that name what is not the article.
NOT_TEXT = set("""head script style noscript template iframe textarea title nav footer aside form button select input svg canvas object
dialog menu audio video map""".split())
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NOT_TEXT_NAMES = set("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie
cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead
topbar toolbar share sharing social related recommended comment comments reply replies respond disqus discussion newsletter subscribe
subscription signup login popup modal overlay widget widgets pagination pager skip search form""".split())
#: Containers that may hold a whole article.
CONTAINERS = set("body main article section div td blockquote center".split())


class Node:
    __slots__ = ("tag", "name", "parent", "parts", "kids", "dropped", "landmark", "mark")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.name, self.parent = tag, tag, parent
        self.parts: list[Node | str] = []
        self.kids: list[Node] = []
        self.dropped, self.landmark, self.mark = False, False, 0


def _in_landmark(node: Node) -> bool:
    up = node.parent
    while up is not None and not up.landmark:
        up = up.parent
    return up is not None


def _label(node: Node, raw: str) -> None:
    """Reads what matters of the attributes: landmark or named as boilerplate, and the name to align by."""
    node.dropped = node.tag in NOT_TEXT
    node.landmark = node.tag in ("article", "main")
    if node.tag == "header":
        node.dropped = not _in_landmark(node)
    if not raw or "=" not in raw and "hidden" not in raw:
        return
    names: set[str] = set()
    for key, value in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            names |= set(_NAME_PART.findall(value))
            if key == "class":
                node.name = f"{node.tag}.{value}"
        elif key == "role":
            node.dropped |= value in NOT_TEXT_ROLES
            node.landmark |= value in ("main", "article")
        elif key == "itemprop":
            node.landmark |= value == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            node.dropped = True
    if "header" in names and not node.landmark and not _in_landmark(node):
        node.dropped = True  # of the page; an article's own header holds its heading
    if names & NOT_TEXT_NAMES and node.tag not in ("html", "body", "article", "main"):
        node.dropped = True


def parse(page: str) -> Node:
    """The DOM of a page: implied ends of paragraphs, items and cells, raw elements as one text."""
    root = Node("#root", None)
    node, at, size = root, 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        stop = FENCE.get(tag)
        closes = SIBLINGS.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if closes:
            up, last = node, None
            while up.parent is not None and not (stop and up.tag in stop) and (stop or up.tag not in CONTAINERS):
                if up.tag in closes:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        new = Node(tag, node)
        _label(new, m[3])
        node.parts.append(new)
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            new.parts.append(page[at:end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            node = new
    return root


def _pieces(node: Node, out: list[str], skip: set[int]) -> None:
    """Texts below a node in page order, with blanks where a block begins or ends."""
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html.unescape(x) if "&" in x else x)
        elif not (x.dropped and x is not node) and id(x) not in skip:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.parts))


def text_of(node: Node, skip: set[int] = frozenset()) -> str:
    out: list[str] = []
    _pieces(node, out, skip)
    return " ".join("".join(out).split())


def innermost(node: Node) -> bool:
    """A block that holds no other block: a paragraph, an item, a heading."""
    todo = list(node.kids) if node.tag in BLOCK else [node]
    while todo:
        x = todo.pop()
        if x.tag in BLOCK and x.tag != "br" or x is node:
            return False
        todo.extend(x.kids)
    return True


def own_text(node: Node) -> str:
    return " ".join(html.unescape(" ".join(p for p in node.parts if isinstance(p, str))).split())


class Matcher:
    """Simple tree matching: order-preserving pairs of equally named nodes under paired parents.

    The weight of two subtrees depends on their shapes alone, so it is remembered by shape. Equal
    shapes at both ends of two child lists pair first, which never lowers the total.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, node: Node) -> int:
        """Numbers subtrees by shape, bottom up, without recursion; sets ``mark``."""
        order, todo = [], [node]
        while todo:
            x = todo.pop()
            order.append(x)
            todo.extend(k for k in x.kids if not k.dropped)
        for x in reversed(order):
            key = (x.name, *[k.mark for k in x.kids if not k.dropped])
            if key not in self.shapes:
                self.shapes[key] = len(self.sizes)
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            x.mark = self.shapes[key]
        return node.mark

    def weight(self, a: Node, b: Node) -> int:
        if a.name != b.name:
            return 0
        if a.mark == b.mark:
            return self.sizes[a.mark]
        key = (a.mark, b.mark)
        if key not in self.weights:
            self.weights[key] = 1 + sum(self.weight(x, y) for x, y in self.children(a, b))
        return self.weights[key]

    def children(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        xs, ys = [k for k in a.kids if not k.dropped], [k for k in b.kids if not k.dropped]
        head = 0
        while head < min(len(xs), len(ys)) and xs[head].mark == ys[head].mark:
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and xs[-1 - tail].mark == ys[-1 - tail].mark:
            tail += 1
        pairs = list(zip(xs[:head], ys[:head], strict=True))
        ends = list(zip(xs[len(xs) - tail:], ys[len(ys) - tail:], strict=True))
        xs, ys = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
        if xs and ys:
            best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i in range(len(xs) - 1, -1, -1):
                row, below = best[i], best[i + 1]
                for j in range(len(ys) - 1, -1, -1):
                    w = self.weight(xs[i], ys[j])
                    row[j] = max(below[j], row[j + 1], w + below[j + 1] if w else 0)
            i = j = 0
            while i < len(xs) and j < len(ys):
                w = self.weight(xs[i], ys[j])
                if w and best[i][j] == w + best[i + 1][j + 1]:
                    pairs.append((xs[i], ys[j]))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        return pairs + ends

    def align(self, page: Node, seed: Node) -> list[tuple[Node, Node]]:
        self.shape(page)
        self.shape(seed)
        out, todo = [], [(page, seed)]
        while todo:
            a, b = todo.pop()
            out.append((a, b))
            todo.extend(self.children(a, b))
        return out


def numbered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed([k for k in x.kids if not k.dropped]))
    return out


class Wrapper:
    """What the pages of a host taught about its seed."""

    def __init__(self, seed: str, evidence: list | None) -> None:
        self.root = parse(seed)
        self.nodes = numbered(self.root)
        self.number = {id(n): i for i, n in enumerate(self.nodes)}
        self.slot: Node | None = None
        self.same: set[int] = set()
        if evidence:
            mass = [0] * len(self.nodes)
            for i, pages, same, changed in evidence:
                mass[i] = changed
                if pages >= SAME_PAGES and same >= SAME_SHARE * pages:
                    self.same.add(id(self.nodes[i]))
            below = list(mass)
            for i in range(len(self.nodes) - 1, 0, -1):
                below[self.number[id(self.nodes[i].parent)]] += below[i]
            fit = [i for i, n in enumerate(self.nodes) if n.tag in CONTAINERS and below[i] and below[i] >= SLOT_SHARE * below[0]]
            if fit:
                self.slot = self.nodes[fit[-1]]


def landmark(root: Node) -> Node:
    """Without evidence: the landmark with most text, else the body."""
    nodes = numbered(root)
    marks = [n for n in nodes if n.landmark] or [n for n in nodes if n.tag == "body"] or [root]
    sized = [(len(text_of(n)), -i, n) for i, n in enumerate(marks)]
    return max(sized, key=lambda s: s[:2])[2]


def outer_landmark(node: Node) -> Node:
    """The landmark around (or at) a node, if any: a slot never cuts an article."""
    found, up = node, node
    while up is not None:
        if up.landmark:
            found = up
        up = up.parent
    return found


def extract(page: str, wrapper: Wrapper | None, matcher: Matcher) -> str:
    root = parse(page)
    slot, skip = None, set()
    if wrapper is not None and wrapper.slot is not None:
        for a, b in matcher.align(root, wrapper.root):
            if b is wrapper.slot:
                slot = a
            if id(b) in wrapper.same and innermost(a) and text_of(a) == text_of(b):
                skip.add(id(a))
    if slot is None:
        return text_of(landmark(root), skip)
    own = [n for n in numbered(slot) if n.landmark]
    if not outer_landmark(slot).landmark and len(own) == 1:
        slot = own[0]  # the slot is a shell around this page's one article
    return text_of(outer_landmark(slot), skip)


def _evidence(seeds):
    """Rows (host, node, pages, same, changed), added up per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            given = cols[2] if len(cols) > 2 else [None] * len(cols[0])
            matcher = Matcher()
            for host, page, own_seed in zip(cols[0], cols[1], given, strict=True):
                seed = own_seed if own_seed is not None else seeds.value.get(host) if seeds is not None else None
                if seed is None or page is None or page == seed:
                    continue
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = Wrapper(seed, None)
                w = known[host]
                root = parse(page)
                pairs = matcher.align(root, w.root)
                matched = {id(a) for a, _ in pairs}
                rows, differs = [], False
                for a, b in pairs:
                    block = innermost(a) and innermost(b)
                    x, y = (text_of(a), text_of(b)) if block else (own_text(a), own_text(b))
                    # Text of nodes that the seed lacks belongs to their nearest aligned parent.
                    extra = sum(len(text_of(k)) for k in a.kids if not k.dropped and id(k) not in matched)
                    changed = extra + (len(x) if x != y else 0)
                    differs |= changed > 0
                    rows.append((w.number[id(b)], int(block and bool(x) and x == y), changed))
                if differs:  # a copy of the seed says nothing
                    for i, same, changed in rows:
                        s = sums.setdefault((host, i), [0, 0, 0])
                        s[0] += 1
                        s[1] += same
                        s[2] += changed
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()),
                 *[pa.array([sums[k][c] for k in keys], pa.int64()) for c in range(3)]], ["host", "node", "pages", "same", "changed"])
    return run


def _texts(wrappers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            matcher, out = Matcher(), []
            for k, (host, page) in enumerate(zip(cols["host"], cols["html"], strict=True)):
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                    seed, found = (cols["seed"][k], cols["evidence"][k]) if "seed" in cols else wrappers.value.get(host, (None, None))
                    known[host] = Wrapper(seed, json.loads(found)) if seed and found else None
                out.append(extract(page, known[host], matcher) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])
    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of text).

    Null or empty html gives an empty text. Null or broken urls share the empty host. Rows may repeat
    ids. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    first = written(rows.where("html IS NOT NULL AND page_id IS NOT NULL").groupBy("host").agg(F.min("page_id").alias("page_id")), "first")
    if first.count() <= BROADCAST_HOSTS:  # two short columns: pages stay where they are read
        first = F.broadcast(first)
    seeds = written(rows.join(first, ["host", "page_id"]).where("html IS NOT NULL").dropDuplicates(["host"])
                    .select("host", F.col("html").alias("seed")), "seeds")
    size = seeds.agg(F.sum(F.octet_length("seed"))).first()[0] or 0
    small = size <= broadcast_bytes
    shape = "host string, node int, pages long, same long, changed long"
    if small:
        held = {r["host"]: r["seed"] for r in seeds.toLocalIterator()}
        found = rows.select("host", "html").mapInArrow(_evidence(spark.sparkContext.broadcast(held)), shape)
    else:
        found = rows.select("host", "html").join(seeds, "host").mapInArrow(_evidence(None), shape)
    # One row per node of a seed, so a host's list is as long as one page.
    listed = (found.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "changed")])
              .groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array(F.col("node").cast("long"), "pages", "same", "changed")))).alias("evidence")))
    wrappers = written(seeds.join(listed, "host"), "wrappers")
    out = "page_id long, url string, text string, n_chars long"
    if small:
        held = {r["host"]: (r["seed"], r["evidence"]) for r in wrappers.toLocalIterator()}
        return rows.mapInArrow(_texts(spark.sparkContext.broadcast(held)), out)
    return rows.join(wrappers, "host", "left").mapInArrow(_texts(None), out)

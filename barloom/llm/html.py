"""HTML extraction by union-free wrappers.

Pages of one host come from one template.  For each host pages are aligned one
after the other: the first page's token stream is the first wrapper; where the
next page differs, texts become slots, neighbours of one kind become a repeated
group, and tokens that only one side has become an optional group.  The result
is a regular expression without unions, with the number of characters that each
of its texts stood for.  It decides (``decide``) what is read of the host's
pages:

* what says the same on all of ``LEAST_PAGES`` pages or more, slots none, is
  template, whatever it is called, and so is what is mostly links;
* but headings, paragraphs, lists and other blocks of text that stand among
  changing ones are text as well, even if they say the same or are links: all of
  them in an element most of whose changing text stands in such blocks, those
  from the first changing one to the last in the body itself;
* an article, main or content element that holds most of the text in slots is
  the content, all of its occurrences, and so are the elements beside it that
  change, unless they are mostly links, fixed texts or a repeated group; if there
  is none, it is the whole body without the template;
* what a name (menu, advert, comments ...) or a tag marks as no part of an
  article goes, but an element is not believed by its name if it holds most of
  the text in slots, or if its name also says content, is one of things that
  are the same on all pages (notice, cookie, menu ...), and all in it changes.

Inside the content elements repeated and fixed texts stay.  ``PAGES_PER_HOST``
pages of a host at most (by a hash of their ids) are aligned: a bounded sample
for the fit; every page is read, whole.  What its wrapper does not know is
read by names and tags.

Defined cases: null and empty html give an empty text; a null url is the host
''; equal rows are each extracted; broken markup is read as far as it goes,
elements deeper than ``_DEPTH`` as if they were beside each other; of more than
``_SIBLINGS`` siblings those of one label are one group; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm._spark import Scratch, on_hot, wide_rows

PAGES_PER_HOST = 12
#: From so many pages on, what does not change is taken for template.
LEAST_PAGES = 3
#: Hosts up to this number have their decisions broadcast (some MB).
MOST_BROADCAST = 50_000
MOST_BROADCAST_CHARS = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+(?:\d{1,2}(?!\d))?")  # longer numbers belong to one page

#: Fixed values of HTML: elements without content, with raw text, and within a line of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open element of the key ends where one of these begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that are never part of the main text, and names (class, id, role) that tell as much.
NEVER = set("nav aside form script style noscript template svg iframe object button select textarea dialog menu head title canvas audio video footer".split())
OUTSIDE = {"header"}
#: Elements that leave no gap in a line of text.
UNSEEN = {"script", "style", "template", "noscript", "head", "title"}
NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion sidebar sidebars comment comments disqus respond cookie cookies"
    " consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations breadcrumb"
    " breadcrumbs menu menus nav navbar navigation topbar footer masthead pagination pager widget widgets toolbar search contentinfo complementary".split()
)
#: Of these, what by its nature says the same on every page of a host.
STILL_NAMES = set(
    "banner cookie cookies consent gdpr notice notices notification notifications newsletter subscribe signup login share sharing breadcrumb breadcrumbs menu menus nav navbar navigation"
    " topbar masthead pagination pager toolbar search".split()
)
OUTSIDE_NAMES = {"header", "topnav", "top"}
CONTENT_NAMES = {"content", "article", "story", "entry", "post", "main", "articlebody", "text", "body"}
#: Elements that are blocks of a running text.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
_DEPTH = 400
_SIBLINGS = 200
_CELLS = 250_000


class Node:
    """An element, or a text if `tag` is empty; in wrappers also a group."""

    __slots__ = ("children", "names", "optional", "repeated", "size", "tag", "text")

    def __init__(self, tag: str, names: frozenset[str] = frozenset(), text: str | None = None) -> None:
        self.tag, self.names, self.text = tag, names, text
        self.children: list[Node] = []
        self.optional = self.repeated = False
        self.size = len(text.strip()) if text else 0

    @property
    def label(self) -> tuple[str, frozenset[str]]:
        return self.tag, self.names


def _names(attributes: str) -> frozenset[str]:
    if not attributes or attributes.isspace():
        return frozenset()
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role", "itemprop"):
            out.update(_NAME.findall((m[2] or m[3] or m[4] or "").lower()))
        elif key == "hidden":
            out.add("hidden")
    return frozenset(out)


def parse(page: str) -> Node:
    """The element tree; unclosed elements end where HTML lets them."""
    root = Node("")
    stack = [root]
    at = 0

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(Node("", text=entities.unescape(text)))

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            return root
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None and m[5] is None:
            if m[0].startswith("<![CDATA["):
                put(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        tag = tag.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k].tag
                if open_tag == "p" and tag not in VOID or tag in ENDS.get(open_tag, ()):
                    del stack[k:]
                    break
                if open_tag not in INLINE:
                    break
        node = Node(tag, _names(attributes))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/") and len(stack) < _DEPTH:
            stack.append(node)


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is no part of the main text; inside: of an article."""
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "article":
        return bool(node.names & {"comment", "comments", "reply", "related", "sponsored", "ad", "hidden"})
    return by_tag(node, inside) or by_name(node, inside)


def by_tag(node: Node, inside: bool) -> bool:
    return node.tag in NEVER or "hidden" in node.names or not inside and node.tag in OUTSIDE


def by_name(node: Node, inside: bool) -> bool:
    names = {n.rstrip("0123456789") for n in node.names}
    return bool(names & NAMES) or not inside and bool(names & OUTSIDE_NAMES)


def blocks(root: Node, plan: Plan, whole: bool = False) -> list[str]:
    """The texts of the blocks of a page's content, in order, white space reduced; whole: of the page, whatever its content elements."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    def walk(node: Node, path: Path, inside: bool, reading: bool) -> None:
        for child in node.children:
            if not child.tag:
                if reading:
                    line.append(child.text or "")
                continue
            here = (*path, child.label)
            begins = not reading and here in plan.begins
            if not (reading or begins or here in plan.ways):
                continue
            if plan.reads(child, here, inside):
                inline = child.tag in INLINE and not begins
                if not inline:
                    flush()
                walk(child, here, inside or begins or child.tag == "article", reading or begins)
                if not inline:
                    flush()
            elif child.tag not in UNSEEN:
                flush()

    walk(root, (), False, whole or not plan.content)
    flush()
    return out


def _merge_text(a: Node, b: Node, one_page: bool) -> Node:
    out = Node("")
    if a.text is not None and b.text is not None:
        if one_page:  # of a group the texts of all repeats are compared with the next page's
            out.text = f"{a.text}\n{b.text}"
        elif a.text.split() == b.text.split():
            out.text = a.text
    out.optional, out.repeated, out.size = a.optional or b.optional, a.repeated or b.repeated, a.size + b.size
    return out


def _align(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """The children of two elements side by side: a longest common sequence of labels; by label alone where that would be too large."""
    n, m = len(x), len(y)
    if n * m > _CELLS:
        left, right = ({c.label: c for c in side} for side in (x, y))
        return [(left.get(k), right.get(k)) for k in {**left, **right}]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[Node | None, Node | None]] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i].label == y[j].label:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


def merge(a: Node, b: Node, one_page: bool = False) -> Node:
    """The wrapper of two wrappers of one label; one_page: of two neighbours on a page."""
    if not a.tag:
        return _merge_text(a, b, one_page)
    out = Node(a.tag, a.names)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    for left, right in _align(a.children, b.children):
        if left and right:
            out.children.append(merge(left, right, one_page))
            continue
        node = left or right
        node.optional = True
        out.children.append(node)
    return fold(out, one_page)


def fold(node: Node, one_page: bool = False) -> Node:
    """Neighbours of one label become one repeated group; of very many siblings all of one label."""
    children = node.children
    if len(children) > _SIBLINGS:
        order = {label: k for k, label in enumerate(dict.fromkeys(c.label for c in children))}
        children = sorted(children, key=lambda c: order[c.label])
    out: list[Node] = []
    for child in children:
        if out and out[-1].label == child.label:
            child = merge(out.pop(), child, one_page)
            child.repeated = True
        out.append(child)
    node.children = out
    return node


def _prepare(node: Node) -> Node:
    """A page as a wrapper: blank texts go, repeats are folded, from the leaves up."""
    node.children = [_prepare(c) for c in node.children if c.tag or (c.text or "").strip()]
    return fold(node, True)


def wrapper_of(pages: list[str]) -> Node | None:
    """The wrapper of pages of one host; equal pages count once."""
    out = None
    for page in dict.fromkeys(p for p in pages if p):
        root = Node("#page")
        root.children = _prepare(parse(page)).children
        out = root if out is None else merge(out, root)
    return out


def expression(node: Node) -> str:
    """The wrapper as a regular expression: (..)? optional, (..)+ repeated, #text a slot."""
    if not node.tag:
        body = "#text" if node.text is None else re.sub(r"\s+", " ", node.text.strip())
    else:
        body = "".join(map(expression, node.children))
        if node.tag not in ("", "#page"):
            body = f"<{node.tag}{''.join('.' + n for n in sorted(node.names))}>{body}</{node.tag}>"
    if node.repeated:
        body = f"({body})+"
    return f"({body})?" if node.optional else body


Path = tuple[tuple[str, frozenset[str]], ...]


class Plan:
    """What is read of the pages of a host: the labels down to the content element (none: the body), what goes or stays against its name, and what stands beside the content and is text too."""

    def __init__(self, content: Path = (), goes: set[Path] | None = None, stays: set[Path] | None = None, beside: set[Path] | None = None) -> None:
        self.content, self.goes, self.stays, self.beside = content, goes or set(), stays or set(), beside or set()
        self.begins = self.beside | {content} if content else set()
        #: the elements on the way to content
        self.ways = {path[:k] for path in self.begins for k in range(1, len(path))}

    def reads(self, node: Node, path: Path, inside: bool) -> bool:
        if path in self.stays:
            return True
        return not boilerplate(node, inside) and (inside or path not in self.goes)

    def encode(self) -> str:
        plain = lambda path: [[tag, *sorted(names)] for tag, names in path]
        return json.dumps([plain(self.content), *(sorted(map(plain, paths)) for paths in (self.goes, self.stays, self.beside))])

    @staticmethod
    def decode(text: str) -> Plan:
        path = lambda plain: tuple((tag, frozenset(names)) for tag, *names in plain)
        content, *sets = json.loads(text)
        return Plan(path(content), *(set(map(path, paths)) for paths in sets))


def _sizes(node: Node, fixed_counts: bool, linked: bool = False) -> tuple[int, int, int]:
    """Characters of the texts below an element that change, stand in links, or never change; without tags that hold no article."""
    if not node.tag:
        if node.text is not None and fixed_counts:
            return 0, 0, node.size
        return (0, node.size, 0) if linked else (node.size, 0, 0)
    parts = [_sizes(c, fixed_counts, linked or node.tag == "a") for c in node.children if not c.tag or not by_tag(c, True)]
    return tuple(map(sum, zip(*parts))) if parts else (0, 0, 0)


def _rank(node: Node) -> int:
    """How plainly an element says that it is the content; it counts only if it holds most of the text."""
    names = {n.rstrip("0123456789") for n in node.names}
    if node.tag == "article":
        return 3
    if node.tag == "main" or names & {"main", "articlebody"}:
        return 2
    return 1 if node.tag in ("div", "section", "td") and names & CONTENT_NAMES else 0


def _repeats(node: Node) -> int:
    """Characters of an element's texts that stand in repeated groups of other elements than blocks of text."""
    if not node.tag:
        return 0
    return sum(_size(c) if c.repeated and c.tag and c.tag not in TEXT_BLOCKS and c.tag not in INLINE else _repeats(c) for c in node.children)


def _size(node: Node) -> int:
    return node.size if not node.tag else sum(map(_size, node.children))


def _changes_against_its_name(node: Node, n_pages: int, sizes: tuple[int, int, int]) -> bool:
    """Whether a name of things that never change (a notice ...), which also says content, stands on what changes from page to page."""
    names = {n.rstrip("0123456789") for n in node.names}
    free, link, fixed = sizes
    return n_pages >= LEAST_PAGES and bool(names & CONTENT_NAMES) and names & NAMES <= STILL_NAMES and free > link and not fixed and not node.repeated


def decide(wrapper: Node, n_pages: int = 1) -> Plan:
    """What the wrapper of `n_pages` different pages says of its elements."""
    fixed_counts = n_pages >= LEAST_PAGES
    plan = Plan()
    free_of: dict[Path, int] = {}
    rank_of: dict[Path, int] = {}
    among: dict[Path, bool] = {}
    kept: set[Path] = set()

    def total(node: Node, inside: bool) -> int:
        """Characters of changing text outside of what tags and names leave out."""
        if not node.tag:
            return 0 if node.text is not None and fixed_counts else node.size
        return sum(total(c, inside or node.tag == "article") for c in node.children if not c.tag or not boilerplate(c, inside) and c.tag != "a")

    everything = _sizes(wrapper, fixed_counts)[0]
    unnamed = total(wrapper, False)

    def text_blocks(node: Node) -> set[int]:
        """The places of an element's children that are text because of the changing blocks around them."""
        changing, running = [], 0
        for k, child in enumerate(node.children):
            if not child.tag or child.tag in TEXT_BLOCKS or child.tag in INLINE:
                free, link, _ = _sizes(child, fixed_counts)
                running += free
                if free > link:
                    changing.append(k)
        if not changing or not fixed_counts:
            return set()
        held = {k for k, child in enumerate(node.children) if child.tag in TEXT_BLOCKS}
        if node.tag not in ("", "#page", "html", "body") and 2 * running > _sizes(node, fixed_counts)[0]:
            return held
        return {k for k in held if changing[0] <= k <= changing[-1]}

    def walk(node: Node, path: Path, inside: bool) -> None:
        text = text_blocks(node)
        for k, child in enumerate(node.children):
            if not child.tag:
                continue
            here = (*path, child.label)
            free, link, fixed = sizes = _sizes(child, fixed_counts)
            if boilerplate(child, inside):
                if by_tag(child, inside):
                    continue
                # a name is not believed if nearly all the text is there, or if it names what does not change
                if not (2 * free > everything and unnamed < free) and not _changes_against_its_name(child, n_pages, sizes):
                    continue
                plan.stays.add(here)
            if k in text:
                kept.add(here)
            elif child.tag not in INLINE and child.tag not in ("html", "body"):
                if not free and fixed or link > free:
                    plan.goes.add(here)
                    continue
                kept.add(here)
            free_of[here] = free_of.get(here, 0) + free
            rank_of[here] = _rank(child)
            # what may be content because it stands beside content: not a list, and not mostly fixed
            among[here] = among.get(here, True) and child.tag not in INLINE and free > link and free >= fixed and not child.repeated and 2 * _repeats(child) <= free
            walk(child, here, inside or child.tag == "article")

    walk(wrapper, (), False)
    plan.goes -= kept  # elements of one label, of which some hold text
    whole = sum(free for path, free in free_of.items() if len(path) == 1)
    most = [(rank_of[path], free, path) for path, free in free_of.items() if rank_of[path] and not any(path[:k] in plan.goes for k in range(len(path)))]
    # elements of one parent and rank are one content, in parts
    parts: dict[tuple[Path, int], int] = {}
    for rank, free, path in most:
        parts[path[:-1], rank] = parts.get((path[:-1], rank), 0) + free
    most = [(rank, free, path) for rank, free, path in most if 2 * parts[path[:-1], rank] > whole]
    if most:
        best = max(most, key=lambda x: (x[0], x[1], -len(x[2])))[2]
        beside = {path for path in free_of if path[:-1] == best[:-1] and path not in plan.goes and fixed_counts and (among[path] or rank_of[path])}
        return Plan(best, plan.goes, plan.stays, beside - {best})
    return plan


def extract(page: str | None, plan: Plan | None = None) -> str:
    """The main text of a page as its host's wrapper tells, or, if that finds nothing there, as it tells itself."""
    if not page:
        return ""
    tree = parse(page)
    found = blocks(tree, plan) if plan is not None else []
    if not found and (plan is None or plan.content):
        plan = decide(wrapper_of([page]) or Node("#page"))
        found = blocks(tree, plan) or blocks(tree, plan, True)
    return " ".join(found)


def host_column():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host")


def wrappers(spark: SparkSession, pages: DataFrame, pages_per_host: int = PAGES_PER_HOST) -> DataFrame:
    """host, n_pages, wrapper (its expression), plan (what it decides) for every host of `pages` (page_id, url, html)."""
    rows = pages.select(host_column(), F.xxhash64("page_id", "url").alias("order"), F.col("html").cast("string").alias("html")).where(F.length("html") > 0)
    sample = rows.withColumn("nth", F.row_number().over(W.partitionBy("host").orderBy("order"))).where(F.col("nth") <= pages_per_host)

    def infer(table: pa.Table) -> pa.Table:
        found = table["html"].to_pylist()
        wrapper = wrapper_of(found)
        plan = decide(wrapper, len(set(found)))
        return pa.table({"host": [table["host"][0].as_py()], "n_pages": pa.array([table.num_rows], pa.int32()), "wrapper": [expression(wrapper)], "plan": [plan.encode()]})

    return sample.select("host", "html").groupBy("host").applyInArrow(infer, "host string, n_pages int, wrapper string, plan string")


def main_texts(spark: SparkSession, pages: DataFrame, pages_per_host: int = PAGES_PER_HOST) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    wide_rows(spark)
    with Scratch(spark) as scratch:
        found = scratch.finish(wrappers(spark, pages, pages_per_host).select("host", "plan"))
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"), host_column())
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches):
        plans: dict[str | None, Plan | None] = {None: None}
        for batch in batches:
            texts = []
            for page, plan in zip(batch.column(2), batch.column(3).to_pylist()):
                if plan not in plans:
                    if len(plans) > 1000:
                        plans = {None: None}
                    plans[plan] = Plan.decode(plan)
                texts.append(extract(page.as_py(), plans[plan]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # a host and some paths of tags each: sent along once their number and size are known, else joined, large hosts where their pages are
    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("host") + F.length("plan")), F.lit(0))).first()
    if size[0] <= MOST_BROADCAST and size[1] <= MOST_BROADCAST_CHARS:
        planned = rows.join(F.broadcast(found), "host", "left")
    else:
        counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        planned = on_hot(rows, found.join(counts, "host"), "host", "n", "left")
    return planned.select("page_id", "url", "html", "plan").mapInArrow(run, schema)

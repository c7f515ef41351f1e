"""Main text of web pages by wrapper induction.

Pages of one host are dealt into groups of about `GROUP` pages.  In a group, every
page's element tree (runs of like siblings folded into one node, what lies below `DEPTH`
levels part of its ancestor) is aligned with a tree merged of the pages before it, by simple
tree matching: the largest set of node pairs that keeps labels, order and ancestry.  What has
no partner is added to the merged tree, so no page is the measure of the others.

Then the merged tree decides, over all pages of the group with different content:

* a node on at least `SUPPORT` of them that always holds the same text is template;
* so is a list of links, a node whose text lies in links for the most part;
* all other nodes are slots.  Without an article or main element, the region that holds
  most of the slots' text, over all pages, is the main one, with the headings before it.

The main text is what the slots hold inside the article, the main element or that region.
Elements and roles of navigation, forms and the like are left out wherever they stand.
Names of classes break ties alone, for slots that vary as the article does: whole classes
that name reader comments, adverts, sidebars or share links are left out; vaguer ones, as
"notice" or "side", only outside the main region.  No class drops the article or main element
or the region with most text.

Edge cases: null and empty pages give an empty text; a null url is a host of its own.
A group whose pages don't differ enough has no template, only slots.  Repeated rows
are extracted once each.  Depth and width of a page are not limited.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import is_small, stash

GROUP, SUPPORT = 32, 4
#: Levels and siblings that are aligned one by one; what is deeper is part of its ancestor, more siblings are folded by element.
DEPTH, WIDTH, FEW = 64, 48, 8
#: Share of a node's text in links that makes a list of links of it, and of a region's text that is worth going down for.
LINKED, MOST = 0.7, 0.8

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
# a whole attribute: its value is consumed with its name, so no word in a value is taken for a name
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>]+)))?")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_FENCE = frozenset("html body article section main div table td th ul ol dl blockquote aside nav footer header form".split())

_OUT_TAGS = frozenset("head title script style noscript template iframe object nav footer aside form button select option textarea dialog menu svg canvas".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert "
    "sidebar side nav navbar navigation menu breadcrumb breadcrumbs comment comments commentlist respond reply replies discussion disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay footer masthead widget widgets pagination pager toolbar tags".split()
)
_READER_WORDS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
#: Names that may be an article's own: they leave out what stands beside the main region, nothing in it.
_VAGUE_WORDS = frozenset("side notice notices alert banner promo promotion promoted tags widget widgets header masthead menu menus overlay modal popup consent toolbar".split())
# words that say where or how a region stands, not what it holds
_FRAME_WORDS = frozenset("area bar block box button buttons container group icons inner item items left link links list main outer panel post posts primary right row secondary section site top bottom wrap wrapper".split())


def _names_region(name: str) -> int:
    """Whether a whole class or id names a region to be left out: 'share-links' does (2), 'comments-open'
    doesn't (0); 'notice-box' does beside the main region (1)."""
    words = [w for w in re.split(r"[-_\d]+", name) if w]
    if _OUT_WORDS.isdisjoint(words) or not _OUT_WORDS.union(_FRAME_WORDS).issuperset(words):
        return 0
    return 1 if _VAGUE_WORDS.union(_FRAME_WORDS).issuperset(words) else 2


class Node:
    """An element: label, children, and its pieces of text and children in order.
    `out`: its region is left out; `worded`: by nothing but the words of its class and id;
    `vague`: words leave it out beside the main region."""

    __slots__ = ("tag", "label", "out", "worded", "vague", "kids", "parts", "parent")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.parts = tag, parent, [], []
        names: list[str] = []
        self.out = tag in _OUT_TAGS
        self.worded = self.vague = False
        if attrs.strip():
            own: dict[str, str] = {}
            for m in _ATTR.finditer(attrs):
                own.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
            self.out |= "hidden" in own or not _OUT_ROLES.isdisjoint(own.get("role", "").split())
            for key in own:
                if key in ("class", "id"):
                    names += re.findall(r"[a-z]+", own[key])
                    sure = max(map(_names_region, own[key].split()), default=0)
                    self.worded |= sure == 2
                    self.vague |= sure == 1
            self.worded &= not self.out and tag not in ("html", "body", "article", "main")
            self.vague &= tag not in ("html", "body", "article", "main", "p")
            self.out |= self.worded
        self.label = tag if not names else f"{tag}.{'.'.join(names)}"


def parse(page: str) -> Node:
    """The element tree, with the usual end tags implied."""
    root = here = Node("#root", "", None)
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            here.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            x = here
            while x.parent and x.tag != tag:
                x = x.parent
            if x.parent:
                here = x.parent
            continue
        ends = {"p"} if tag in _CLOSES_P else _SIBLINGS.get(tag)
        if ends:
            x = here
            while x.parent and x.tag not in ends and x.tag not in _FENCE:
                x = x.parent
            if x.parent and x.tag in ends:
                here = x.parent
        node = Node(tag, attrs or "", here)
        here.kids.append(node)
        here.parts.append(node)
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            close = page.find(">", stop.start()) if stop else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in _VOID and not (attrs or "").rstrip().endswith("/"):
            here = node
    here.parts.append(html.unescape(page[at:]))
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Words of a class drop no region that holds the article or main element, nor, in a page
    that has none or inside the one it has, the region that holds most of the text."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in x.kids if not k.out or k.worded)
    if not any(x.worded or x.vague for x in order):
        return
    marked, size = set(), {}
    for x in reversed(order):  # children before parents
        size[id(x)] = sum(len("".join(p.split())) if isinstance(p, str) else size.get(id(p), 0) for p in x.parts)
        if x.tag in ("article", "main") and size[id(x)] or any(id(k) in marked for k in x.kids):
            marked.add(id(x))
    for x in order:
        if id(x) in marked:
            _keep(x)
    tops = _find(root, lambda x: x.tag in ("article", "main") and size.get(id(x), 0)) or [root]
    for top in tops:
        inside = [top]
        while inside:
            x = inside.pop()
            readers = not _READER_WORDS.isdisjoint(x.label.split(".")[1:])  # often longer than the article: spared only if all there is
            if size[id(x)] and (size[id(x)] == size[id(top)] if readers else 2 * size[id(x)] > size[id(top)]):
                _keep(x)
            if not x.out:
                inside.extend(k for k in x.kids if not k.out or k.worded)


def _keep(x: Node) -> None:
    """Takes back what words alone said of a region."""
    x.out &= not x.worded
    x.worded = x.vague = False


def text_of(node: Node, skip=lambda x: False) -> str:
    """Text with a space at every block's edges and white space folded."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not skip(x):
            if x.tag not in _INLINE:
                stack.append(" ")
                out.append(" ")
            stack.extend(reversed(x.parts))
    return " ".join("".join(out).split())


class Slot:
    """A node of the folded tree: one element, or a run of like siblings."""

    __slots__ = ("label", "tag", "nodes", "kids", "text", "size", "linked")

    def __init__(self, nodes: list[Node], label: str):
        self.label, self.tag, self.nodes, self.kids = label, nodes[0].tag, nodes, []
        self.text, self.size, self.linked = "", 0, 0


def folded(root: Node) -> Slot:
    """The folded tree of a page."""
    top = Slot([root], root.label)
    todo = [(top, 0)]
    while todo:
        slot, depth = todo.pop()
        if slot.nodes[0].out or depth >= DEPTH:
            continue
        kids = [k for n in slot.nodes for k in n.kids if k.tag not in _INLINE and k.tag not in _VOID]
        runs: list[list[Node]] = []
        for kid in kids:
            if runs and kid.label == runs[-1][0].label:
                runs[-1].append(kid)
            else:
                runs.append([kid])
        # a few like regions are regions of their own, many are a list
        runs = [part for run in runs for part in ([run] if run[0].tag not in _REGIONS or len(run) > FEW else [[k] for k in run])]
        if len(runs) > WIDTH:  # rows that alternate: one node for each element and whether it is left out
            by_tag: dict[str, list[Node]] = {}
            for kid in kids:
                by_tag.setdefault(f"{kid.tag}*{'-' * kid.out}", []).append(kid)
            slot.kids = [Slot(run, label) for label, run in by_tag.items()]
        else:
            slot.kids = [Slot(run, run[0].label) for run in runs]
        todo += [(k, depth + 1) for k in slot.kids]
    _measure(top)
    return top


def _measure(top: Slot) -> None:
    """Text, its size and what of it is in links, for each slot."""
    order, stack = [], [top]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.kids)
    for x in reversed(order):
        if x.kids:
            own = [p for n in x.nodes for p in n.parts if isinstance(p, str) or p.tag in _INLINE]
            x.text = " ".join(filter(None, [*(k.text for k in x.kids), *(p.strip() if isinstance(p, str) else text_of(p) for p in own)]))
            x.linked = sum(k.linked for k in x.kids) + sum(_solid(text_of(p)) for p in own if not isinstance(p, str) and p.tag == "a")
        elif not x.nodes[0].out:
            x.text = " ".join(text_of(n) for n in x.nodes)
            links = [k for n in x.nodes for k in _find(n, lambda y: y.tag == "a")]
            x.linked = sum(_solid(text_of(k)) for k in links)
        x.size = _solid(x.text)


def _solid(text: str) -> int:
    return len(text) - text.count(" ")


class Merged:
    """A node of the tree that a group's pages make together: the slots it stands for, by page."""

    __slots__ = ("label", "tag", "kids", "held")

    def __init__(self, slot: Slot, page: int):
        self.label, self.tag, self.held, self.kids = slot.label, slot.tag, [(page, slot)], []

    @staticmethod
    def copy(slot: Slot, page: int) -> Merged:
        top = Merged(slot, page)
        todo = [(top, slot)]
        while todo:
            a, b = todo.pop()
            a.kids = [Merged(k, page) for k in b.kids]
            todo += zip(a.kids, b.kids)
        return top

    def add(self, tree: Slot, page: int) -> None:
        """Aligns a page's tree with this one and puts its nodes without a partner where they stand."""
        pairs = align(self, tree)[1]
        partner = {id(b): a for a, b in pairs}
        for a, b in pairs:
            a.held.append((page, b))
            at = 0
            for kid in b.kids:
                if id(kid) in partner:
                    at = next(i for i in range(at, len(a.kids)) if a.kids[i] is partner[id(kid)])
                else:
                    a.kids.insert(at, Merged.copy(kid, page))
                at += 1

    def nodes(self) -> Iterator[Merged]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(x.kids)


def align(a: Slot | Merged, b: Slot) -> tuple[int, list[tuple[Slot | Merged, Slot]]]:
    """Simple tree matching of trees with equal root labels: its size and its pairs.  Folded trees
    are `DEPTH` deep at most, so is the recursion."""
    # kids whose label the other side lacks have no partner
    left, right = {k.label for k in a.kids}, {k.label for k in b.kids}
    mine, theirs = [k for k in a.kids if k.label in right], [k for k in b.kids if k.label in left]
    m, n = len(mine), len(theirs)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    below = {}
    for i in range(m):
        for j in range(n):
            value = max(best[i][j + 1], best[i + 1][j])
            if mine[i].label == theirs[j].label:
                below[i, j] = align(mine[i], theirs[j])
                value = max(value, best[i][j] + below[i, j][0])
            best[i + 1][j + 1] = value
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if (i - 1, j - 1) in below and best[i][j] == best[i - 1][j - 1] + below[i - 1, j - 1][0]:
            pairs += below[i - 1, j - 1][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs


def _find(root: Node, wanted) -> list[Node]:
    """Outermost nodes that are `wanted`, regions to be left out not entered."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if wanted(x):
            found.append(x)
        else:
            stack.extend(k for k in reversed(x.kids) if not k.out)
    return found


_CONTAINERS = frozenset("#root html body div section center table tbody tr td main article span".split())


class Wrapper:
    """What a group of pages has in common: `template` nodes, by id, and the pages' main `region`s,
    each a list of nodes."""

    def __init__(self, roots: list[Node], plain: list[str]):
        trees = [folded(r) for r in roots]
        self.template: set[int] = set()
        self.region: dict[int, list[Node]] = {}
        merged: Merged | None = None
        for page, tree in enumerate(trees):
            if merged is None:
                merged = Merged.copy(tree, page)
            else:
                merged.add(tree, page)
        if merged is None:
            return
        varying: dict[int, int] = {}
        stack = [(merged, False)]
        while stack:
            x, inside = stack.pop()
            inside |= x.tag in ("article", "main")
            stack.extend((k, inside) for k in x.kids)
            # pages of different content: a copy is no further witness
            if x is merged or len({plain[page] for page, _ in x.held}) < SUPPORT:
                continue
            size = sum(slot.size for _, slot in x.held)
            links = not inside and x.tag in _LISTS and sum(slot.linked for _, slot in x.held) >= LINKED * size
            if size and (links or len({slot.text for _, slot in x.held}) == 1):
                self.template.update(id(n) for _, slot in x.held for n in slot.nodes)
            elif not x.kids and any(len(slot.nodes) > 1 for _, slot in x.held):
                # in runs of like siblings, those that stand in every page's run
                every = set.intersection(*({text_of(n) for n in slot.nodes} for _, slot in x.held))
                self.template.update(id(n) for _, slot in x.held for n in slot.nodes if text_of(n) in every)
        order = list(merged.nodes())
        for x in reversed(order):
            gone = all(id(n) in self.template or n.out or n.vague for _, slot in x.held for n in slot.nodes)
            own = sum(slot.size - slot.linked - sum(k.size - k.linked for k in slot.kids) for _, slot in x.held)
            varying[id(x)] = 0 if gone else max(0, own) + sum(varying[id(k)] for k in x.kids)
        # the region with most of the slots' text; a heading that stands before it is part of it
        here, heads = merged, []
        while here.kids and varying[id(here)]:
            rich = max(here.kids, key=lambda k: varying[id(k)])
            if rich.tag not in _CONTAINERS or varying[id(rich)] < MOST * varying[id(here)]:
                break
            for kid in here.kids:
                if kid is rich:
                    break
                if kid.tag in ("h1", "h2") and not all(id(n) in self.template for _, slot in kid.held for n in slot.nodes):
                    heads.append(kid)
            here = rich
        for x in (*heads, here):
            for page, slot in x.held:
                self.region.setdefault(page, []).extend(slot.nodes)


_REGIONS = frozenset("div section main article center".split())
_LISTS = frozenset("ul ol dl menu div section table nav td".split())


def main_text(root: Node, template: set[int] = frozenset(), region: list[Node] | None = None) -> str:
    """What slots hold in the page's main region."""
    skip = lambda x: x.out or id(x) in template
    beside = lambda x: skip(x) or x.vague or x.tag == "header"
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.label.startswith("div.main")):
        if found := _find(root, wanted):
            if text := " ".join(t for t in (text_of(x, skip) for x in found) if t):
                return text
    nodes = [x for x in region or [root] if not x.out]
    return " ".join(t for t in (text_of(x, beside) for x in nodes) if t) or text_of(root, beside)


def extract(pages: list[str]) -> list[str]:
    """Main texts of pages that share a host."""
    roots = [parse(p) for p in pages]
    plain = [main_text(r) for r in roots]
    if len(set(plain)) < SUPPORT:  # no witnesses: each page on its own
        return [main_text(r, region=Wrapper([r], [p]).region.get(0)) for r, p in zip(roots, plain)]
    wrapper = Wrapper(roots, plain)
    return [main_text(r, wrapper.template, wrapper.region.get(i)) or p for i, (r, p) in enumerate(zip(roots, plain))]


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("page_id", kind="stable")
    rows["text"] = extract(rows.html.tolist())
    rows["n_chars"] = rows.text.str.len()
    return rows[["page_id", "url", "text", "n_chars"]]


def main_texts(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """For each row of `pages` (page_id, url, html): page_id, url, text, n_chars."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    counts = stash(pages.groupBy("host").agg(F.ceil(F.count("*") / group).cast("long").alias("parts")), "hosts")
    counts = F.broadcast(counts) if is_small(counts) else counts
    dealt = pages.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")))
    return dealt.groupBy("host", "part").applyInPandas(_group, "page_id long, url string, text string, n_chars long")

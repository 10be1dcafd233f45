"""Main text of web pages by composite text density.

A page is parsed into a tree of elements. Every element's density is its characters per tag, weighed down by the share of
links in it and compared with the page's; only what is never shown (scripts, styles, hidden elements) counts for nothing. The
densities of an element's children are summed; the element with the largest sum is the core. The least density on the way
from the core up to the body is the threshold: elements at or above it may hold content, and of each of them the part with
the largest sum is taken.

What density has taken is pruned: menus, headers, footers, sidebars, notices, adverts, forms and reader comments in it go, by
element, role, and class or id names. A form, or an element with such a name, that holds most of the page's text outside
links stays, and its parts are judged by themselves; not so if it is outside the page's article or main. If nothing is left,
the element with the largest sum of those that are not pruned is the core instead.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_texts

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
DROPPED = set(
    "head nav footer aside form script style noscript iframe template button select input textarea menu dialog svg canvas "
    "object embed applet map video audio datalist fieldset label legend optgroup option noembed noframes".split()
)
BLOCKS = set(
    "html body address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
CLOSES_P = BLOCKS - set("html body li dd dt tr tbody thead tfoot caption".split())
#: A start tag of the key ends an open element among the values, up to an element among the fences.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Of DROPPED, what shows its text: it has a density, and is pruned from what density takes.
SHOWN = set("nav footer aside form button menu dialog fieldset label legend".split())
CONTAINERS = ("article", "main")
HOLDERS = BLOCKS | {"td", "th"}  # what can be taken by itself; the body is taken as the core only
HOLDERS -= {"html", "body"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies share sharing social related "
    "recommended recommendations pagination pager widget login search skip toolbar copyright outbrain taboola".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NEVER = set("comment comments disqus respond reply replies cookie cookies consent gdpr newsletter".split())  # long, yet no article
COMMENTS = set("comment comments disqus replies".split())
NOT_NAMES = set("has with no without is js".split())

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
INTERESTING = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "items", "boilerplate", "hidden", "weak", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items, self.boilerplate, self.hidden = tag, parent, [], False, False
        self.weak = 0  # 1: boilerplate unless it holds most of the text; 2: unless it holds all of it
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _inside(node: Node | None, tags: tuple) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _boilerplate(tag: str, attributes: str, parent: Node) -> int:
    """0: no boilerplate; 1, 2: by name or as a form, see Node.weak; 3: whatever it holds; 4: never shown."""
    if tag in DROPPED and tag != "form":
        return 3 if tag in SHOWN else 4
    if tag == "header" and not _inside(parent, CONTAINERS):
        return 3
    found = int(tag == "form")
    if tag in ("html", "body", "main") or not INTERESTING.search(attributes):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 4
        if name == "role" and (role := value.strip().lower()) in ROLES:
            if role != "form":
                return 3
            found = max(found, 1)
        if name == "id" and (tag in HEADINGS or tag == "section" and _inside(parent, CONTAINERS)):
            continue  # made from the heading's words
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in PART.findall(word)]
                if not parts or parts[0] in NOT_NAMES:
                    continue
                if (COMMENTS if tag == "article" else NAMES) & {parts[0], parts[-1]}:
                    found = max(found, 2 if NEVER & {parts[0], parts[-1]} else 1)
                if parts[-1] == "header" and not _inside(parent, CONTAINERS) and not {"article", "entry", "post"} & set(parts):
                    found = max(found, 1)
    return found


def _settle(nodes: list[Node]) -> None:
    """Decides about forms and elements with names of boilerplate, from the outside in."""
    if not any(n.weak for n in nodes):
        return
    own: dict[int, int] = {}  # text outside links, without what goes whatever it holds
    sure: dict[int, int] = {}  # also without comments and the like
    articles: dict[int, int] = {}  # article and main elements with text
    for n in reversed(nodes):
        a = b = 0
        articles[id(n)] = sum(articles[id(x)] for x in n.items if not isinstance(x, str))
        if not n.boilerplate and n.tag != "a":
            for x in n.items:
                a += len(x.strip()) if isinstance(x, str) else own[id(x)]
                b += len(x.strip()) if isinstance(x, str) else sure[id(x)]
        own[id(n)], sure[id(n)] = a, 0 if n.weak == 2 else b
        if n.tag in CONTAINERS and not n.weak and b:
            articles[id(n)] += 1
        if n.weak == 2 or n.boilerplate:
            articles[id(n)] = 0
    held = sure if sure[id(nodes[0])] else own
    page = held[id(nodes[0])]
    for n in nodes[1:]:
        outside = articles[id(nodes[0])] and not articles[id(n)] and n.weak and not _inside(n, CONTAINERS)
        if n.parent.boilerplate or outside or n.weak and 2 * held[id(n)] <= page:
            n.boilerplate = True


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in order."""
    root = Node("#root", None)
    nodes, at = [root], 0
    stack, opened = [root], Counter()  # how many of each element are open: most searches of the stack can be spared

    def pop_to(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                continue
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    pop_to(d)
                    break
                if stack[d].tag in ("table", "article", "body", "html") and tag not in BLOCKS:
                    break  # an inline end tag closes nothing outside
            continue
        if opened["p"] and tag in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    pop_to(d)
                    break
                if stack[d].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in IMPLIED and any(opened[e] for e in IMPLIED[tag][0]):
            ends, fences = IMPLIED[tag]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in ends:
                    pop_to(d)
                    break
                if stack[d].tag in fences:
                    break
        parent = stack[-1]
        node = Node(tag, parent)
        kind = 4 if parent.hidden else _boilerplate(tag, m[3] or "", parent)
        node.hidden = kind == 4
        node.boilerplate = parent.boilerplate or kind >= 3
        node.weak = 0 if node.boilerplate else kind
        parent.items.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if tag not in DROPPED:
                node.items.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _settle(nodes)
    return root, nodes


def measure(nodes: list[Node]) -> None:
    """Counts, densities and sums of all elements; what is never shown counts for nothing."""
    for n in reversed(nodes):
        if n.hidden:
            continue
        for item in n.items:
            if isinstance(item, str):
                n.chars += len(item.strip())
            elif not item.hidden:
                n.chars += item.chars
                n.tags += 1 + item.tags
                n.link_chars += item.link_chars
                n.link_tags += (item.tag == "a") + item.link_tags
        if n.tag == "a":
            n.link_chars = n.chars
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        if n.hidden or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(math.log(c * n.link_chars / max(1, c - n.link_chars) + share * c + math.e) + math.e - 1)
        n.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) + 1e-3) / base
        n.sum = sum(x.density for x in n.items if not isinstance(x, str) and not x.hidden)


def _within(top: Node) -> Iterator[Node]:
    """Elements that are in top, itself included, in page order."""
    todo = [top]
    while todo:
        n = todo.pop()
        yield n
        todo += [x for x in reversed(n.items) if not isinstance(x, str) and not x.hidden]


def _own(n: Node) -> int:
    """Characters of an element that are in none of its blocks."""
    return n.chars - sum(x.chars for x in n.items if not isinstance(x, str) and not x.hidden and x.tag in BLOCKS)


def _core(body: Node, nodes: list[Node]) -> Node:
    """The element with the largest sum. One without blocks in it, such as a paragraph, is no article by itself.

    A sum is of what an element holds, so text that stands in it directly doesn't count: where that is most of the text of
    an element around the one found, the outer one is the core.
    """
    best = body
    for n in nodes:
        if n.sum > best.sum and any(not isinstance(x, str) and x.tag in BLOCKS and not x.hidden for x in n.items):
            best = n
    place = best
    while place is not body and place.parent is not None:
        place = place.parent
        if 2 * _own(place) > place.chars:
            best = place
    return best


def by_density(nodes: list[Node], body: Node, core: Node) -> list[Node]:
    """What density takes with that core: it, and of each element at or above the threshold the part with the largest sum;
    in page order, none inside another."""
    place, threshold = core, core.density
    while place is not None:
        threshold = min(threshold, place.density)
        place = None if place is body else place.parent
    inner = [n for n in nodes if not n.hidden and n.chars]
    parts: dict[int, Node] = {}  # of each element, the one with the largest sum in it, itself included
    for n in reversed(inner):
        best = n
        for x in n.items:
            if not isinstance(x, str) and not x.hidden and x.chars and parts[id(x)].sum > best.sum:
                best = parts[id(x)]
        parts[id(n)] = best
    marked = {id(core)}
    for n in inner:
        if n.density >= threshold and n.tag in HOLDERS and 2 * n.link_chars < n.chars:
            part = parts[id(n)]
            if part.tag in HOLDERS and 2 * part.link_chars < part.chars:
                marked.add(id(part))
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        if id(n) in marked:
            out.append(n)
        else:
            todo += [x for x in reversed(n.items) if not isinstance(x, str) and not x.hidden]
    return out


def choose(nodes: list[Node]) -> list[Node]:
    """The elements whose text, without what is pruned in it, is the article, in page order, none inside another."""
    body = next((n for n in nodes if n.tag == "body" and not n.boilerplate), nodes[0])
    there = list(_within(body))
    core = _core(body, there)
    if core.boilerplate:
        core = _core(body, [n for n in there if not n.boilerplate])
    return [n for n in by_density(nodes, body, core) if not n.boilerplate]


def blocks(node: Node) -> Iterator[str]:
    """The texts of a subtree's blocks: character references decoded, white space made single spaces, none empty."""
    buffer: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            yield text

    todo: list = [(node, True)]
    while todo:
        item, begins = todo.pop()
        if isinstance(item, str):
            buffer.append(item)
            continue
        if not begins:
            yield from flush()
            continue
        if item.boilerplate:
            if item.tag in BLOCKS:
                yield from flush()
            continue
        if item.tag in ("br", "td", "th"):
            buffer.append(" ")
        if item.tag in BLOCKS:
            yield from flush()
            todo.append((item, False))
        todo += [(x, True) for x in reversed(item.items)]
    yield from flush()


def extract(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page, or one without text."""
    if not page:
        return ""
    _, nodes = parse(page)
    measure(nodes)
    return "\n".join(text for node in choose(nodes) for text in blocks(node))


def extract_column(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, text and n_chars of every row. Repeated rows stay, with equal results; an empty table gives no rows."""

    def run(texts: list) -> dict:
        out = [extract(t) for t in texts]
        return {"text": out, "n_chars": [len(t) for t in out]}

    return map_texts(pages, html, keep if keep is not None else ["page_id", "url"], lambda: run, "text string, n_chars long")

"""Main-text extraction by tree scoring.

A tolerant parser builds the element tree. Each paragraph earns points for its length and its commas and passes them to
its ancestors, in full to the parent and less further up; an element's points are discounted by its link density. The
best container and those of its siblings that look like text are kept, lifted to an enclosing article or main element.
Menus, footers, sidebars, adverts, forms, scripts and styles are cut by tag, role or hidden attribute before scoring.
A class or id only marks an element, and only if a whole name says so (`sidebar`, `cookie-notice`, but not `has-sidebar`
or `notice-of-motion`): marked elements are cut unless they hold the article or main element, or nearly all of the page's
text, and a heading is never marked by its id, which is an anchor.

The parser takes time linear in the page: open elements are found by their names' own stacks, and a tag that never ends is
looked for once. Rows are handled in place: no shuffle, memory bounded by a page. Defined cases: null, empty and textless
pages give an empty text; unclosed and stray tags are mended; quotes count after `=` only, and no longer once a tag's end
was found in quotes only; a page whose text is all cut gives an empty text; repeated rows give repeated rows; a kept column named text gives way; other extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.common import with_text, without

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CUT = frozenset("nav footer aside form button select option svg canvas object applet menu dialog head fieldset".split()) | RAW
KEEP = frozenset("html body article main".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Words of a class or id that mark what isn't the article, and words that may stand beside them in a name.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
BESIDE = frozenset(
    "a area bar block body bottom box btn button buttons card cell col column container content cta desktop fixed form global google group holder home icons inner item items js label left link links list main mobile module outer overlay page panel popular post posts primary reply right row secondary section site slot sticky strip tag the thread top unit user wrap wrapper zone 1 2 3".split()
)
#: Beside these, a header holds the article's title.
TITLED = frozenset("body content main page post section".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements that leave the head open.
HEAD = frozenset("html head title meta link base".split()) | RAW
#: What an opening tag closes, if that is open within the scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_rest = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_split = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_raw_end = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW}


class Node:
    __slots__ = ("cut", "kids", "links", "marked", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, marked: bool = False):
        self.tag, self.parent, self.cut, self.marked = tag, parent, cut, marked
        self.kids: list[Node | str] = []
        self.score, self.size, self.links = 0.0, 0, 0


class Stack:
    """The open elements, with the places of each name and of the block elements."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The innermost place of any of the names, 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first(self, *tags: str) -> int:
        """The outermost place of any of the names, 0 if none is open."""
        return min((self.at[t][0] for t in tags if self.at.get(t)), default=0)

    def close(self, i: int) -> None:
        """Closes what stands at place i and further in."""
        while len(self.nodes) > i:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def is_mark(name: str) -> bool:
    """Whether a whole class or id says that this isn't the article: marks and nothing but marks and the words beside them."""
    words = [w for w in _split.split(name) if w]
    low = [w.lower() for w in words]
    if "header" in low and not TITLED.isdisjoint(low):
        return False
    return any(w in MARKS for w in low) and all(w in MARKS or w in BESIDE or w.isdigit() for w in low)


def _attrs(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _attr.finditer(text)}


def _judged(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """(cut, marked); inside: an article or main is open."""
    if tag in CUT:
        return True, False
    if tag in KEEP:
        return False, False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True, False
    if tag == "header" and not inside:
        return True, False
    names = [*attrs.get("class", "").split(), *([] if tag in HEADINGS else attrs.get("id", "").split())]
    return False, any(is_mark(n) and not (inside and "header" in n.lower()) for n in names)


def parse(html: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", None)
    stack, at, n = Stack(root), 0, len(html)
    last_end, quotes = html.rfind(">"), True
    while at < n:
        if html[at] != "<":
            m = html.find("<", at)
            m = n if m < 0 else m
            stack.nodes[-1].kids.append(unescape(html[at:m]))
            at = m
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        closing = html.startswith("/", at + 1)
        m = _name.match(html, at + 1 + closing) if at < last_end else None
        if m is None:
            if at < last_end and html[at + 1] in "!?/":
                at = html.index(">", at) + 1
            else:
                stack.nodes[-1].kids.append("<")
                at += 1
            continue
        rest = _rest.match(html, m.end()) if quotes else None
        quotes = rest is not None  # every later bracket stands in quotes: tags end at the next one from here on
        stop = rest.end() if rest else html.index(">", m.end()) + 1
        tag, attrs, at = m[0].lower(), html[m.end() : stop - 1], stop
        if closing:
            i = stack.last(tag)
            if i and (tag in BLOCK or not stack.blocks or i > stack.blocks[-1]):
                stack.close(i)
            continue
        if tag in BLOCK and stack.blocks and stack.nodes[stack.blocks[-1]].tag == "p":
            stack.close(stack.blocks[-1])
        if tag not in HEAD and (stack.at.get("head") or tag in ("article", "main")):
            # a head ends at the first element of a body; menus and headers hold no article
            i = stack.first("head", "nav", "header") if tag in ("article", "main") else stack.first("head")
            if i:
                stack.close(i)
        if tag in CLOSES:
            scope = stack.last(*SCOPES[tag])
            i = min((p for t in CLOSES[tag] for p in _after(stack.at.get(t), scope)), default=0)
            if i:
                stack.close(i)
        if tag in RAW:
            end = _raw_end[tag].search(html, at)
            at = end.end() if end else n
            continue
        if attrs and not attrs.isspace() or tag == "header":
            node = Node(tag, stack.nodes[-1], *_judged(tag, _attrs(attrs), bool(stack.last("article", "main"))))
        else:
            node = Node(tag, stack.nodes[-1], tag in CUT)
        stack.nodes[-1].kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root


def _after(places: list[int] | None, scope: int) -> list[int]:
    """The first of the (ascending) places after the scope."""
    i = bisect.bisect_right(places, scope) if places else 0
    return places[i : i + 1] if places else []


def _measure(root: Node) -> list[Node]:
    """Sizes of text and of linked text, and the points that paragraphs pass up; the elements that aren't cut."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.size = node.links = 0
        node.score = 0.0
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and not k.cut]
    for node in reversed(order):
        own = commas = 0
        for k in node.kids:
            if isinstance(k, str):
                text = len(k.strip())
                own += text
                node.size += text
                commas += k.count(",") + k.count("，") + k.count("、")
            elif not k.cut:
                node.size += k.size
                node.links += k.size if k.tag == "a" else k.links
                if k.tag not in BLOCK:
                    own += k.size
        if own and (node.tag in BLOCK or node is root):
            points, up, share = (1 + commas + min(own / 100, 3)) * (1 - _density(node)), node if node.tag in ("div", "td", "section", "article", "main", "body", "#root") else node.parent, 1.0
            while up is not None and share > 0.05:
                up.score += points * share
                up, share = up.parent, share / 2
    return order


def _settle(root: Node, order: list[Node]) -> bool:
    """Cuts the marked elements, but for those that hold most of the text and an article, or leave hardly any other text and no article."""
    if not any(n.marked for n in order):
        return False
    whole = root.size - root.links
    holding, rest = {n.parent for n in order if n.tag in ("article", "main")}, 0
    for node in reversed(order):  # kids stand after their parents
        if node in holding and node.parent:
            holding.add(node.parent)
    under: set[Node] = set()
    for node in order:
        if node.marked or node.parent in under:
            under.add(node)
        else:
            rest += sum(len(k.strip()) for k in node.kids if isinstance(k, str))
    outside = any(n.tag in ("article", "main") and n not in under for n in order)
    for node in order:
        own = node.size - node.links
        if node.marked:
            node.cut = not (2 * own > whole and (node in holding or not outside and 10 * rest < own))
    return True


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.cut:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCK or x.tag == "#root":
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    order = _measure(root)
    if _settle(root, order):
        order = _measure(root)
    best, top = None, 0.0
    for node in order:  # in page order from the root, so that the outer of two equals is kept
        s = node.score * (1 - _density(node))
        if s > top and (node.tag in BLOCK or node is root):
            best, top = node, s
    if best is None:
        return ""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept, marked = [best], best.tag in ("article", "main")
    if best.parent is not None and best.tag not in ("body", "html"):
        kept = []
        for k in best.parent.kids:
            if k is best:
                kept.append(k)
            elif isinstance(k, Node) and not k.cut and k.tag in BLOCK:
                s = k.score * (1 - _density(k))
                short = not marked and k.tag == "p"  # without article or main, headings and short paragraphs may stand beside the container
                if s >= max(4.0, 0.2 * top) or (k.tag == "p" and (short or k.size > 80) and _density(k) < 0.25) or (not marked and k.tag in HEADINGS):
                    kept.append(k)
    return "\n".join(_blocks(kept))


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep with text."""
    keep = without(keep, ["text"])
    picked = with_text(pages, keep, "html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            text = pa.array([main_text(h.as_py()) for h in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], [*keep, "text"])

    return picked.mapInArrow(run, f"{schema}, text string")

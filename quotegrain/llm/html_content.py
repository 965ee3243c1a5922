"""Main text of web pages by a tree-structured graphical model.

Every element and every run of text of a page is a node with a hidden label: content or not. A node's own evidence (tag, words in
class and id, length, share of link text, punctuation) gives its unary potential; each parent and child share a pairwise
potential by the child's kind of tag. Sum-product messages go up from the leaves and down from the root, and the product at a leaf is its
content marginal. Both potentials are counted, with smoothing, from labelled pages.

Labelled pages are made up from a few layouts, with content and clutter known by construction, beside a bounded sample of the
given pages whose own article or main element is taken as the label.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.common import each_batch, hash_share, texts

#: Made-up labelled pages, and about how many given pages teach beside them.
MADE, SAMPLE = 800, 100

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button title audio video datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id and role that tell parts of a page apart.
CLUTTER = re.compile(
    r"(?:^|[-_ ])(nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|side\w*|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|notice\w*|alert|popup|modal|"
    r"comments?|commentlist|respon\w*|discussion|reactions?|related|recommend\w*|share|sharing|social|subscribe|newsletter|login|search\w*|form|tags?|meta|pag\w*|copyright|legal|widget\w*|toolbar)(?=$|[-_ \d])", re.I)
CONTENT = re.compile(r"(?:^|[-_ ])(article\w*|content|post\w*|entry\w*|story\w*|body|main|text)(?=$|[-_ \d])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    tag: str
    hint: str
    parent: int
    text: str = ""
    linked: int = 0
    hidden: bool = False
    label: int = -1


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents before children. Text runs between block tags are leaves with tag ``#``; text of skipped parts is gone.

    Tags left open at the end are closed there; a tag or comment that the page's end cuts off is dropped.
    """
    nodes = [Node("body", "", -1)]
    stack: list[tuple[str, int]] = [("body", 0)]
    run: list[str] = []
    linked = 0
    inside_link = 0
    skip = 0
    end, size = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                at = next(n for _, n in reversed(stack) if n >= 0)
                nodes.append(Node("#", "", at, text, min(linked, len(text))))
            run.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not skip:
            run.append(text)
            if inside_link:
                linked += len(text.strip())

    def pop_to(place: int) -> None:
        nonlocal skip, inside_link
        for tag, n in stack[place:]:
            skip -= tag in SKIPPED
            inside_link -= tag == "a"
            if n >= 0:
                flush()
        del stack[place:]

    while end < size:
        m = TOKEN.search(html, end)
        if m is None:
            # A lone "<" that starts a name is a tag that the end cuts off.
            add(re.sub(r"<[/a-zA-Z!?].*$", "", html[end:], flags=re.S))
            break
        add(html[end : m.start()])
        end = m.end()
        if m[1] is None:
            continue
        if not m[3]:
            break
        tag = m[1].lower()
        if m[0].startswith("</"):
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), None)
            if place is not None:
                if tag not in INLINE:
                    flush()
                pop_to(place)
            elif tag == "p":
                flush()
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in INLINE:
            stack.append((tag, -1))
            inside_link += tag == "a"
            continue
        closes = CLOSES.get(tag, ())
        if tag in ENDS_P:
            closes = ("p",)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closes:
                pop_to(k)
                break
            if stack[k][0] not in INLINE and (tag not in ENDS_P or stack[k][0] != "p"):
                break
        if tag not in SKIPPED:
            flush()
        if tag in SKIPPED:
            skip += 1
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>|$", re.I).search(html, end)
                end = close.end()
                skip -= 1
            else:
                stack.append((tag, -1))
            continue
        parent = next(n for _, n in reversed(stack) if n >= 0)
        nodes.append(Node(tag, _hint(m[2]), parent, hidden=False, label=_marked(m[2])))
        stack.append((tag, len(nodes) - 1))
    flush()
    return nodes


def _hint(attributes: str) -> str:
    """What class, id and role say: clutter by its first word, content, or nothing."""
    if "=" not in attributes:
        return ""
    said = " ".join(b or c or d for _, b, c, d in ATTRIBUTE.findall(attributes))
    if m := CLUTTER.search(said):
        return "-" + m[1].lower()[:4]
    return "+" if CONTENT.search(said) else ""


def _marked(attributes: str) -> int:
    """Label of an element in made-up pages."""
    m = re.search(r'data-y="([01])"', attributes)
    return int(m[1]) if m else -1


def _kind(node: Node) -> str:
    """Kind of a node for the pairwise potential: how it may turn from its parent's label."""
    if node.hint[:1] == "-":
        return "clutter"
    tag = node.tag if node.tag in FAMILIES else "other"
    return tag + node.hint + ("^" if node.parent == 0 else "")


FAMILIES = frozenset("# p h1 h2 h3 h4 ul ol li div section article main nav header footer aside form dialog table tr td blockquote pre figure".split())


def evidence(node: Node) -> Iterator[tuple[str, str]]:
    """(feature, value) of a node."""
    yield "tag", node.tag
    yield "hint", node.hint[:1]
    if node.tag == "#":
        yield "size", str(min(6, int(math.log2(len(node.text) + 1)) // 2))
        yield "linked", str(math.ceil(3 * node.linked / max(1, len(node.text))))
        yield "stops", str(min(2, sum(map(node.text.count, ".!?,;"))))
        yield "mark", str(("©" in node.text) + 0)


@dataclass
class TreeModel:
    """Potentials, counted with smoothing; ``unary`` holds logs, ``pair`` the chance of each child label under each parent label."""

    unary: dict = field(default_factory=dict)
    pair: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)

    @classmethod
    def count(cls, pages: list[list[Node]]) -> TreeModel:
        seen: dict = defaultdict(Counter)
        total: Counter = Counter()
        pairs: dict = defaultdict(Counter)
        for nodes in pages:
            for node in nodes[1:]:
                for f, v in evidence(node):
                    seen[f, v][node.label] += 1
                    total[f, node.label] += 1
                pairs[_kind(node)][nodes[node.parent].label, node.label] += 1
        model = cls()
        for (f, v), n in seen.items():
            model.unary[f, v] = tuple(math.log((n[y] + 0.5) / (total[f, y] + 5.0)) for y in (0, 1))
        for kind, n in pairs.items():
            model.pair[kind] = tuple((n[a, b] + 0.5 + 0.5 * (a == b)) / (n[a, 0] + n[a, 1] + 1.5) for a in (0, 1) for b in (0, 1))
        return model

    def own(self, node: Node) -> tuple[float, float]:
        """A node's evidence for clutter and content, adding to one; remembered, since values are few."""
        key = tuple(evidence(node))
        if key not in self.seen:
            logs = [self.unary[e] for e in key if e in self.unary]
            differ = sum(u[1] - u[0] for u in logs)
            content = 1 / (1 + math.exp(-max(-60.0, min(60.0, differ))))
            self.seen[key] = (1 - content, content)
        return self.seen[key]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node, by one pass of messages up and one down, each scaled to add to one."""
        n = len(nodes)
        own = self.own
        pair = [self.pair.get(_kind(node), EITHER) for node in nodes]
        in0, in1 = [ROOT[0]] * n, [ROOT[1]] * n
        up0, up1 = [0.5] * n, [0.5] * n
        for k in range(1, n):
            in0[k], in1[k] = own(nodes[k])
        for k in range(n - 1, 0, -1):
            p00, p01, p10, p11 = pair[k]
            a, b = p00 * in0[k] + p01 * in1[k], p10 * in0[k] + p11 * in1[k]
            a, b = a / (a + b), b / (a + b)
            up0[k], up1[k] = a, b
            at = nodes[k].parent
            a, b = in0[at] * a, in1[at] * b
            in0[at], in1[at] = a / (a + b), b / (a + b)
        out0, out1 = in0[:], in1[:]
        for k in range(1, n):
            p00, p01, p10, p11 = pair[k]
            at = nodes[k].parent
            a, b = out0[at] / up0[k], out1[at] / up1[k]
            a, b = (a * p00 + b * p10) * in0[k], (a * p01 + b * p11) * in1[k]
            out0[k], out1[k] = a / (a + b), b / (a + b)
        return out1


#: The root holds all parts of a page, so it is no content itself, as in the labelled pages.
ROOT = (0.999, 0.001)
#: Potential of a kind that no labelled page holds.
EITHER = (0.8, 0.2, 0.2, 0.8)


def spread_labels(nodes: list[Node]) -> list[Node]:
    """Unmarked nodes take their parent's label; the root counts as neither part, so as clutter."""
    nodes[0].label = max(nodes[0].label, 0)
    for node in nodes[1:]:
        if node.label < 0:
            node.label = nodes[node.parent].label
    return nodes


def weak_labels(nodes: list[Node]) -> list[Node] | None:
    """Labels of a given page from its own article or main element, or None if it has none."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    for node in nodes[1:]:
        if node.tag in ("article", "main"):
            node.label = 1
        elif node.tag in ("nav", "header", "footer", "aside", "form") or node.hint[:1] == "-":
            node.label = 0
    return spread_labels(nodes)


# Made-up pages.
_CLUTTER_CLASS = (
    "nav", "menu", "top-menu", "breadcrumb", "site-header", "header", "footer", "site-footer", "sidebar", "side-bar", "ad", "ads", "advert", "ad-box", "sponsored", "banner",
    "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "comments", "comment", "comment-list", "related", "recommended", "share", "social", "newsletter",
    "subscribe", "login", "search", "promo", "widget", "pagination", "copyright", "tags",
)
_CONTENT_CLASS = ("article", "content", "main-content", "post", "post-body", "entry", "entry-content", "story", "article-body", "text", "page-body")


def _words(r: random.Random, low: int, high: int) -> str:
    n = r.randint(low, high)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]
    for k in range(0, n, r.randint(6, 12)):
        words[k] = words[k].title() if not k else words[k] + r.choice((".", ",", ""))
    return " ".join(words) + r.choice((".", ".", "", "!"))


def _clutter(r: random.Random) -> str:
    links = lambda: "".join(f'<li><a href="/x">{_words(r, 1, 3)}</a></li>' for _ in range(r.randint(2, 8)))
    name = r.choice(_CLUTTER_CLASS)
    body = r.choice((
        lambda: f"<ul>{links()}</ul>", lambda: f"<p>{_words(r, 4, 40)}</p>", lambda: _words(r, 2, 30), lambda: f"<h3>{_words(r, 1, 4)}</h3><ul>{links()}</ul>",
        lambda: f"<div><b>{_words(r, 1, 2)}</b><p>{_words(r, 5, 60)}</p></div>" * r.randint(1, 3), lambda: f"<h2>{_words(r, 1, 3)}</h2><p>{_words(r, 5, 60)}</p><p>{_words(r, 5, 60)}</p>",
    ))()
    tag = r.choice(("div", "div", "section", "nav", "aside", "header", "footer", "form", "ul", "dialog"))
    if tag in ("nav", "aside", "header", "footer", "form", "dialog") and r.random() < 0.6:
        attribute = ""
    else:
        attribute = f' {r.choice(("class", "class", "id"))}="{name}"'
    if tag == "ul":
        body = links()
    if tag == "footer":
        body = f"&copy; {_words(r, 1, 4)} {body}"
    return f'<{tag}{attribute} data-y="0">{body}</{tag}>'


def _content(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, 2, 10)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 8)):
        parts.append(r.choice((
            lambda: f"<p>{_words(r, 1, 120)}</p>", lambda: f"<p>{_words(r, 10, 90)}</p>", lambda: f"<p>{_words(r, 20, 90)} <a href='/y'>{_words(r, 1, 3)}</a> {_words(r, 3, 20)}</p>",
            lambda: f"<h2>{_words(r, 1, 6)}</h2><p>{_words(r, 5, 60)}</p>", lambda: "<ul>" + "".join(f"<li>{_words(r, 2, 25)}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
            lambda: f"<blockquote><p>{_words(r, 5, 40)}</p></blockquote>", lambda: f"<div>{_words(r, 10, 80)}</div>", lambda: f"<pre>{_words(r, 3, 20)}</pre>",
            lambda: f"<table><tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr></table>",
        ))())
        if r.random() < 0.08:
            parts.append(_clutter(r))
    tag, attribute = r.choice((("article", ""), ("article", f' class="{r.choice(_CONTENT_CLASS)}"'), ("main", ""), ("div", f' class="{r.choice(_CONTENT_CLASS)}"'), ("div", f' id="{r.choice(_CONTENT_CLASS)}"'), ("section", "")))
    return f'<{tag}{attribute} data-y="1">{"".join(parts)}</{tag}>'


def made_page(seed: int) -> str:
    r = random.Random(seed)
    before, after = ("".join(_clutter(r) for _ in range(r.randint(0, 4))) for _ in range(2))
    middle = _content(r)
    if r.random() < 0.3:
        middle = f'<div class="{r.choice(("wrapper", "container", "page", "row"))}" data-y="0">{_clutter(r)}{middle}{_clutter(r)}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 6)}</title></head><body>{before}{middle}{after}</body></html>"


def fit(pages: DataFrame, made: int = MADE, sample: int = SAMPLE) -> TreeModel:
    """Potentials from ``made`` made-up pages and about ``sample`` given ones, chosen by a hash of the id."""
    rows = hash_share(pages.select(F.col("page_id").alias("doc_id"), "html"), pages.select("page_id"), None, sample)
    given = [r["html"] or "" for r in rows.orderBy("doc_id").select(F.col("html")).collect()]
    weak = [n for n in (weak_labels(parse(h)) for h in given) if n]
    return TreeModel.count([spread_labels(parse(made_page(k))) for k in range(made)] + weak)


def main_text(html: str, model: TreeModel) -> str:
    """Blocks with a content marginal of a half or more, in page order, one per line."""
    nodes = parse(html)
    return "\n".join(n.text for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.tag == "#" and p >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``(page_id, url, html).

    Null or empty html, and pages without content: empty text. Repeated rows and ids stay. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = fit(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(h, model) for h in texts(batch["html"])]
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(each_batch(run), "page_id long, url string, text string, n_chars long")

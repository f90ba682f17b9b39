"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 7).

A page is parsed into a tree of blocks (elements that start a line, with runs of inline
text as leaves). For every node a feature row is made: density of its subtree (text, links,
marks, paragraphs), tag and parent's tag, words of its class, id and role, depth, and its
place among its siblings. Boosted trees give the probability that a node's subtree holds
main text. Decoding is hierarchical: a node can only be kept under a kept parent, and the
labelling of the whole tree with the highest likelihood under that rule is found exactly,
bottom up and then top down, so no ancestor and descendant contradict each other.

The trees are fitted here, on pages that this module writes itself from layouts of menus,
headers, sidebars, notices, adverts, forms, comments and articles (TRAIN_PAGES of them, a
bound stated here, from a fixed seed), once for each application.

Text: character references are decoded, white space inside a block is one space, ends are
trimmed, blocks are joined by one newline in page order; nothing else is dropped or capped.

Defined cases: a null or empty html, and a page without main text, gives an empty text;
unclosed, stray and cut-off tags are read as browsers do where it matters (p, li, cells,
unclosed scripts and comments); pages may have any length and depth; repeated rows are
extracted each alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import lead_columns, table

TRAIN_PAGES = 360
ROUNDS = 40
DEPTH = 4
BINS = 32
RATE = 0.25

#: Elements whose content is not text of the page, and elements that start a new block; fixed by HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = set(
    """html head body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul button noscript object video audio canvas""".split()
)
VOID = {"hr", "br", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
CLOSES_P = BLOCKS - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "button", "noscript", "object", "video", "audio", "canvas"}
OWN_KIND = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")  # a quote opens a value only after =
_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_NAMES = re.compile(r"""(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_TOKENS = re.compile("[a-z]+")
_STOPS = re.compile(r"[.!?。]")


class Node:
    __slots__ = ("tag", "names", "kids", "parent", "text", "links", "row")

    def __init__(self, tag: str, names: str, parent):
        self.tag, self.names, self.parent, self.kids, self.text, self.links, self.row = tag, names, parent, [], None, 0, -1


def parse(page: str) -> Node:
    """The tree of blocks; a leaf with tag #text is a run of inline text, its links the letters inside links."""
    root = here = Node("#root", "", None)
    run: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                leaf = Node("#text", "", here)
                leaf.text, leaf.links = text, min(linked, len(text))
                here.kids.append(leaf)
            run.clear()
        linked = 0

    while at < end:
        to = page.find("<", at)
        if to < 0:
            to = end
        if to > at:
            piece = page[at:to]
            run.append(piece)
            if in_link:
                linked += len(piece)
        if to == end:
            break
        at = to
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                at = end if to < 0 else to + 3
            else:
                to = page.find(">", at)
                at = end if to < 0 else to + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            if after.isalpha() or after == "/" and page[at + 2 : at + 3].isalpha():
                break  # a tag that the page's end cuts off
            if after == "/":
                to = page.find(">", at)
                at = end if to < 0 else to + 1
                continue
            run.append("<")
            at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS or "-" in tag:
                node = here
                while node is not None and node.tag != tag:
                    if tag in ("p", "li", "dt", "dd") and node.tag in ("div", "section", "article", "ul", "ol", "table", "body", "td"):
                        node = None
                        break
                    node = node.parent
                if node is not None and node.parent is not None:
                    flush()
                    here = node.parent
                elif tag == "p":
                    flush()
            continue
        if tag in RAW:
            close = _ENDS[tag].search(page, at)
            if not close:
                break
            stop = page.find(">", close.start())
            at = end if stop < 0 else stop + 1
            continue
        if tag == "a":
            in_link = True
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS or "-" in tag:
            flush()
            if tag in CLOSES_P:
                node = here
                while node is not None and node.tag in ("p", "button"):
                    here = node = node.parent
            if tag in OWN_KIND:
                kinds, scope = OWN_KIND[tag]
                node = here
                while node is not None and node.tag not in scope:
                    if node.tag in kinds:
                        here = node.parent
                        if tag != "tr":
                            break
                    node = node.parent
            if tag not in VOID:
                attrs = m[3]
                names = " ".join(_NAMES.findall(attrs)).lower() if "=" in attrs else ""
                if " hidden" in attrs or "display:none" in attrs:
                    names += " hidden"
                child = Node(tag, names, here)
                here.kids.append(child)
                if not attrs.endswith("/") or tag in BLOCKS:
                    here = child
    flush()
    return root


#: Words in class, id and role that layouts use; each group is a feature.
GROUPS = {
    "main": ("article", "content", "main", "body", "post", "entry", "story", "text", "blog", "page", "column"),
    "menu": ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "crumbs", "tabs", "toc", "pagination", "pager", "links", "navigation"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "adsense", "promoted"),
    "frame": ("header", "footer", "masthead", "topbar", "bottom", "foot", "head", "copyright", "legal", "contentinfo", "colophon"),
    "side": ("sidebar", "side", "aside", "related", "widget", "rail", "recommended", "popular", "trending", "complementary", "more"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "respond", "disqus", "feedback", "reviews"),
    "notice": ("cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "privacy", "hidden", "disclaimer", "message"),
    "form": ("form", "search", "login", "signup", "newsletter", "subscribe", "contact", "register", "share", "social", "sharing", "tags", "meta", "byline", "author"),
}
WORD_GROUP = {w: i for i, words in enumerate(GROUPS.values()) for w in words}
TAG_GROUPS = [{"p", "pre", "blockquote"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"div", "center", "section", "td"}, {"li", "ul", "ol", "menu", "dl", "dt", "dd"}, {"article", "main"}, {"nav"}, {"header", "footer", "address"}, {"aside", "dialog", "details"}, {"form", "fieldset", "select", "option", "button", "search", "summary", "template", "noscript"}, {"table", "tbody", "thead", "tfoot", "tr", "th"}, {"#text"}, {"html", "body", "head", "#root"}]
TAG_GROUP = {t: i for i, tags in enumerate(TAG_GROUPS) for t in tags}
N_FEATURES = 28 + 2 * len(GROUPS)


def nodes_of(root: Node) -> list[Node]:
    """All nodes, each before its descendants, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.row = len(out)
        out.append(node)
        stack += reversed(node.kids)
    return out


def features(order: list[Node]) -> np.ndarray:
    n = len(order)
    letters, links, stops, paragraphs, leaves, longest, words = (np.zeros(n) for _ in range(7))
    for i in range(n - 1, -1, -1):
        node = order[i]
        if node.text is not None:
            size = len(node.text)
            letters[i], links[i], stops[i], leaves[i], longest[i], words[i] = size, node.links, len(_STOPS.findall(node.text)), 1, size, node.text.count(" ") + 1
        elif node.tag == "p":
            paragraphs[i] += 1
        if node.parent is not None:
            j = node.parent.row
            letters[j] += letters[i]
            links[j] += links[i]
            stops[j] += stops[i]
            paragraphs[j] += paragraphs[i]
            leaves[j] += leaves[i]
            words[j] += words[i]
            if longest[i] > longest[j]:
                longest[j] = longest[i]
    before = np.zeros(n)
    x = np.zeros((n, N_FEATURES), np.float32)
    groups = len(GROUPS)
    depth = np.zeros(n)
    total = max(1.0, letters[0]) if n else 1.0
    rows, parents, tags, ptags, sibs, index = [], np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    seen = 0.0
    for i, node in enumerate(order):
        before[i] = seen
        if node.text is not None:
            seen += len(node.text)
        tags[i] = TAG_GROUP.get(node.tag, 2)
        if node.names:
            for w in _TOKENS.findall(node.names):
                g = WORD_GROUP.get(w)
                if g is not None:
                    x[i, 28 + g] = 1
        p = node.parent
        if p is not None:
            j = p.row
            parents[i], depth[i], ptags[i] = j, depth[j] + 1, tags[j]
            above = x[j, 28 + groups :]
            x[i, 28 + groups :] = np.maximum(above, x[j, 28 : 28 + groups])
        for k, kid in enumerate(node.kids):
            index[kid.row], sibs[kid.row] = k, len(node.kids)
    safe = np.maximum(letters, 1)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = tags, ptags, np.minimum(depth, 30), np.log1p(letters)
    x[:, 4], x[:, 5], x[:, 6], x[:, 7] = links / safe, stops / np.maximum(words, 1), np.log1p(paragraphs), np.log1p(leaves)
    x[:, 8], x[:, 9], x[:, 10], x[:, 11] = letters / np.maximum(leaves, 1), np.log1p(longest), letters / total, before / total
    x[:, 12], x[:, 13], x[:, 14] = letters / np.maximum(letters[parents], 1), index, sibs
    x[:, 15], x[:, 16], x[:, 17] = links[parents] / np.maximum(letters[parents], 1), np.log1p(letters[parents]), np.log1p(paragraphs[parents])
    grand = parents[parents]
    x[:, 18], x[:, 19], x[:, 20] = tags[grand], np.log1p(paragraphs[grand]), letters / np.maximum(words, 1)
    for k, group in enumerate((4, 5, 6, 7, 8)):  # whether an ancestor is an article, a menu, a frame, an aside, a form
        own = tags == group
        inside = np.zeros(n, bool)
        for i in range(1, n):
            inside[i] = inside[parents[i]] or own[parents[i]]
        x[:, 21 + k] = inside
    x[:, 26] = (before + letters) / total
    x[:, 27] = np.array([order[i].tag == "h1" for i in range(n)])
    return x


class Trees:
    """Gradient-boosted trees for a yes or no, over binned features; each tree is complete to DEPTH."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        binned = self.binned(x)
        self.start = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            tree = self.grow(binned, g, h)
            self.trees.append(tree)
            score += self.leaf(binned, tree)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        size, n_features = 2**DEPTH - 1, binned.shape[1]
        feature, cut, value = np.zeros(size, np.int64), np.full(size, 255, np.int64), np.zeros(2**DEPTH)
        at = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            slot = (at - first) * BINS
            total_g, total_h = np.bincount(at - first, g, width), np.bincount(at - first, h, width)
            for j in range(n_features):
                gs = np.bincount(slot + binned[:, j], g, width * BINS).reshape(width, BINS).cumsum(1)[:, :-1]
                hs = np.bincount(slot + binned[:, j], h, width * BINS).reshape(width, BINS).cumsum(1)[:, :-1]
                rg, rh = total_g[:, None] - gs, total_h[:, None] - hs
                gain = gs**2 / (hs + 1) + rg**2 / (rh + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(hs < 1e-3) | (rh < 1e-3)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = k[better]
            at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - size
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        return feature, cut, value

    def leaf(self, binned: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return value[at - (2**DEPTH - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log p - log(1 - p) for each row."""
        binned, score = self.binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            score += self.leaf(binned, tree)
        return score


def decode(order: list[Node], margin: np.ndarray) -> list[bool]:
    """The likeliest labels under the rule that a kept node's parent is kept: a subtree is kept where that gains."""
    gain = margin.astype(float).tolist()
    for i in range(len(order) - 1, 0, -1):
        if gain[i] > 0:
            gain[order[i].parent.row] += gain[i]
    keep = [False] * len(order)
    for i, node in enumerate(order):
        keep[i] = gain[i] > 0 and (node.parent is None or keep[node.parent.row])
    return keep


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    orders = [nodes_of(parse(p)) for p in pages]
    if not orders:
        return []
    margin = trees.margin(np.concatenate([features(o) for o in orders]))
    out, at = [], 0
    for order in orders:
        keep = decode(order, margin[at : at + len(order)])
        out.append("\n".join(node.text for node, k in zip(order, keep, strict=True) if k and node.text is not None))
        at += len(order)
    return out


# Training pages


def _layout(rng: random.Random) -> tuple[str, set[str]]:
    """A page, and the blocks of its main text. Blocks carry a number, by which the parsed leaves are labelled."""
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "sha", "ou", "en", "pri", "vel", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    serial, main = [0], set()

    def say(low: int, high: int, stop: bool = True) -> str:
        serial[0] += 1
        n = rng.randint(low, high)
        text = [rng.choice(words) for _ in range(n)]
        for k in range(0, n, rng.randint(6, 14)):
            text[k] = text[k].capitalize()
            if k and stop:
                text[k - 1] += rng.choice(".,.")
        return f"Q{serial[0]}q " + " ".join(text) + ("." if stop else "")

    def told(low: int, high: int, stop: bool = True) -> str:
        text = say(low, high, stop)
        main.add(text.split()[0])
        return text

    def box(tag: str, names: list[str], inside: str, semantic: str | None = None) -> str:
        kind = rng.random()
        if semantic and kind < 0.4:
            return f"<{semantic}>{inside}</{semantic}>"
        name = rng.choice(names)
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-box", " wide", "_1"])}">{inside}</{tag}>'

    def linked(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3, False)}</a></li>' for i in range(n)) + "</ul>"

    def advert() -> str:
        inside = rng.choice([say(2, 14), f"<p>{say(3, 20)}</p>", f'<a href="/x">{say(2, 8)}</a>'])
        return box(rng.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "banner", "promo", "sponsored"], inside)

    def paragraph() -> str:
        shape = rng.random()
        body = told(1, 4) if shape < 0.12 else told(5, 140)
        if shape > 0.8:
            body = f"<b>{body}"
            return f"<p>{body}<br>" if rng.random() < 0.6 else f"<p>{body}</b></p>"
        if shape > 0.7:
            half = body.split(" ")
            k = len(half) // 2
            body = " ".join([*half[:k], f'<a href="/y">{" ".join(half[k : k + 2])}</a>', *half[k + 2 :]])
        return f"<p>{body}" + rng.choice(["</p>", "</p>", "</p>", ""])

    parts = [f"<h1>{told(1, 12, False)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.choice([0, 1, 1, 2, 4, 8, 14])):
        kind = rng.random()
        if kind < 0.74:
            parts.append(paragraph())
        elif kind < 0.8:
            parts.append(f"<h2>{told(1, 8, False)}</h2>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li>{told(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote>{told(5, 40)}</blockquote>")
        elif kind < 0.91:
            parts.append("<table><tr>" + "".join(f"<td>{told(1, 6, False)}</td>" for _ in range(3)) + "</tr></table>")
        elif kind < 0.96:
            parts.append(advert())
        else:
            parts.append(box("div", ["share", "social", "newsletter", "related"], linked(3)))
    article = "".join(parts)
    holder = rng.random()
    if holder < 0.6:
        article = f"<article>{article}</article>"
    elif holder < 0.75:
        article = f"<main>{article}</main>"
    elif holder < 0.97:
        article = box("div", ["article", "content", "post", "entry", "story", "main"], article)
    comments = ""
    if rng.random() < 0.4:
        one = "".join(f'<div class="{rng.choice(["comment", "reply"])}"><p>{say(3, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
        comments = box(rng.choice(["section", "div"]), ["comments", "discussion", "comment-list", "reviews"], f"<h3>{say(1, 3, False)}</h3>" + one)
        if rng.random() < 0.3 and article.endswith("</article>"):
            article, comments = article[: -len("</article>")] + comments + "</article>", ""
    side = box("div", ["sidebar", "side", "related", "widget"], rng.choice([linked(4), f"<h3>{say(1, 3, False)}</h3><p>{say(5, 40)}</p>"]), "aside") if rng.random() < 0.4 else ""
    top = [box("div", ["header", "masthead", "topbar"], rng.choice([say(1, 6, False), f"<p>{say(2, 10)}</p>", f"<h2>{say(1, 5, False)}</h2>"]), "header") if rng.random() < 0.4 else "", box("div", ["menu", "nav", "navbar"], linked(rng.randint(2, 8)), "nav") if rng.random() < 0.8 else "", box("div", ["cookie", "notice", "alert", "consent"], f"<p>{say(4, 30)}</p>") if rng.random() < 0.3 else "", advert() if rng.random() < 0.7 else "", f'<form action="/s">{say(1, 3, False)}<select><option>{say(1, 2, False)}</option></select><button>{say(1, 1, False)}</button></form>' if rng.random() < 0.25 else "", box("div", ["breadcrumbs"], f'<a href="/">{say(1, 1, False)}</a> &gt; <a href="/z">{say(1, 2, False)}</a>') if rng.random() < 0.2 else ""]
    rng.shuffle(top)
    foot = box("div", ["footer", "copyright", "legal"], rng.choice([f"&copy; {say(2, 20)}", f"<p>{say(3, 20)}</p>", linked(4)]), "footer") if rng.random() < 0.85 else ""
    middle = [article, side] if rng.random() < 0.5 else [side, article]
    if rng.random() < 0.2:
        middle = [f'<div class="{rng.choice(["wrap", "row", "page", "container"])}">{"".join(middle)}</div>']
    end = [comments, advert() if rng.random() < 0.2 else "", foot]
    page = f'<!DOCTYPE html><html><head><title>{say(2, 8, False)}</title><style>p{{margin:0}}</style></head><body>{"".join(top)}{"".join(middle)}{"".join(end)}</body></html>'
    return page, main


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Trees:
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page, main = _layout(rng)
        order = nodes_of(parse(page))
        y = np.zeros(len(order))
        for i in range(len(order) - 1, -1, -1):
            node = order[i]
            if node.text is not None and node.text.split()[0] in main:
                y[i] = 1
            if y[i] and node.parent is not None:
                y[node.parent.row] = 1
        xs.append(features(order))
        ys.append(y)
        ws.append(np.ones(len(order)))
    return Trees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    trees = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 100):
                part = b.slice(k, 100)
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return lead_columns(pages, ["page_id", "url", "html"]).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

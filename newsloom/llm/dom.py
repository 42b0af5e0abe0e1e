"""A small tolerant HTML tree, and the features of its nodes. Per-page helpers of newsloom.llm.html."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|([^<]+)|(<)", re.S)
#: A tag whose quotes do not close before the page ends: it ends at the first > or with the page.
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Fixed values of HTML: elements without an end tag, with raw text, that end a paragraph, that stay inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("noscript iframe template svg math select option head button object canvas audio video".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_SAME = frozenset("li dt dd tr td th option".split())
HEAD = frozenset("base link meta noscript script style template title".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
#: Tags with a feature of their own.
TAGS = "html body div section main article header footer nav aside form ul ol li table td p h1 h2 h3 blockquote pre figure figcaption button".split()
#: Parts of class, id and role names by what they tell.
HINTS = {
    "main": "article content story main entry post body text prose",
    "menu": "nav menu breadcrumb toc pagination pager tabs links skip",
    "edge": "header footer masthead topbar bottom copyright legal colophon banner",
    "side": "sidebar side aside widget related recommend recirc trending popular more teaser promo",
    "advert": "ad ads advert advertisement sponsor sponsored doubleclick dfp promoted",
    "notice": "cookie consent notice gdpr alert popup modal overlay paywall newsletter subscribe signup disclaimer",
    "reader": "comment comments reply replies discussion disqus respond thread",
    "share": "share social follow like tweet author byline tags meta",
    "form": "form search login input field",
}
HINT_OF = {w: k for k, (_, ws) in enumerate(HINTS.items()) for w in ws.split()}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Tree:
    """Nodes in page order. text: (node, block, piece) in page order."""

    def __init__(self):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.attr: list[str] = []
        self.text: list[tuple[int, int, str]] = []


def parse(page: str) -> Tree:
    """The tree of a page; unclosed and misplaced tags are repaired as browsers mostly do. Script, style and comments have no text.

    A page cut inside a tag loses that tag. From the first tag whose quotes never close, quotes count as plain marks.
    """
    t = Tree()
    stack: list[int] = []
    block = 0

    def open_(tag: str, attr: str) -> int:
        t.tag.append(tag), t.parent.append(stack[-1] if stack else -1), t.attr.append(attr)
        return len(t.tag) - 1

    stack.append(open_("html", ""))
    at, n = 0, len(page)
    opened: Counter[str] = Counter()
    quotes = True

    def pop() -> str:
        tag = t.tag[stack.pop()]
        opened[tag] -= 1
        return tag

    while at < n:
        m = TOKEN.match(page, at) if quotes else None
        if m is None or m.group(5):
            cut = OPEN_TAG.match(page, at)
            quotes &= cut is None
            m = cut or TOKEN.match(page, at)
        at = m.end()
        closing, tag, attr, text = (*m.groups(), None)[:4]
        if m.re is TOKEN and m.group(5):
            text = "<"
        if m.re is OPEN_TAG and not m.group().endswith(">"):
            break
        if text is not None:
            t.text.append((stack[-1], block, text))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag not in VOID and opened[tag]:
                while pop() != tag:
                    pass
            block += tag not in INLINE
            continue
        if tag == "br":
            t.text.append((stack[-1], block, "\n"))
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body") and len(stack) < 3 and tag in (t.tag[x] for x in stack):
            continue
        if t.tag[stack[-1]] == "head" and tag not in HEAD:
            pop()
        close = tag if tag in CLOSES_SAME else "p" if tag in ENDS_P else None
        if close and opened[close]:
            for k in range(len(stack) - 1, 0, -1):
                if t.tag[stack[k]] == close:
                    while len(stack) > k:
                        pop()
                    break
                if t.tag[stack[k]] not in INLINE and t.tag[stack[k]] != "p":
                    break
        block += tag not in INLINE
        node = open_(tag, attr or "")
        if tag not in VOID and not (attr or "").endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return t


def hints(attr: str) -> tuple[list[int], bool]:
    """Which groups of HINTS the attributes name, and whether the element is hidden."""
    if not attr or attr.isspace():
        return [], False
    found, hidden = [], False
    for m in ATTRIBUTE.finditer(attr):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name != "style":
            found += [HINT_OF[w] for w in map(str.lower, NAME.findall(value)) if w in HINT_OF]
    return found, hidden


NAMES = [
    *(f"tag_{t}" for t in TAGS), "tag_other",
    *(f"own_{h}" for h in HINTS), *(f"above_{h}" for h in HINTS), "hidden", "above_nav", "above_footer", "above_aside", "above_form", "above_article", "above_main",
    "depth", "log_text", "log_tags", "density", "link_share", "share_of_page", "share_of_parent", "index", "siblings", "sibling_text", "sibling_same",
    "paragraphs", "stops", "word_length", "before", "after",
]


def node_features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(features, characters of the subtree) of every node: tag, attribute tokens (own and inherited), subtree density, depth, siblings."""
    n, g = len(t.tag), len(HINTS)
    parent = np.array(t.parent)
    depth, chars, links, stops, words, tags, paras = (np.zeros(n) for _ in range(7))
    first = np.full(n, -1.0)
    seen = 0.0
    for node, _, s in t.text:
        c = len(s) - s.count(" ") - s.count("\n")
        chars[node] += c
        stops[node] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
        words[node] += s.count(" ") + 1
        if first[node] < 0:
            first[node] = seen
        seen += c
    own, above = np.zeros((n, g)), np.zeros((n, g))
    hidden = np.zeros(n)
    under = np.zeros((n, 6))
    special = {"nav": 0, "footer": 1, "aside": 2, "form": 3, "article": 4, "main": 5}
    in_link = np.zeros(n, bool)
    for i in range(n):
        p = t.parent[i]
        found, hid = hints(t.attr[i])
        own[i, found] = 1
        hidden[i] = hid
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], own[p])
            under[i] = under[p]
            hidden[i] = max(hidden[i], hidden[p])
            in_link[i] = in_link[p]
        if t.tag[i] in special:
            under[i, special[t.tag[i]]] = 1
        in_link[i] |= t.tag[i] in ("a", "button")
    links[in_link] = chars[in_link]
    tags += 1
    paras += np.array([x == "p" for x in t.tag])
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        for a in (chars, links, stops, words, tags, paras):
            a[p] += a[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    first = np.maximum(first, 0)
    up = np.maximum(parent, 0)
    kids = np.bincount(up[1:], minlength=n)
    index = np.zeros(n)
    count: dict[int, int] = {}
    for i in range(1, n):
        index[i] = count.get(t.parent[i], 0)
        count[t.parent[i]] = index[i] + 1
    number = {tag: k for k, tag in enumerate(TAGS)}
    kind = np.array([number.get(x, len(TAGS)) for x in t.tag])
    pair, inverse, same = np.unique(np.stack([up, kind]), axis=1, return_inverse=True, return_counts=True)
    total = max(seen, 1.0)
    siblings = np.maximum(kids[up] - 1, 0)
    one = np.zeros((n, len(TAGS) + 1))
    one[np.arange(n), kind] = 1
    x = np.column_stack([
        one, own, above, hidden, under,
        depth, np.log1p(chars), np.log1p(tags), chars / tags, links / np.maximum(chars, 1), chars / total, chars / np.maximum(chars[up], 1),
        index / np.maximum(kids[up], 1), np.minimum(siblings, 50), np.log1p((chars[up] - chars) / np.maximum(siblings, 1)), same[inverse.ravel()] / np.maximum(kids[up], 1),
        np.log1p(paras), stops / np.maximum(words, 1), chars / np.maximum(words, 1), first / total, np.maximum(total - first - chars, 0) / total,
    ])
    return x, chars


def chosen_text(t: Tree, keep: np.ndarray) -> str:
    """The text of kept nodes: references decoded, white space one blank, blocks in page order."""
    parts: list[str] = []
    last = None
    for node, block, s in t.text:
        if keep[node]:
            if last is not None and block != last:
                parts.append(" ")
            parts.append(s)
            last = block
    return " ".join(html.unescape("".join(parts)).split())


def decode(t: Tree, p: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Which nodes are kept. If none is, but one has `least`, odds are raised until the likeliest is kept."""
    keep = _decode(t, p)
    if not keep.any() and least <= (top := p.max(initial=0)) < 1:
        odds = p / np.maximum(1 - p, 1e-9) * (1 - top) / top * 2
        keep = _decode(t, odds / (1 + odds))
    return keep


def _decode(t: Tree, p: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which a kept or dropped node decides its whole subtree.

    A node is kept whole, dropped whole, or left open; only open nodes have children of both kinds.
    An open node's own text is dropped, unless it is likelier kept.
    """
    n = len(p)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    never = np.zeros(n, bool)
    for i in range(n):  # what stays inside a line goes with what holds it
        q = t.parent[i]
        never[i] = t.tag[i] in NEVER or q >= 0 and never[q]
        p[i] = 1e-9 if never[i] else p[q] if q >= 0 and t.tag[i] in INLINE else p[i]
    yes, no = np.log(p), np.log(1 - p)
    all_yes, all_no, mixed = yes.copy(), no.copy(), np.zeros(n)
    kids = np.zeros(n, bool)
    best = np.zeros(n)
    state = np.zeros(n, np.int8)  # 1 kept, 0 dropped, 2 open
    for i in range(n - 1, -1, -1):
        options = (all_no[i], all_yes[i], mixed[i] - 0.3 if kids[i] else -np.inf)
        state[i] = int(np.argmax(options))
        best[i] = options[state[i]]
        q = t.parent[i]
        if q >= 0:
            all_yes[q] += all_yes[i]
            all_no[q] += all_no[i]
            mixed[q] += best[i]
            kids[q] = True
    keep = np.zeros(n, bool)
    decided = np.zeros(n, bool)
    for i in range(n):
        q = t.parent[i]
        if q >= 0 and decided[q]:
            keep[i], decided[i] = keep[q], True
        else:
            decided[i] = state[i] != 2
            keep[i] = state[i] == 1 or state[i] == 2 and p[i] > 0.5
    return keep & ~never

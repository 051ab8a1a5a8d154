"""Pages as trees of block elements, with the features of each node."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Fixed values of HTML: elements without content, elements whose text is not shown, inline elements, and what closes an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg math head title iframe object textarea select option datalist canvas audio video map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input button".split())
SAME_CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: Tokens of class, id and role by what they tell of a node.
TOKENS = {
    "content": "article articles content main post posts entry story body text prose hentry markdown richtext page",
    "navigation": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc tabs tab skip topnav subnav",
    "header": "header head masthead banner logo brand topbar toolbar",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "sidebar": "sidebar aside side rail widget widgets complementary secondary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall announcement disclaimer dialog",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses thread",
    "share": "share sharing social follow related recommended recommendations more tags tag tagged author byline meta",
    "form": "form search searchbox login register contact input field submit",
}
TOKEN_OF = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
#: Tags with a feature of their own.
TAGS = "article main section div p li ul ol nav header footer aside form table td blockquote pre figure h1 h2 h3 h4 h5 h6 body dl dd address details dialog".split()
TAG_OF = {t: k for k, t in enumerate(TAGS)}

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: int  # bits of TOKENS
    marked: int = 0  # for training: 1 the page's article, 2 a block of a new layout's article
    nth: int = 0  # among its siblings
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # own text blocks
    chars: int = 0  # of the subtree's text
    link_chars: int = 0
    tags: int = 0
    inputs: int = 0
    stops: int = 0
    n_blocks: int = 0
    at: int = 0  # text before it, in the page


def attribute_tokens(attributes: str) -> int:
    bits = 0
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for w in _TOKEN.findall(_CAMEL.sub(r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
                if w in TOKEN_OF:
                    bits |= 1 << TOKEN_OF[w]
    return bits


def parse(page: str) -> tuple[list[Node], list[str]]:
    """(nodes, text blocks) of a page; node 0 is the root, each block belongs to one node.

    A block is the text between two starts or ends of block elements, with
    character references decoded and white space turned into single blanks.
    """
    nodes = [Node("body", -1, 0, 0)]
    blocks: list[str] = []
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements and the block node they belong to
    pieces: list[str] = []
    linked = seen = 0
    anchors = 0

    def flush() -> None:
        nonlocal linked, seen
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            text = _SPACE.sub(" ", text).strip()
            if text:
                own = nodes[stack[-1][1]]
                own.blocks.append(len(blocks))
                own.chars += len(text)
                own.link_chars += min(linked, len(text))
                own.stops += text.count(".") + text.count(",")
                own.n_blocks += 1
                blocks.append(text)
                seen += len(text)
            pieces.clear()
            linked = 0

    def close(depth: int) -> None:
        nonlocal anchors
        if any(t not in INLINE for t, _ in stack[depth:]):
            flush()
        anchors -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    at, size = 0, len(page)
    search = _MARKUP.search
    while at < size:
        m = search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        a = m.start()
        if a > at:
            pieces.append(page[at:a])
            if anchors:
                linked += a - at
        at = m.end()
        if m[1] is not None:
            tag = m[1].lower()
            if tag in INLINE and tag != "a":
                floor = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag or stack[k][0] not in INLINE), 0)
                if stack[floor][0] == tag:
                    del stack[floor]  # what was opened inside stays open
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag not in INLINE:
                    flush()
        elif m[2] is not None:
            tag = m[2].lower()
            if tag in RAW or tag in UNSEEN:
                if not m[0].endswith("/>"):
                    end = re.compile(f"</{re.escape(tag)}\\s*>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else (size if tag in RAW else at)
                if tag in ("textarea", "select"):
                    nodes[stack[-1][1]].inputs += 1
                continue
            own = nodes[stack[-1][1]]
            if tag in VOID or m[0].endswith("/>"):
                if tag == "br":
                    pieces.append(" ")
                elif tag == "input":
                    own.inputs += 1
                elif tag == "hr":
                    flush()
                own.tags += 1
                continue
            if tag in INLINE:
                own.tags += 1
                own.inputs += tag == "button"
                if tag == "a":
                    if anchors:
                        k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "a")
                        del stack[k]
                    else:
                        anchors += 1
                stack.append((tag, stack[-1][1]))
                continue
            if tag in ("html", "body"):
                flush()
                nodes[0].tokens |= attribute_tokens(m[3])
                continue
            flush()
            k = len(stack) - 1
            stop = SAME_CLOSES.get(tag)
            while k > 0:
                t = stack[k][0]
                if t == "p" or (stop and t == tag):
                    close(k)
                    break
                if t not in INLINE and (not stop or t in stop):
                    break
                k -= 1
            while stack[-1][0] in INLINE and len(stack) > 1:  # formatting does not reach over blocks here
                anchors -= stack.pop()[0] == "a"
            parent = stack[-1][1]
            attributes = m[3]
            node = Node(tag, parent, nodes[parent].depth + 1, attribute_tokens(attributes), nth=len(nodes[parent].children), at=seen)
            if "data-kept" in attributes:
                node.marked = 2
            elif tag in ("article", "main") or "articleBody" in attributes:
                node.marked = 1
            nodes[parent].children.append(len(nodes))
            stack.append((tag, len(nodes)))
            nodes.append(node)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        x, p = nodes[i], nodes[nodes[i].parent]
        p.chars += x.chars
        p.link_chars += x.link_chars
        p.tags += x.tags + 1
        p.inputs += x.inputs
        p.stops += x.stops
        p.n_blocks += x.n_blocks
    return nodes, blocks


N_TOKENS = len(TOKENS)


def features(nodes: list[Node]) -> list[list[float]]:
    """One row for each node: subtree density, attribute tokens (its own and its ancestors'), depth and sibling statistics."""
    total = max(1, nodes[0].chars)
    above = [0] * len(nodes)
    tag_above = [0] * len(nodes)
    tags_of = [Counter(nodes[b].tag for b in x.children) for x in nodes]
    out = []
    for i, x in enumerate(nodes):
        if i:
            p = nodes[x.parent]
            above[i] = above[x.parent] | p.tokens
            tag_above[i] = tag_above[x.parent] | (1 << TAG_OF[p.tag] if p.tag in TAG_OF else 0)
            brothers = p.children
            k = x.nth
            same = tags_of[x.parent][x.tag]
            before = nodes[brothers[k - 1]].chars if k else 0
            after = nodes[brothers[k + 1]].chars if k + 1 < len(brothers) else 0
            share = x.chars / max(1, p.chars)
            place, n_brothers = k / len(brothers), len(brothers)
        else:
            same = n_brothers = 1
            before = after = 0
            share, place = 1.0, 0.0
        row = [
            float(TAG_OF.get(x.tag, -1)),
            float(x.depth),
            float(x.chars),
            x.chars / total,
            x.link_chars / max(1, x.chars),
            x.tags / max(1, x.chars),
            x.stops / max(1, x.chars),
            x.chars / max(1, x.n_blocks),
            float(x.inputs),
            float(len(x.children)),
            x.at / total,
            (x.at + x.chars) / total,
            place,
            float(n_brothers),
            same / n_brothers,
            share,
            float(before),
            float(after),
        ]
        t, a, g = x.tokens, above[i], tag_above[i]
        row += [float(t >> k & 1) for k in range(N_TOKENS)]
        row += [float(a >> k & 1) for k in range(N_TOKENS)]
        row += [float(g >> TAG_OF[w] & 1) for w in ("article", "main", "nav", "header", "footer", "aside", "form")]
        row += [float(x.tag == w) for w in ("article", "main", "p", "li", "nav", "header", "footer", "aside", "form", "h1")]
        out.append(row)
    return out


N_FEATURES = 18 + 2 * N_TOKENS + 7 + 10


def decode(nodes: list[Node], gain: list[float]) -> list[bool]:
    """Which nodes are content, so that none is under one that is not.

    ``gain`` is the log-odds of content. The best such choice is the sum of
    gains over a subtree that hangs together at the root; it is found bottom-up.
    """
    best = list(gain)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = [False] * len(nodes)
    for i in range(len(nodes)):
        keep[i] = best[i] > 0 and (i == 0 or keep[nodes[i].parent])
    return keep

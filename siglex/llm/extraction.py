"""Operator 3: main text of pages by boosted trees over DOM nodes.

The trees are trained here, on a bounded sample of the given pages. Their marked
article (article, main or articleBody) gives labels; so that the model does not
hang on one template, each sampled page is also laid out anew several times,
its article in other containers and its other parts, with forms, notices,
sidebars, adverts and reader comments, in other places. Every page is then
parsed whole and decoded top to bottom: no content stands under a node that is
none.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.llm import boosting, dom
from siglex.llm.arrow_text import map_arrow

SAMPLE_PAGES, LAYOUTS = 200, 4
SHORT = 0.25  # share of the layouts whose article is cut to a few words
#: Markup that hides tags, and a start tag that the parser marks (comments and scripts aside).
HIDDEN = (
    r"(?is)<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|"
    rf"<({'|'.join(sorted(dom.RAW))})(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1\s*>|$)|<({'|'.join(sorted(dom.UNSEEN - dom.RAW))})(?=[\s/>])[^>]*(?<!/)>.*?</\2\s*>"
)
MARK = r"<(?i:article|main)[\s/>]|<[a-zA-Z][^<>]*articleBody"

#: What the layouts are made of. MAIN stands for the article's blocks.
CONTAINERS = (
    "<article>MAIN</article>", "<main>MAIN</main>", '<div class="content">MAIN</div>', '<div id="main-content">MAIN</div>', '<div class="post-body">MAIN</div>',
    '<section class="entry-content">MAIN</section>', '<div class="story">MAIN</div>', "<section>MAIN</section>", "<div>MAIN</div>", '<main><article class="post">MAIN</article></main>',
    '<div class="wrapper"><div class="article-text">MAIN</div></div>', '<div role="main">MAIN</div>', "<table><tr><td>MAIN</td></tr></table>",
)
BEFORE = (
    '<header><a href="/">W2</a> W3</header>', '<header><h1>W3</h1><nav><ul>LINKS</ul></nav></header>', '<div class="header"><div class="logo">W2</div></div>', "<nav><ul>LINKS</ul></nav>",
    '<div id="menu"><ul>LINKS</ul></div>', '<div class="breadcrumb"><a href="/">W1</a> <a href="/a">W1</a> W1</div>', '<div class="cookie-notice"><p>S1</p><button>W1</button></div>',
    '<div class="notice">S1</div>', '<div class="ad">S1</div>', '<div class="banner-ad"><a href="/x">S1</a></div>', '<form action="/s"><label>W2</label><input name="q"><button>W1</button></form>',
    '<div role="banner">W3</div>', '<div class="topbar"><ul>LINKS</ul></div>', '<div role="alert"><p>S1</p></div>', "<ul>LINKS</ul>", "",
)
AFTER = (
    "<footer>&copy; W2 S1</footer>", '<div id="footer"><p>S1</p><ul>LINKS</ul></div>', "<aside><h3>W2</h3><p>S1</p><ul>LINKS</ul></aside>", '<div class="sidebar"><h4>W2</h4><p>S2</p></div>',
    '<div class="related"><h3>W2</h3><ul>LINKS</ul></div>', '<section class="comments"><h3>W1</h3>COMMENTS</section>', '<div id="comments">COMMENTS</div>', '<ol class="commentlist">COMMENTLIST</ol>',
    '<div class="newsletter"><p>S1</p><form><input><button>W1</button></form></div>', '<div class="share"><a href="/t">W1</a> <a href="/f">W1</a></div>', '<div class="sponsored"><p>S2</p></div>',
    '<form class="reply"><p>S1</p><label>W1</label><textarea></textarea></form>', '<div class="widget"><p>S1</p></div>', "<nav><ul>LINKS</ul></nav>", '<div class="disclaimer"><p>S2</p></div>', "",
)
KEPT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
WITHIN = ('<div class="ad">S1</div>', '<aside class="promo"><p>S1</p></aside>', '<div class="newsletter-signup"><p>S1</p><form><input></form></div>', '<div class="share"><a href="/">W1</a></div>', '<div class="advert"><p>S1</p></div>', '<aside><p>S1</p></aside>')


def layouts(page: str, seed: int, n: int) -> Iterator[str]:
    """The page, and ``n`` new ones from its article and its other texts, with the article marked by data-kept."""
    nodes, blocks = dom.parse(page)
    top = next((i for i, x in enumerate(nodes) if x.marked == 1), None)
    if top is None:
        return
    inside = [False] * len(nodes)
    for i, x in enumerate(nodes):
        inside[i] = i == top or (i > 0 and inside[x.parent])
    article = [(nodes[i].tag, blocks[b]) for i in range(len(nodes)) if inside[i] for b in nodes[i].blocks]
    rest = [blocks[b] for i in range(len(nodes)) if not inside[i] for b in nodes[i].blocks]
    sentences = [s + "." for _, t in article for s in t.split(". ") if s] + rest
    r = random.Random(seed)
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    words = [w for s in rest for w in s.split()] or ["x"]
    few = lambda k: escape(" ".join(r.choice(words) for _ in range(k)))

    def filled(part: str) -> str:
        while True:
            for name, made in (
                ("COMMENTLIST", lambda: "".join(f'<li class="comment"><p>{few(2)}</p><p>S{r.randint(1, 3)}</p></li>' for _ in range(r.randint(1, 5)))),
                ("COMMENTS", lambda: "".join(f'<div class="{r.choice(("comment", "reply", "c"))}"><b>{few(1)}</b><p>S{r.randint(1, 3)}</p></div>' for _ in range(r.randint(1, 5)))),
                ("LINKS", lambda: "".join(f'<li><a href="/{k}">{few(r.randint(1, 3))}</a></li>' for k in range(r.randint(2, 8)))),
                ("S3", lambda: escape(" ".join(r.choice(sentences) for _ in range(3)))),
                ("S2", lambda: escape(" ".join(r.choice(sentences) for _ in range(2)))),
                ("S1", lambda: escape(r.choice(sentences))),
                ("W3", lambda: few(3)),
                ("W2", lambda: few(2)),
                ("W1", lambda: few(1)),
            ):
                if name in part:
                    part = part.replace(name, made(), 1)
                    break
            else:
                return part

    for _ in range(n):
        own = []
        shown = article
        if r.random() < SHORT:  # articles of a few words are articles too
            shown = [(tag, " ".join(text.split()[: r.randint(1, 4)])) for tag, text in article[: r.randint(1, 3)]]
        for tag, text in shown:
            kind = tag if tag in KEPT_TAGS else "p"
            own.append(f"<{kind} data-kept>{escape(text)}</{kind}>")
            if r.random() < 0.08:
                own.append(filled(r.choice(WITHIN)))
        before = "".join(filled(r.choice(BEFORE)) for _ in range(r.randint(0, 4)))
        after = "".join(filled(r.choice(AFTER)) for _ in range(r.randint(0, 4)))
        body = before + r.choice(CONTAINERS).replace("MAIN", "".join(own)) + after
        for _ in range(r.randint(0, 2)):
            body = f'<div class="{r.choice(("wrap", "container", "page", "row", "layout"))}">{body}</div>'
        yield f"<html><body>{body}</body></html>"


def labelled(page: str, mark: int) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a page's nodes; content is what is marked, stands in it or holds it."""
    nodes, _ = dom.parse(page)
    kept = [x.marked == mark for x in nodes]
    for i in range(1, len(nodes)):
        kept[i] |= kept[nodes[i].parent]
    for i in range(len(nodes) - 1, 0, -1):
        kept[nodes[i].parent] |= kept[i]
    return dom.features(nodes), [int(k) for k in kept]


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, per_page: int = LAYOUTS) -> boosting.Trees | None:
    """Trees from at most ``sample`` pages with a mark, taken by a hash of id, address and page; None if none has a marked article.

    The hashes are chosen first, so that only the chosen pages travel; repeated rows are one page.
    """
    marked = F.col("html").rlike(MARK) & F.regexp_replace("html", HIDDEN, "").rlike(MARK)
    hashed = pages.select("html", F.xxhash64("page_id", "url", "html").alias("h"))
    least = [r.h for r in hashed.where(marked).select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.first("html").alias("html")) if least else None
    rows = sorted(chosen.collect(), key=lambda r: r.h) if least else []
    x: list[list[float]] = []
    y: list[int] = []
    for row in rows:
        made = list(layouts(row.html, row.h, per_page))
        for page, mark in [(row.html, 1)] * bool(made) + [(p, 2) for p in made]:
            f, labels = labelled(page, mark)
            x += f
            y += labels
    if not x:
        return None
    return boosting.fit(np.array(x), np.array(y, float), np.ones(len(y)))


def main_text(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    Null and empty pages give an empty text. Without ``trees`` they are trained
    on a sample of the pages with a marked article; if no page has one there are
    no labels, and all shown text counts as content. Repeated rows give repeated
    rows; an empty table gives an empty result. Other columns are not read.
    """
    trees = trees or train(pages)
    sent = pages.sparkSession.sparkContext.broadcast(trees)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                parsed = [dom.parse(h) for h in pc.fill_null(batch.column(2), "").to_pylist()]
                rows = [f for nodes, _ in parsed for f in dom.features(nodes)]
                gain = model.margin(np.array(rows)).tolist() if model is not None else [1.0] * len(rows)
                texts, k = [], 0
                for nodes, blocks in parsed:
                    keep = dom.decode(nodes, gain[k : k + len(nodes)])
                    k += len(nodes)
                    own = sorted(b for x, kept in zip(nodes, keep, strict=True) if kept for b in x.blocks)
                    texts.append("\n".join(blocks[b] for b in own))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "url", "html"), extracted, f"page_id {kind}, url string, text string, n_chars long")

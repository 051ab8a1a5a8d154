import random
import re

import pytest
from pyspark.sql import functions as F

from siglex.llm import boosting, dom, extraction


def page(k, container=("<article>", "</article>"), sidebar=""):
    r = random.Random(k)
    sentence = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(n)) + "."
    paragraphs = [f"para{k}x{i} &amp; {sentence(r.randint(8, 40))}" for i in range(r.randint(2, 5))]
    body = "<h1>Title %d</h1>" % k + "".join(f"<p>{p}\n  more</p>" for p in paragraphs)
    html = f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy {sentence(4)}</div>{container[0]}{body}{container[1]}{sidebar}<footer>(c) {sentence(3)}</footer></body></html>"
    text = "\n".join([f"Title {k}"] + [p.replace("&amp;", "&") + " more" for p in paragraphs])
    return html, text


@pytest.fixture(scope="module")
def trained(spark):
    pages = spark.createDataFrame([(k, f"u{k}", page(k)[0]) for k in range(60)], "page_id long, url string, html string")
    return pages, extraction.train(pages, 60, 3)


def test_articles_of_known_and_new_templates(spark, trained):
    pages, trees = trained
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(pages, trees).collect()}
    assert sum(got[k] == (page(k)[1], len(page(k)[1])) for k in range(60)) >= 59
    sidebar = "<div class='sidebar'><h3>Other</h3><p>lorem ipsum other things.</p></div><section class='comments'><div class='comment'><p>I like ipsum a lot.</p></div></section>"
    new = [page(100 + k, ('<div class="content">', "</div>"), sidebar) for k in range(20)]
    docs = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(new)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extraction.main_text(docs, trees).collect()}
    assert sum(got[k] == t for k, (_, t) in enumerate(new)) >= 18


def test_null_empty_broken_and_empty_table(spark, trained):
    _, trees = trained
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>open <b>never closed"), (4, "u", "< < > &#x41; &bogus; <!-- x"), (None, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))
    got = {r.page_id: r.text for r in extraction.main_text(pages, trees).collect()}
    assert got[1] == got[2] == "" and len(got) == 5
    assert extraction.main_text(pages.where(F.lit(False))).count() == 0


def test_decoding_never_contradicts_ancestors():
    r = random.Random(3)
    for _ in range(200):
        nodes, _ = dom.parse("".join(r.choice(("<div>", "<p>", "</p>", "</div>", "<ul><li>", "</ul>", "t")) for _ in range(30)))
        keep = dom.decode(nodes, [r.uniform(-1, 1) for _ in nodes])
        assert all(keep[x.parent] for x, k in zip(nodes[1:], keep[1:], strict=True) if k)


def test_trees_learn_an_interaction():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((2000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit(x, y, np.ones(2000))
    z = r.random((500, 5))
    assert ((model.margin(z) > 0) == ((z[:, 1] > 0.5) ^ (z[:, 3] > 0.3))).mean() > 0.95
    assert re.match("float", str(model.leaf.dtype))


def test_training_pages_are_marked_ones(spark):
    plain = [(k, f"u{k}", page(k, ("<div>", "</div>"))[0].replace("<body>", "<body><!-- <article> --><script>'<main>'</script>")) for k in range(60)]
    pages = spark.createDataFrame([*plain, (60, "u60", page(60)[0])], "page_id long, url string, html string")
    assert all(extraction.train(pages.where(f"page_id <> {k}"), 1, 1) is not None for k in range(0, 60, 12))
    assert extraction.train(pages.where("page_id < 60"), 1, 1) is None


def test_all_siblings_of_a_tag_count():
    nodes, _ = dom.parse("<div>" + "<ul></ul>" * 70 + "<p>a</p>" * 184 + "</div>")
    shares = {(x.tag, f[14]) for x, f in zip(nodes, dom.features(nodes), strict=True) if x.tag in ("p", "ul")}
    assert shares == {("ul", 70 / 254), ("p", 184 / 254)}


def test_training_pages_are_chosen_by_hash_and_repeated_rows_count_once(spark):
    page = lambda k: f"<html><body><nav>menu {k}</nav><article><p>{' '.join(f'word{k}x{i}' for i in range(60))}</p></article><footer>end</footer></body></html>"
    rows = [(k, f"u{k}", page(k)) for k in range(12)] + [(0, "u0", page(0))] * 40 + [(99, "u", None), (98, "v", "")]
    kinds = "page_id long, url string, html string"
    one = extraction.train(spark.createDataFrame(rows, kinds).repartition(5), sample=6)
    other = extraction.train(spark.createDataFrame(rows[:12], kinds), sample=6)
    assert one is not None
    probe = spark.createDataFrame([(1, "x", page(77)), (1, "x", page(77))], kinds)
    texts = [[r.text for r in extraction.main_text(probe, t).collect()] for t in (one, other)]
    assert texts[0] == texts[1] and len(texts[0]) == 2 and texts[0][0] == texts[0][1]
    assert extraction.train(spark.createDataFrame(rows[-2:], kinds)) is None

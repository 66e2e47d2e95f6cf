"""Blocks, boilerplate and templates of hand-made pages."""

import html
import re

import pytest

from conftest import SF
from kerbside.llm.pages import article_slot, extract, host_labels, host_of, main_text, page_tokens, template_members


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple\n text", "plain & simple text"),
    ("<p>one<p>two<br>three", "one\ntwo\nthree"),
    ("<html><title>T</title><body><nav>menu</nav><article><h1>A&nbsp;B</h1><p>x <b>y</b>z</p></article><footer>f</footer>", "A B\nx yz"),
    ("<article>a<script>var t='</article>';</script>b</article>c", "ab"),
    ("<body><div class='cookie-notice'>ok?</div><form>f</form><p>text</p><div id=comments>hm</div></body>", "text"),
    ("<article><p>keep</p><aside>no</aside><div class='ad'>buy</div><p>this</p></article>", "keep\nthis"),
    ("<article><p>cut <b>off", "cut off"), ("<main><ul><li>a<li>b</ul></main>", "a\nb"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
    ('<article><div style="overflow:hidden">Long body text</div><p title="a hidden gem">para</p></article>', "Long body text\npara"),
    ('<article><div data-id="related">kept</div><p hidden>gone</p><p id=related>gone</p></article>', "kept"),
    ("<article><p title=it's>first</p><p>second isn't lost</p></article>", "first\nsecond isn't lost"),
    ('<article><p>body</p></article><article class="comment odd">a reader</article>', "body"),
    ('<article class="post has-comments"><p a="x>y" b=\'">\'>body</p></article>', "body"),
    ("<!-- c --><article>&lt;tag&gt; &#233; &eacute;</article><!-- open", "<tag> é é"),
])
def test_main_text(page, text):
    assert main_text(page, None) == text


def test_hosts():
    assert [host_of(u) for u in ("https://A.b:80/x", "http://u@c.d?q", "//e.f", "nothing", None)] == ["a.b", "c.d", "e.f", "", ""]


def template(k, body):
    return (f"<html><body><div class=top>Site</div><div class=box><h2>{k}</h2><div class=story>{body}</div></div>"
            "<div class=end>Bye now</div></body></html>")


def test_slot_of_a_host(spark):
    pages = [(k, f"http://h/{k}", template(k, f"<p>Story number {k} says {k * 7} things.</p><p>More {k}.</p>" * 5)) for k in range(30)]
    docs = spark.createDataFrame([(*p, "clash") for p in pages] + [
        (100, "http://other/1", "<article>alone</article>", ""), (101, None, None, ""), (102, "http://h/x", "<p>no slot</p>", ""),
        (5, "http://h/5", pages[5][2], "")], "page_id bigint, url string, html string, text string")
    got = extract(docs).collect()
    assert len(got) == docs.count()
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "\n".join(["3", *["Story number 3 says 21 things.", "More 3."] * 5])
    assert (texts[100], texts[101], texts[102]) == ("alone", "", "no slot")
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(docs.limit(0)).count() == 0


def test_classes():
    def member(path, pages, most, chars, constant=False):
        return {"path": path, "pages": pages, "most": most, "chars": chars, "constant": constant}

    members = [member("", 30, 1, 0), member(">body", 30, 1, 10), member(">body>div.a", 30, 1, 5000), member(">body>div.a>p", 30, 9, 9000),
               member(">body>div.a>div.n", 30, 1, 300, True), member(">body>div.b", 30, 1, 100)]
    assert article_slot(members) == [">body>div.a", ">body>div.a>div.n"]
    assert article_slot([member("", 1, 1, 0), member(">body", 1, 1, 10)]) == []
    own = [m | {"path": m["path"].replace("div.a", "article")} for m in members]
    assert article_slot(own) == [">body>article"]
    assert page_tokens("<body><nav><p>x</p></nav><p>y</p></body>").keys() == {">body", ">body>p"}


def texts_of(spark, bodies):
    rows = [(k, f"http://h/{k}", f"<html><body><div class=top>Site</div>{b}</body></html>") for k, b in enumerate(bodies)]
    return [r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]


def test_whole_article(spark):
    parts = "<h1>Title {0}</h1><div class=intro>Intro {0}</div><div class=body>" + "<p>Long story number {0} goes on.</p>" * 5 + "</div>"
    want = [f"Title {k}\nIntro {k}\n" + "\n".join([f"Long story number {k} goes on."] * 5) for k in range(5)]
    for around in ("<article>{}</article>", "<div class=box>{}</div>"):
        assert texts_of(spark, [around.format(parts.format(k)) for k in range(5)]) == want


@pytest.mark.parametrize("pages", [4, 19, 20])
def test_label_above_varying_text(spark, pages):
    got = texts_of(spark, [f"<div class=story>Story: <p>varying text {k}</p></div><div class=note>Same</div>" for k in range(pages)])
    assert got == [f"Story:\nvarying text {k}" for k in range(pages)]


@pytest.mark.parametrize("pages", [2, 3, 12])
def test_any_depth_and_number_of_pages(spark, pages):
    """Deep templates without an article mark; what all articles begin with stays in them."""
    deep, ends = "<div>" * 60, "</div>" * 60
    got = texts_of(spark, [f"{deep}<div class=links>Same links</div><div class=s><p>Varying story {k}</p></div>{ends}" for k in range(pages)])
    assert got == [f"Varying story {k}" for k in range(pages)]
    got = texts_of(spark, [f"<article><h1>T{k}</h1><div class=sig>Shared intro</div><p>Story {k}</p></article>" for k in range(pages)])
    assert got == [f"T{k}\nShared intro\nStory {k}" for k in range(pages)]


def test_very_deep_page():
    assert main_text("<div>" * 30_000 + "<b>" * 30_000 + "deep" + "</i>" * 30_000, None) == "deep"
    assert main_text("<article>" + "<div>" * 2_000 + "<nav>no</nav>deep" + "</div>" * 2_000 + "<p>end", None) == "deep\nend"
    assert len(page_tokens("<div>" * 3_000)) == 512


def test_class_per_page(spark):
    names = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    bodies = [f"<div class='post-{k}'><div class={n}><p>Text {k} of {n}</p></div></div><div class=end>Bye now</div>" for k, n in enumerate(names)]
    assert texts_of(spark, bodies) == [f"Text {k} of {n}" for k, n in enumerate(names)]
    placed = spark.createDataFrame([(1, b) for b in bodies], "host bigint, html string")
    assert [tuple(r) for r in host_labels(placed).collect()] == [(1, 6, ["div.end"])]


def test_classes_are_valid_as_a_whole(spark):
    def member(path, vector, pages=10, most=1):
        return {"path": path, "pages": pages, "vector": vector, "most": most, "chars": 9, "constant": False}

    page = [member("", 1), member(">body", 1), member(">body>div.a", 1), member(">body>div.a>p", 7, most=3)]
    both, far, single = [member(">body>div.b", 2, 8), member(">body>div.b>td", 2, 8)], \
        [member(">body>div.a>td", 3, 7), member(">body>td", 3, 7)], [member(">body>div.c", 4, 7)]
    assert template_members(page + both + far + single, set()) == page + both
    assert template_members(page + both, {2}) == page
    pages = [("<div class=x>Same<p>s</p></div><div class=y>Like<p>l</p></div>", "Text"), ("<div class=y>Like<p>l</p></div><div class=x>Same<p>s</p></div>", "Text")]
    got = texts_of(spark, [f"{pages[k % 2][0]}<p>Text {k}</p>" if k < 6 else f"<p>Text {k}</p>" for k in range(8)])
    assert got == [("Same\ns\nLike\nl\n", "Like\nl\nSame\ns\n")[k % 2] * (k < 6) + f"Text {k}" for k in range(8)]


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", whole[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(filter(None, blocks))

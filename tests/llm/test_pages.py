import glob
import html
import json
import re

from tidemark.llm import extraction as E
from tidemark.llm import warc as W
from tidemark.llm.html_tokens import Tag, tokens

PAGES = "page_id long, url string, html string"

TEMPLATE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site</h1><nav><a href="/a">Home</a> <a href=/b>About</a></nav></header><div class="cookie-notice">We use cookies</div>
<div class="sidebar"><ul><li><a href="x">Link one</a></li></ul></div>%s<h2>The story</h2>
<p>First para with <b>bold</b> &amp; <a href="q">a   link</a> in&nbsp;it.</p><div class="ad">Buy now!</div>
<p>Second para,<br>longer text follows here.<ul><li>Item one of list</li><li>Item two</li></ul>
<form><label>Email</label><input name=e></form><p>Last.</p>%s
<section class="comments"><h3>Comments</h3><p>Great post, I love it.</p></section><footer><p>Copyright</p></footer></body></html>"""
STORY = ("The story\nFirst para with bold & a link in it.\nSecond para, longer text follows here.\nItem one of list\nItem two\nLast.")


def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def marked_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]*>", " " if "<br" in b else "", b) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages_give_their_articles(spark):
    rows = {r["page_id"]: r for r in E.extraction_digest(pages(spark)).collect()}
    for p in pages(spark).collect():
        r = rows[p["page_id"]]
        assert r["text"] == marked_text(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_unmarked_pages(spark):
    learned = E.fit_weights(pages(spark))
    bare = re.compile("</?article>")
    same = 0
    sample = pages(spark).limit(60).collect()
    for p in sample:
        same += E.extract(bare.sub("", p["html"]), learned) == marked_text(p["html"])
    assert same >= 0.95 * len(sample)
    for weights in (learned, {}):
        for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("", "")):
            assert E.extract(TEMPLATE % (a, b), weights) == STORY


def test_class_names_that_only_mention_a_hint():
    story = "<p>" + "Long story text here. " * 20 + "</p>"
    for name in ("content no-sidebar", "post has-sidebar", "entry comments-open", "layout-sidebar-right", "story social-science",
                 "side-by-side", "sidebar"):
        for tag in ("div", "article", "section"):
            page = f'<html><body><{tag} class="{name}">{story}</{tag}><div class="sidebar"><p>Other things</p></div></body></html>'
            assert E.extract(page, {}) == ("Long story text here. " * 20).strip(), (name, tag)
    two = '<body><div class="entry comments-open"><p>First entry text here.</p></div><div class="entry has-sidebar"><p>Second one.</p></div></body>'
    assert E.extract(two, {}) == "First entry text here.\nSecond one."
    # what was learned of such elements counts
    assert "Second" not in E.extract(two, {"w:p/hint": -3.0})
    assert "First" in E.extract('<div class="sidebar">x y</div><div class="sidebar">' + "First " * 9 + "</div>", {})


def test_a_marked_card_does_not_replace_the_text(spark):
    learned = E.fit_weights(pages(spark))
    story = " ".join(f"<p>Paragraph {k} of the long main text with some more words in it.</p>" for k in range(12))
    text = re.sub(r"<[^>]*>", "", story.replace("</p> <p>", "\n"))
    card = "<article><h3>Teaser</h3><p>A short card text.</p></article>"
    for weights in (learned, {}):
        assert text in E.extract(f"<body><div>{story}</div><footer>x</footer>{card}</body>", weights)
        assert text in E.extract(f"<body>{card}<div>{story}</div></body>", weights)
        assert E.extract(f"<body><p>Before it.</p><article>{story}</article><p>After it.</p></body>", weights) == text


def test_best_run_equals_all_runs():
    import random
    rng = random.Random(4)
    for _ in range(100):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 15))]
        a, b = E.best_run(x)
        assert sum(x[a:b]) == max([0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])


def test_tokens():
    t = list(tokens('<a href="x>y" b=\'c\'>t &lt; u</a><!-- <p> --><script>if (a<b) "</p>"</script>&amp <'))
    assert [x.name for x in t if isinstance(x, Tag)] == ["a", "a", "script", "script"]
    assert [x for x in t if isinstance(x, str)] == ["t < u", 'if (a<b) "</p>"', "& <"]
    assert t[0].attributes == {"href": "x>y", "b": "c"}


def odd_pages(spark):
    return spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u\nv", "no markup at all", "x"),
                                  (3, "u", "<p>" * 3000 + "deep", "x"), (4, "u", "<div class=ad>never closed<p>text</p>", "x"),
                                  (5, "u", "<script>open", "x"), (6, "u", "w " * 200_000, "x")], PAGES + ", text string")


def test_odd_pages(spark):
    rows = [tuple(r) for r in E.extraction_digest(odd_pages(spark)).collect()]
    assert len(rows) == 8 and (1, None, "", 0) in rows and (None, "u\nv", "no markup at all", 16) in rows
    assert (3, "u", "deep", 4) in rows and (4, "u", "text", 4) in rows and (5, "u", "", 0) in rows
    assert E.extraction_digest(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_round_trip(tmp_path, spark):
    source = pages(spark).unionByName(odd_pages(spark).select("page_id", "url", "html"))
    records = W.derivatives(source, with_response=True)
    W.write_warc(records, str(tmp_path / "warc"))
    back = [x for f in sorted(glob.glob(str(tmp_path / "warc/part-*"))) for x in W.read_records(open(f, "rb").read())]
    assert len(back) == 3 * source.count()
    responses = {dict(h)["WARC-Record-ID"]: (dict(h), b) for h, b in back if dict(h)["WARC-Type"] == "response"}
    for headers, block in back:
        h = dict(headers)
        assert W.digest(block) == h["WARC-Block-Digest"] and int(h["Content-Length"]) == len(block)
        if h["WARC-Type"] == "response":
            assert W.digest(block.split(b"\r\n\r\n", 1)[1]) == h["WARC-Payload-Digest"]
            continue
        origin, _ = responses[h["WARC-Refers-To"]]
        assert (h["WARC-Target-URI"], h["WARC-Date"]) == (origin["WARC-Target-URI"], origin["WARC-Date"])
        assert h["WARC-Source-Block-Digest"] == origin["WARC-Block-Digest"]
        if h["WARC-Type"] == "metadata":
            assert json.loads(block)["Envelope"]["WARC-Header-Metadata"] == origin


def test_heads_without_end():
    links = [{"path": "LINK@/href", "url": "/c"}, {"path": "A@/href", "url": "/q"}]
    for end, body in (("", ""), ("</head>", "<body>"), ("", "<body>"), ("</head>", "")):
        text, about = W.describe(f'<html><head><title>T</title><style>p{{}}</style><link rel=canonical href="/c">\n{end}{body}<p>x y</p><a href="/q">l</a>')
        assert text == "T\nx y\nl" and about == {"title": "T", "lang": "", "links": links}, (end, body)
    assert W.describe("<head><meta charset=x>plain text<p>z")[0] == "plain text\nz"
    assert W.describe("<p>a</p><noscript>b<p>c</p>")[0] == "a\nb\nc" and W.describe("<p>a<template>b<p>c")[0] == "ab\nc"
    assert W.describe("<head><noscript><p>b</p></noscript><p>a</p><template>h</template>")[0] == "a"


def test_conversion_text(spark):
    text, about = W.describe('<html lang=en><head><title>A &amp; b</title></head><body><p>x <b>y</b><br>z</p><a href="/q">l</a><script>no</script>')
    assert text == "A & b\nx y z\nl" and about == {"title": "A & b", "lang": "en", "links": [{"path": "A@/href", "url": "/q"}]}
    out = W.derivatives_digest(pages(spark))
    assert out.count() == 2 * pages(spark).count()
    assert out.select("record_id").distinct().count() == out.count()
    assert W.derivatives_digest(spark.createDataFrame([], PAGES)).count() == 0


def test_compound_names_of_boxes_are_no_article_text():
    story = "<p>The harbour was quiet that morning.</p><p>Later the ships came in, one by one.</p><p>Nobody had told the crews of it.</p>"
    want = "The harbour was quiet that morning.\nLater the ships came in, one by one.\nNobody had told the crews of it."
    for box in ('<section class="comment-list"><p>Great read, thanks a lot</p></section>', '<div id="comments-area"><p>First reader says hello</p></div>',
                '<div class="sidebar-widget"><p>Most read this week here</p></div>', '<div class="adSlot top"><p>Buy two and save now</p></div>',
                '<ul class="site-nav-menu"><li>Home and more</li></ul>', '<div class="post-share-buttons"><p>Tell a friend today</p></div>'):
        assert E.extract(f'<html><body><div class="post">{story}</div>{box}</body></html>', {}) == want, box
    inner = story.replace("</p><p>Later", '</p><div class="ad-slot"><p>Buy two and save now</p></div><p>Later')
    assert E.extract(f'<html><body><article>{inner}</article></body></html>', {}) == want
    for name in ("no-sidebar", "has-sidebar", "comments-open", "share-price", "ad-hoc", "without-ads", "ad-free", "search-results-page-one", "side-effects"):
        kept = story.replace("<p>Later", f'<p class="{name}">Later')
        assert E.extract(f'<html><body><div class="{name} x">{kept}</div></body></html>', {}) == want, name

import html
import json
import re
import time

from donorlens.llm.html_extract import MOST_ITEMS, extract, main_path, main_text, merge, parse, wrapper_of

from .common import SF_DIR, collected, table


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, path string, n_pages int")


def test_articles_of_given_pages(spark):
    """The given pages have one article each, cut into h1 and p."""
    got = {r["page_id"]: r for r in extract(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()}
    for page_id, url, page in table("pages"):
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        parts = [re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p) for p in re.split("</?p>|</?h1>", inside)]
        want = "\n\n".join(p for p in (" ".join(html.unescape(p).split()) for p in parts) if p)
        r = got[page_id]
        assert (r["url"], r["text"], r["n_chars"]) == (url, want, len(want))


PAGE = """<html><head><title>T</title></head><body><header>Site</header><div class="cookie-notice">Accept</div>
<div id=sidebar><p>Side</p></div><main><nav>Crumbs</nav><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
&lt;three&gt;<br>four<p>Five<!-- no --><script>var a = "</p>";</script><ul><li>six<li>seven</ul><form>Send</form>
<div class="ad-box">Buy</div></article><section class="comments"><p>First!</p></section></main><footer>&copy;</footer></body></html>"""


def test_parts_that_are_no_text():
    assert main_text(PAGE, None) == "Head & line\n\nOne two <three> four\n\nFive\n\nsix\n\nseven"


def test_open_heads_buttons_and_marked_blocks():
    page = '<head><title>T</title><p>Text<button>Share</button> on<ul class="menu"><li>Home</ul><p class="notice">Old<p>End'
    assert main_text(page, None) == "Text on\n\nEnd"


def test_words_of_state_and_containers_of_the_text_hide_nothing():
    text = "<p>One two three</p>"
    for page in (
        f'<body class="no-sidebar"><article>{text}</article></body>',
        f'<body class="sidebar search">{text}</body>',
        f'<body><article class="post comments-open">{text}</article></body>',
        f'<body><article class="post category-social">{text}</article></body>',
        f'<body><article class="related">{text}</article></body>',
        f'<body><div id=content class="with-sidebar">{text}</div></body>',
        f'<body><div class="banner"><main role="search">{text}</main></div></body>',
        f'<body><div class="page sidebar"><div><article>{text}</article></div></div></body>',
        f'<body><div class="page sidebar"><div>{text}</div></div></body>',
        f'<body><article>{text}<div class="related"><article class=card>Other</article></div></article></body>',
        f'<body><article>{text}</article><div class="comments"><article class=comment>First!</article></div></body>',
    ):
        assert main_text(page, None) == "One two three", page
    page = f'<body><div class="page sidebar"><p class="ad">Buy</p>{text}</div><footer>End</footer></body>'
    assert "One two three" in main_text(page, None) and "End" not in main_text(page, None)


def test_deep_elements_close_themselves():
    for n in (10, 98, 99, 100, 101, 150, 5_000):
        many, end = "<div>" * n, "</div>" * n
        assert main_text(f"<body><div><article>{many}<p>a</p>b{end}<p>tail</p></article></div><div>No</div>", None) == "a\n\nb\n\ntail"
        for tag, mark in (("nav", ""), ("form", ""), ("div", " class=ad")):
            page = f"<body><article><p>a</p>{many}<{tag}{mark}><div>No<p>no</div>no</{tag}>b{end}<p>tail</p></article>"
            assert main_text(page, None) == "a\n\nb\n\ntail", (n, tag)


def test_deep_pages_take_linear_time():
    n = 100_000
    assert main_text("<div>" * n + "</section>" * n + "deep", None) == "deep"
    assert main_text("<article><ul>" + "<li><blockquote>" * n + "a<div>" + "</li>" * n + "b", None) == "a\n\nb"


def test_wrappers_align():
    one = wrapper_of(parse("<body><div class=top><p>a</p></div><div class=main><p>long text here</p><p>and more</p></div></body>"))
    two = wrapper_of(parse("<body><div class=main><p>another long text</p></div><div class=end><p>b</p></div></body>"))
    merged = merge(one, two)
    body = merged[4][0]
    assert [(i[0], i[2], i[3]) for i in body[4]] == [("div.top", True, False), ("div.main", False, False), ("div.end", True, False)]
    assert [(i[0], i[3]) for i in body[4][1][4]] == [("block", True)]
    assert main_path(merged) == ["body", "div.main"]
    assert merge(two, one)[1] == merged[1]


def test_host_wrapper_decides(spark):
    """The last page has more text in another box; the host's other pages say where its text is."""
    page = "<body><div class=a><p>{}</p></div><div class=b><p>{}</p></div></body>"
    rows = [(i, "http://h.org/", page.format("x " * 50, "y")) for i in range(20)] + [(99, "http://h.org/", page.format("main", "z " * 90))]
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got[99] == "main" and got[0] == " ".join("x" * 50)


def test_nothing_beside_the_largest_box_is_lost(spark):
    """No article or main element: the headline and the lead stand beside the body, a fifth of the text or less."""
    box = "<div id=content><h1>{0} head</h1><p>{0} lead</p><div class=body><p>{1}</p><p>{0} end</p></div></div>"
    split = "<div id=content><div class=head><h1>{0} head</h1></div><div class=lead><p>{0} lead</p></div><div class=body><p>{1}</p><p>{0} end</p></div></div>"
    links = "<div class=top><ul><li><a href=/>Home</a><li><a href=/a>All about {0}</a><li><a href=/b>{0}</a></ul></div>"
    around = "<div class=line>Our site, the best</div>" + links + "{2}<div class=end><p>All rights reserved</p></div>"
    names = [f"w{i}" for i in range(12)]
    rows, want = [], {}
    for h, inner in enumerate((box, split)):
        for i, name in enumerate(names):
            long = f"{name} says much more. " * (20 + i)
            page = around.replace("{0}", name).replace("{2}", inner.replace("{0}", name).replace("{1}", long))
            rows.append((100 * h + i, f"http://h{h}.org/{i}", f"<body>{page}</body>"))
            want[100 * h + i] = f"{name} head\n\n{name} lead\n\n{long.strip()}\n\n{name} end"
    assert {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()} == want
    # Of one page or of copies of it nothing is known to be constant, so all is kept.
    for n in (1, 5):
        same = [(i, "http://h.org/", rows[0][2]) for i in range(n)]
        assert all(want[0] in r["text"] for r in extract(pages(spark, same)).collect())
    assert main_text("<body><div><h1>Head</h1><div><p>Lead</p><div>" + "<p>more</p>" * 50 + "</div></div></div>", None).startswith("Head\n\nLead")
    assert main_text("<body><div class=a><p>One two</div><div class=a><p>Three</div>", None) == "One two\n\nThree"


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://h/", "plain & text"), (None, "http://h/", "plain & text"), (3, "x", "<p")]
    rows += [(4, "http://h/", "<div>" * 5_000 + "deep"), (5, "http://h/", "<p>word " * 20_000), (6, "http://h/", '<a href="cut')]
    got = {(r["page_id"], r["n_chars"]) for r in extract(pages(spark, rows)).collect()}
    assert {(1, 0), (2, 0), (None, 12), (4, 4), (6, 0)} <= got
    assert collected(extract(pages(spark, []))) == []


STORY = "A long story about something. " * 20


def test_replies_and_related_articles_don_t_replace_the_text():
    want = STORY.strip()
    for page in (
        f'<div id=content><p>{STORY}</p></div><div class="comments"><article class="comment">Nice!</article></div>',
        f'<article><p>{STORY}</p></article><article class="related"><p>{STORY}{STORY}</p></article>',
        f'<article><p>{STORY}</p><div class="ad-active">Buy</div><p class="comments-open">Reply</p></article>',
        f'<div id=content><p>{STORY}</p></div><article class="comment"><p>{STORY}{STORY}</p></article>',
    ):
        assert main_text(f"<body>{page}</body>", None) == want, page
    assert main_text(f'<body><div class=line>By A. B.</div><article class="post sponsored"><p>{STORY}</p></article></body>', None).endswith(want)


def test_elements_that_close_themselves_or_never():
    for middle in ('<svg class="i"/>', "<button-group>", "<svg viewBox='0 0'/>", "<title-card>", "<button/>"):
        assert main_text(f"<body><article><p>a one</p>{middle}<p>b two</p></article></body>", None) == "a one\n\nb two", middle
    for open_ in ("<button>", "<select>", "<noscript>", "<title>", "<svg>"):
        text = main_text(f"<body><article><p>a one</p>{open_}<p>b two</p></article></body>", None)
        assert text == "a one\n\nb two", open_
    page = "<p>a<button type=button>Share <b>now</b></button> b<select><option>1</select> c<svg><title>t</title></svg> d"
    assert main_text(page, None) == "a b c d"
    assert main_text("<p>a" + "<button>" * 20_000 + "b", None) == "ab"


def test_slots_decide_where_names_say_nothing(spark):
    """Constant boxes and lists of links go, also inside the article, whatever they are called."""
    page = (
        "<body><div class=qa>Our site</div><article class=qb><h1>{0} head</h1><div class=qc><span>Read this on our site</span></div>"
        "<div class=qd><p>{0} text goes on here</p><p>more of {0}</p></div>"
        "<div class=qe><a href=/1>Go {0}</a> <a href=/2>Then {0} again</a></div></article><div class=qf>All rights</div></body>"
    )
    rows = [(i, "http://n.org/", page.replace("{0}", f"w{i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, rows)).collect()}
    assert got == {i: f"w{i} head\n\nw{i} text goes on here\n\nmore of w{i}" for i in range(12)}
    # Copies of one page are constant as a whole; nothing is cut.
    same = [(i, "http://n.org/", rows[0][2]) for i in range(12)]
    assert all("Read this" in r["text"] and "w0 text goes on" in r["text"] for r in extract(pages(spark, same)).collect())


def test_wrappers_stay_small():
    begin, whole = time.perf_counter(), None
    for page in range(120):
        boxes = "".join(f"<div class=c{page}x{chr(97 + k)}><p>text {page} {k}</p></div>" for k in range(20))
        own = wrapper_of(parse(f"<body><div class=same><p>long text {page} of all</p></div>{boxes}</body>"))
        whole = merge(whole, own) if whole else own
    assert len(json.dumps(whole)) < 100_000 and time.perf_counter() - begin < 10
    assert len(whole[4][0][4]) <= MOST_ITEMS and any(i[0] == "div.same" and i[5][0] == 120 for i in whole[4][0][4])
    wide = ["<body>" + "".join(f"<div class={a}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000]}>t</div>" for k in range(2000)) for a in "ab"]
    begin = time.perf_counter()
    merge(*(wrapper_of(parse(p)) for p in wide))
    assert time.perf_counter() - begin < 1

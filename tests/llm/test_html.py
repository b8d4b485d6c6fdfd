import pytest
from dqspark.llm import htmlmain, queries


def text(html):
    page = htmlmain.read(html)
    own = htmlmain.scores(page)
    return htmlmain.extract(page, sorted(own, key=lambda p: (-own[p], p))[:1])


LONG = "Some sentence of the article that is long enough to count as one. " * 3

CASES = [
    ("<p>a  b\n c<p>d &amp; e&nbsp;f", "a b c\nd & e f"),
    ("<article><h1>T</h1><p>a<b>b</b>c<br>d</p><p></p><p> </p>tail</article>", "T\nabc d\ntail"),
    ("<script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes", "yes"),
    ("<p>1 < 2 & 3 &gt; 2 &#233; &eacute; &#x41;</p>", "1 < 2 & 3 > 2 é é A"),
    (f"<div class='site-header'>Site</div><div id=main><p>{LONG}</p><p>{LONG}</p></div><div class='cookie-notice'>ok</div>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<nav><a href=x>menu</a></nav><main><p>{LONG}</p></main><aside>side</aside><footer>f</footer>", LONG.strip()),
    (f"<article class=post-12><p>{LONG}</p><div class='comments-area'><p>{LONG}</p></div><form>name</form></article>", LONG.strip()),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{LONG}</article>", f"one\ntwo\na\nb\n{LONG.strip()}"),
    ("<p hidden>no</p><p>yes</p><p style='display: none'>no</p><div aria-hidden=\"true\">no</div>", "yes"),
    ("<div class='unclosed", ""),
    ("", ""),
    ("<p title='a > b'>x</p>", "x"),
    ("<textarea><p>no</textarea><title>no</title><noscript>no</noscript><p>ok", "ok"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_extraction(html, want):
    assert text(html) == want


def page(body):
    return f"<html><body><div class='wrap w7'><div class='col'>{body}</div><div class='box'><p>{LONG}{LONG}</p></div></div></body></html>"


def test_host_votes_win(spark):
    """On a host whose pages mostly have their text in div.col, a short article is still found there."""
    long_pages = [(i, "http://h.example/a", page(f"<p>{LONG * 6} {i}</p>")) for i in range(9)]
    rows = [*long_pages, (9, "HTTP://H.example/b?x", page("<p>short one</p>")), (10, None, None), (11, "", ""), (9, "http://h.example/c", page("<p>short one</p>"))]
    pages = spark.createDataFrame([(*r, 3, "q") for r in rows], "page_id long, url string, html string, n_chars int, host string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in htmlmain.main_texts(pages).collect()]
    assert len(out) == len(rows)
    assert [o for o in out if o[0] == 9] == [(9, "short one", 9)] * 2
    assert sorted(o for o in out if o[0] > 9) == [(10, "", 0), (11, "", 0)]


def test_empty_table_and_given_pages(spark, folder):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert queries.op4_htmlmain(spark, folder(pages=none)).count() == 0
    out = queries.op4_htmlmain(spark, "/root/testdata/sf0.001")
    assert out.count() == 50 and out.filter("text like '%&copy;%' or text like '%<p>%'").isEmpty()


def test_deep_and_long_pages():
    assert text("<div>" * 30_000 + "<p>x") == "x"
    assert len(text("<p>" + "word " * 400_000)) == 1_999_999
    htmlmain.read("<a <b " * 20_000)


LINE = "A sentence of the article with quite some words in it, and more."


@pytest.mark.parametrize("page", [
    f"<body><div class='content no-sidebar'><p>{LINE}</p></div></body>",
    f"<body><main class='no-sidebar'><p>{LINE}</p></main></body>",
    f"<body><div class='main-content sidebar-right'><p>{LINE}</p></div><div class='sidebar'><p>Other words here</p></div></body>",
    f"<body><div class='post has-comments'><p>{LINE}</p></div></body>",
    f"<body><article class='comments-open'><p>{LINE}</p></article></body>",
    f"<body><section class='market-share'><p>{LINE}</p></section><footer>foot</footer></body>",
    f"<body><article><p><svg width='1'/>{LINE}</p></article></body>",
    f"<body><article><p><svg width='1'><text>no</text></svg>{LINE}</p></article></body>",
])
def test_articles_with_unlucky_names(page):
    p = htmlmain.read(page)
    assert htmlmain.extract(p, sorted(htmlmain.scores(p), key=lambda k: -htmlmain.scores(p)[k])) == LINE


@pytest.mark.parametrize("tag", ['<a href="x"">', "<img alt=it's>", "<a href=x title='a>b'>", '<br class="a" b = "c>d" />', "<i a='b' \" c>"])
def test_quotes_open_only_behind_an_equals_sign(tag):
    page = htmlmain.read(f"<body><article><p>one {tag}two</p><p>three \"four\" it's</p><p>five</p></article></body>")
    assert [b[1].replace(" ", "") for b in page.blocks] == ["onetwo", "three\"four\"it's", "five"]


def test_elements_beside_stay_out():
    beside = "".join(f"<div class='{c}'><p>{LINE} {LINE} {LINE}</p></div>" for c in ("post-comments", "sidebar", "comments content-footer", "cookie-notice"))
    page = htmlmain.read(f"<body><article><p>{LINE}</p></article>{beside}<div role='complementary' class='content'><p>{LINE}</p></div></body>")
    assert [b[1] for b in page.blocks] == [LINE]

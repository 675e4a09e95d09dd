import pytest
from pyspark.sql import functions as F

from corpusloom.operators.content import content_area
from corpusloom.operators.links import extract_links, follow_links
from corpusloom.operators.selectors import Step, parse_selector, select_nodes
from corpusloom.operators.skeleton import html_skeleton, skeleton_preview
from corpusloom.operators.tokens import page_nodes, page_tokens


def pages(spark, *htmls, url="https://h.com/docs/a"):
    return spark.createDataFrame(
        [(n, url, h) for n, h in enumerate(htmls)], "page_id bigint, url string, html string"
    )


def kinds(spark, html):
    rows = page_tokens(pages(spark, html)).orderBy("pos").collect()
    return [(r.kind, r.tag or r.tok) for r in rows]


def test_tokens(spark):
    html = "<!DOCTYPE html><!-- <b> --><DIV class='a>b'>x<BR/>y</DIV ><script>a<b</p></script>1 < 2</ div><x-y z"
    assert kinds(spark, html) == [
        ("comment", "<!DOCTYPE html>"),
        ("comment", "<!-- <b> -->"),
        ("open", "div"),
        ("text", "x"),
        ("void", "br"),
        ("text", "y"),
        ("close", "div"),
        ("raw", "script"),
        ("text", "1 "),
        ("text", "<"),
        ("text", " 2"),
        ("comment", "</ div>"),
        ("cut", "x-y"),
    ]


def test_tokens_keep_all_text_and_pages(spark):
    html = "a<p title=\"x>y\" b='<' c=d/e>t</p><!-- open <p>"
    df = page_tokens(pages(spark, html, "", None))
    joined = df.where("page_id = 0").orderBy("pos").collect()
    assert "".join(r.tok for r in joined) == html
    assert [r.kind for r in joined] == ["text", "open", "text", "close", "comment"]
    assert df.select("page_id").distinct().count() == 3


def test_long_tokens_do_not_overflow(spark):
    many = "<p " + " ".join(f'a{k}="{k}"' for k in range(20000)) + ">x</p>"
    broken = "<a href='" + "x=y " * 50000
    df = page_tokens(pages(spark, many, broken)).groupBy("page_id").count()
    assert {r[0]: r[1] for r in df.collect()} == {0: 3, 1: 1}


def intervals(spark, html):
    rows = page_nodes(page_tokens(pages(spark, html))).orderBy("pos").collect()
    return [(r.tag, r.pos, r.end_pos) for r in rows]


def test_nodes_nested_and_stray(spark):
    assert intervals(spark, "<div><div>a</div></div></div><div>b</div>") == [
        ("div", 0, 4),
        ("div", 1, 3),
        ("div", 6, 8),
    ]


def test_nodes_implied_ends(spark):
    html = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>x<p>y<br><div>z</div>"
    tags = intervals(spark, html)
    assert ("li", 1, 8) in tags and ("li", 4, 5) in tags and ("li", 6, 7) in tags
    assert ("li", 9, 10) in tags
    assert ("p", 12, 13) in tags and ("p", 14, 16) in tags


def test_nodes_unclosed(spark):
    assert intervals(spark, "<div><p><b>x<p>y<a href=1>u<a href=2>v</a>") == [
        ("div", 0, 10),
        ("p", 1, 3),
        ("b", 2, 3),
        ("p", 4, 10),
        ("a", 6, 7),
        ("a", 8, 10),
    ]


def test_node_attributes(spark):
    html = """<a ID=top Class="x y" data-id="no" title="href=1" HREF='/q?a=1&amp;b' role>t</a><i id="">"""
    a, i = page_nodes(page_tokens(pages(spark, html))).orderBy("pos").collect()
    assert (a.id, a.classes, a.role, a.href) == ("top", "x y", "", "/q?a=1&b")
    assert (i.id, i.classes) == ("", None)


def test_parse_selector():
    assert parse_selector("nav > a.b#c[href^='/d'], p") == [
        [Step(tag="nav"), Step("a", "c", ("b",), (("href", "^=", "/d"),), ">")],
        [Step(tag="p")],
    ]
    assert parse_selector('[data-x="a b"]')[0][0].attrs == (("data-x", "=", "a b"),)
    for bad in ("a:hover", "a + b", "a ~ b", "", "a,", "> a", "a[href", "a::before", "[x~=y]"):
        with pytest.raises(ValueError):
            parse_selector(bad)


HTML = """<body id=top><nav class="side menu"><ul><li><a href="/docs/1">one</a></li></ul>
<a href="/x/2.html" rel=n>two</a></nav><main><p>t <a href="/docs/3">three</a></p>
<div><section><p><span>s</span></p></section></div></main><p class="menus">q</p></body>"""


@pytest.mark.parametrize(
    "selector, want",
    [
        ("nav a", ["/docs/1", "/x/2.html"]),
        ("nav > a", ["/x/2.html"]),
        (".side a", ["/docs/1", "/x/2.html"]),
        (".menu li > a", ["/docs/1"]),
        ("nav.menu.side > ul a", ["/docs/1"]),
        ("#top > main a", ["/docs/3"]),
        ("main p a, li a", ["/docs/1", "/docs/3"]),
        ("a[href^='/docs/']", ["/docs/1", "/docs/3"]),
        ("a[href$='.html']", ["/x/2.html"]),
        ("a[href*=docs]", ["/docs/1", "/docs/3"]),
        ("a[rel]", ["/x/2.html"]),
        ("a[rel=n]", ["/x/2.html"]),
        ("body nav ul a", ["/docs/1"]),
        ("ul nav a", []),
        ("main * a", ["/docs/3"]),
    ],
)
def test_links_by_selector(spark, selector, want):
    got = extract_links(pages(spark, HTML), selector).orderBy("ord").collect()
    assert [r.href for r in got] == want
    assert [r.ord for r in got] == list(range(1, len(want) + 1))


def test_select_descendants_and_children(spark):
    def tags(selector):
        rows = select_nodes(page_tokens(pages(spark, HTML)), selector).orderBy("pos").collect()
        return [r.tag for r in rows]

    assert tags("main p") == ["p", "p"]
    assert tags("main > p") == ["p"]
    assert tags("section > p > span, .menu") == ["nav", "span"]
    assert tags("main div p span") == ["span"]


def test_links_left_out(spark):
    html = (
        "<nav><a href='/_next/x'>n</a><a href='/sitemap.xml'>s</a><a href='/favicon.ico'>f</a>"
        "<a href=''>e</a><a>none</a><a href='/t'>   </a><a href='/ok'> a<b>b</b> &amp; c </a>"
        "<a href='/img'><img src=x></a></nav><a href='/out'>out</a>"
    )
    got = extract_links(pages(spark, html), "nav a").collect()
    assert [(r.href, r.title) for r in got] == [("/ok", "ab & c")]


def test_follow_links_dedup(spark):
    html = (
        "<a href='b'>first</a><a href='/docs/b'>second</a><a href='/docs/b#x'>frag</a>"
        "<a href='http://a b/'>bad</a><a href='mailto:x@y.z'>mail</a>"
    )
    got = follow_links(pages(spark, html), "a").orderBy("ord").collect()
    assert [(r.ord, r.url, r.title) for r in got] == [
        (1, "https://h.com/docs/b", "first"),
        (2, "https://h.com/docs/b#x", "frag"),
        (3, "mailto:x@y.z", "mail"),
    ]


AREAS = [
    ("<main>a<b>x</b></main><main>second</main>", "main", "a<b>x</b>"),
    ("<main></main><main>second</main>", "main", None),
    ("<p>none</p>", "main", None),
    ("<main>a<main>b</main>c</main>d", "main", "a<main>b</main>c"),
    ("<main>cut <i>off", "main", "cut <i>off"),
    ("<div class='c d'>x</div>", ".d", "x"),
    ("<div><div id=c>x<p>y</div>z</div>", "#c", "x<p>y"),
    ("<div><p>a<p>b</div>", "p", "a"),
    ("<html><head><title>t</title></head>rest<i>x</i></html>", "body", "rest<i>x</i></html>"),
    ("<body>x</body>", "body", "x"),
    (None, "body", None),
]


@pytest.mark.parametrize("html, selector, want", AREAS)
def test_content_area(spark, html, selector, want):
    row = content_area(pages(spark, html), selector).first()
    assert row.inner == want
    assert (row.error is None) == (want is not None)


def test_area_paths_agree(spark):
    df = pages(spark, *[h for h, _, _ in AREAS], HTML)
    for tag in ("main", "div"):
        fast = content_area(df, tag).select("page_id", "inner")
        general = content_area(df, f"{tag}, nosuch").select("page_id", "inner")
        assert fast.exceptAll(general).count() == 0


def outline(spark, html):
    return html_skeleton(pages(spark, html)).first().skeleton


def test_skeleton_rules(spark):
    long_href, edge_href = "/" + "x" * 50, "/" + "x" * 49
    assert outline(spark, f"<body><a href='{long_href}' class=c id=i role=r>t</a></body>") == (
        f'<body>\n  <a id="i" class="c" role="r" href="{long_href[:47]}...">t</a>\n</body>'
    )
    assert edge_href + '">' in outline(spark, f"<body><a href='{edge_href}'>t</a></body>")
    assert outline(spark, "<body><p>" + "y" * 30 + "</p></body>").count("y" * 30 + "<") == 1
    assert "y" * 27 + "...</p>" in outline(spark, "<body><p>" + "y" * 31 + "</p></body>")
    assert outline(spark, "<body>own<div href=x>t<br></div></body>") == (
        "<body>\n  <div>\n  <br />\n</div>\n</body>"
    )


def test_skeleton_drops(spark):
    html = (
        "<html><head><title>t</title></head><body><script>s</script><style>c</style>"
        "<noscript><p>n</p></noscript><iframe>i</iframe><svg><path/></svg><img src=a>"
        "<picture><source></picture><video></video><audio></audio><canvas>c</canvas>"
        "<div><svg><g></g></svg> kept <!-- no --></div></body></html>"
    )
    assert outline(spark, html) == "<body>\n  <div>kept</div>\n</body>"
    assert outline(spark, "<html><p>x</p></html>") == "<html>\n  <p>x</p>\n</html>"


def test_skeleton_preview(spark):
    df = spark.createDataFrame([(1, "a" * 1000), (2, "b" * 1001)], "page_id bigint, skeleton string")
    one, two = skeleton_preview(df).orderBy("page_id").collect()
    assert (one.size, one.preview) == (1000, "a" * 1000)
    assert two.size == 1001
    assert two.preview == "b" * 1000 + "...\n\n[truncated - see full file for complete structure]"

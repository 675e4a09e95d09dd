"""Optional end tags, elements that end with their parents, and the tree of a page."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.selectors import with_parents
from corpusloom.operators.skeleton import html_skeleton
from corpusloom.operators.tokens import page_nodes, page_tokens

# Per page: tag, first and last token, first token of the element around it.
PAGES = {
    "<table><thead><tr><th>a<tbody><tr><td>b<td>c<tr><td>d</table><p>x": [
        ("table", 0, 14, None), ("thead", 1, 4, 0), ("tr", 2, 4, 1), ("th", 3, 4, 2), ("tbody", 5, 13, 0), ("tr", 6, 10, 5),
        ("td", 7, 8, 6), ("td", 9, 10, 6), ("tr", 11, 13, 5), ("td", 12, 13, 11), ("p", 15, 16, None),
    ],
    "<table><tr><td><table><tr><td>in</table>out<td>b</table>": [
        ("table", 0, 11, None), ("tr", 1, 10, 0), ("td", 2, 8, 1), ("table", 3, 7, 2), ("tr", 4, 6, 3), ("td", 5, 6, 4), ("td", 9, 10, 1),
    ],
    "<div><video>v<span>s</div><iframe>t<footer>f</footer>": [
        ("div", 0, 5, None), ("video", 1, 4, 0), ("span", 3, 4, 1), ("iframe", 6, 10, None), ("footer", 8, 10, 6),
    ],
    "<dl><dd>a<dl><dt>b</dl><dd>c</dl><select><optgroup><option>1<optgroup><option>2</select>": [
        ("dl", 0, 9, None), ("dd", 1, 6, 0), ("dl", 3, 6, 1), ("dt", 4, 5, 3), ("dd", 7, 8, 0), ("select", 10, 17, None),
        ("optgroup", 11, 13, 10), ("option", 12, 13, 11), ("optgroup", 14, 16, 10), ("option", 15, 16, 14),
    ],
    "<section><ul><li>a<li>b</section><p>c": [("section", 0, 6, None), ("ul", 1, 5, 0), ("li", 2, 3, 1), ("li", 4, 5, 1), ("p", 7, 8, None)],
    "</td></li></table><td>a</td><br>": [("td", 3, 5, None), ("br", 6, 6, None)],
    "text": [], "": [], None: [],
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://x.com/{k}", html) for k, html in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_elements_and_parents(spark, pages):
    rows = with_parents(page_nodes(page_tokens(pages))).orderBy("page_id", "pos").collect()
    depths = {(r.page_id, r.pos): r.depth for r in rows}
    for k, (html, want) in enumerate(PAGES.items()):
        got = [(r.tag, r.pos, r.end_pos, r.parent_pos) for r in rows if r.page_id == k]
        assert got == want, html
        assert all(depths[k, p] == (0 if up is None else depths[k, up] + 1) for _, p, _, up in got)


def test_one_outline_per_page(spark, pages):
    got = {r.page_id: r.skeleton for r in html_skeleton(pages).collect()}
    assert len(got) == len(PAGES) and all(s.startswith("<body") for s in got.values())
    assert got[2] == "<body>\n  <div>\n  <span>s</span>\n</div>\n</body>".replace("\n  <div>\n  <span>s</span>\n</div>", "\n  <div />")
    assert [got[k] for k in (5, 6, 7, 8)] == ["<body>\n  <td>a</td>\n  <br />\n</body>", "<body>text</body>", "<body />", "<body />"]
    heads = spark.createDataFrame(
        [(1, "u", "<html><head><title>t</title></head>kept <p>x</html>"), (2, "u", "<title>t</title>"), (3, "u", "<p>a</p><body class=c>b</body>")],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r.skeleton for r in html_skeleton(heads).collect()}
    assert got == {1: "<html>\n  <head>\n  <title>t</title>\n</head>\n  <p>x</p>\n</html>", 2: "<body />", 3: '<body class="c">b</body>'}


def test_nested_selectors_of_one_tag(spark):
    from corpusloom.operators.selectors import select_nodes

    page = spark.createDataFrame([(1, "<ul><li><a>x</a><ul><a>y</a></ul></ul><a>z</a>")], "page_id long, html string")
    rows = select_nodes(page_tokens(page.withColumn("url", F.lit("u"))), "ul ul a").collect()
    assert [r.pos for r in rows] == [6]

import pytest

from corpusloom.operators.markdown import html_to_markdown

CASES = [
    ("<h1>A *b*</h1><h6>c_d</h6>", "# A \\*b\\*\n\n###### c\\_d"),
    ("<p>a\n  b</p><p>c<br>d</p>", "a b\n\nc  \nd"),
    ("<p>x <strong> bold </strong>y<em>z</em></p>", "x **bold** y_z_"),
    ("<p><b>open <p>next</b> stray", "open\n\nnext stray"),
    ("<p><b></b>x</p>", "x"),
    ("<p><b>a<b>b</b>c</b></p>", "**abc**"),
    ("<a href='/q(1)?a=1&amp;b'>l <i>k</i></a> <a>none</a>", "[l _k_](/q\\(1\\)?a=1&b) none"),
    ("<p>use <code>a_b * `c</code></p>", "use `a_b * `c`"),
    ("<pre><code>\n x = '&lt;'\n\ty_*</code></pre>", "```\n x = '<'\n\ty_*\n```"),
    ("<ul><li>a</li><li><p>b</p><p>c</p></li></ul>", "- a\n- b\n\n    c"),
    ("<ol><li>a<ul><li>x<li>y</ul></li><li>b</ol><p>z", "1. a\n    - x\n    - y\n2. b\n\nz"),
    ("<ul><li>a</ul><ol><li>b</ol>", "- a\n1. b"),
    ("<blockquote><p>a<p>b<br>c</blockquote>d", "> a\n>\n> b  \n> c\n\nd"),
    ("a<hr>b", "a\n\n* * *\n\nb"),
    ("<img src='a(1).png' alt='x[y]'><img alt=no>", "![x\\[y\\]](a\\(1\\).png)"),
    ("t &amp;amp; &lt;b&gt; &copy &nope;", "t &amp; <b> © &nope;"),
    ("<script>s</script><style>c</style><noscript>n</noscript><!-- c -->x", "x"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a\n\nb"),
    ("<div> </div>", ""),
]


@pytest.fixture(scope="module")
def converted(spark):
    df = spark.createDataFrame(
        [(n, "u", f"<body>{h}</body>") for n, (h, _) in enumerate(CASES)],
        "page_id bigint, url string, html string",
    )
    return {r.page_id: r.markdown for r in html_to_markdown(df).collect()}


@pytest.mark.parametrize("n", range(len(CASES)), ids=[w[:20] for _, w in CASES])
def test_markdown(converted, n):
    assert converted[n] == CASES[n][1]


def test_missing_areas(spark):
    df = spark.createDataFrame(
        [(1, "u", "<p>x"), (2, "u", ""), (3, "u", None), (4, "u", "<main>m</main>")],
        "page_id bigint, url string, html string",
    )
    got = {r.page_id: (r.markdown, r.error) for r in html_to_markdown(df, "main").collect()}
    error = "content area not found: main"
    assert got == {1: (None, error), 2: (None, error), 3: (None, error), 4: ("m", None)}

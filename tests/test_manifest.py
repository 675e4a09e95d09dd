import random

import pytest

from corpusloom.functions.text import JS_SPACE
from corpusloom.operators import manifest
from corpusloom.operators.bodies import lookup_manifests

BASE = "https://www.h.com/docs/"


def texts(spark, *contents, base=BASE):
    return spark.createDataFrame(
        [(f"s{n}", base, c) for n, c in enumerate(contents)],
        "site string, base_url string, content string",
    )


def test_line_kinds(spark):
    text = "# T\r\n\n \t\n## S\n### x\n> q\n- a\n*b\n---\n+ c\n1. d\n#x\n  # padded\n#"
    rows = manifest.manifest_lines(texts(spark, text)).orderBy("pos").collect()
    assert [(r.pos, r.kind) for r in rows] == [
        (0, "h1"), (2, "blank"), (3, "h2"), (4, "other"), (5, "quote"), (6, "item"), (7, "item"),
        (8, "item"), (9, "other"), (10, "other"), (11, "other"), (12, "h1"), (13, "other"),
    ]


def test_header(spark):
    df = texts(spark, "# A\n> one\n## S\n# B \n>two", "no header", "\n\n", "# A")
    got = {r.site: (r.title, r.description) for r in manifest.manifest_header(df).collect()}
    assert got == {
        "s0": ("B", "two"), "s1": ("", None), "s2": ("", None), "s3": ("A", None)
    }


DETAILS = [
    ("> q\nline one\n \nline two\n\nmore\n## S\nlater", "line one\n\nline two\nmore"),
    ("# T\nno quote\n## S", None),
    ("> q\n## S\ntext after", "text after"),  # nothing gathered yet: goes on gathering
    ("> q\na\n## S\n> again\nb", "a\nb"),  # the buffer is never emptied
    ("> q\na\n# H\nb\n## S", None),  # a first-level heading stops without keeping
    ("> q\n- item\nkept\n", "kept"),
    ("> q\n### sub\r\nx", "### sub\r\nx"),
    ("> q\n \n \n", ""),
    ("> q", None),
    ("\n\n", None),
]


@pytest.mark.parametrize("n", range(len(DETAILS)))
def test_details(spark, n):
    row = manifest.manifest_details(texts(spark, DETAILS[n][0])).first()
    assert row.details == DETAILS[n][1]


def test_sections_and_links(spark):
    text = (
        "- [early](/e)\n## Docs\n- [a](/a): note\n* [b](/b.txt)\n- no link\n-[c]( /c ):\n"
        "## OPTIONAL\n- x [d](http://o.com/d)y [e](/e)\n- [f](/f(1))\n## Empty\n+ [g](/g)\n- [](/h)"
    )
    df = texts(spark, text)
    sections = manifest.manifest_sections(df).orderBy("section_ord").collect()
    assert [(r.section_ord, r.title, r.is_optional) for r in sections] == [
        (1, "Docs", False), (2, "OPTIONAL", True), (3, "Empty", False)
    ]
    links = manifest.manifest_links(df).orderBy("pos").collect()
    assert [(r.section_ord, r.title, r.url, r.notes) for r in links] == [
        (1, "a", "/a", "note"),
        (1, "b", "/b.txt", None),
        (1, "c", "/c", ""),
        (2, "d", "http://o.com/d", None),
        (2, "f", "/f(1", None),
    ]


LINKS = (
    "## Docs\n- [a](/a)\n- [again](/a)\n- [out](https://h.com/x)\n- [bad](http://a b/)\n"
    "- [txt](full.txt?v=1)\n- [same](https://www.h.com/y)\n- [mail](mailto:x@y.z)\n"
    "## Optional\n- [o](/o)\n- [ext](https://e.com/)\n## Empty"
)


@pytest.mark.parametrize("include", [False, True])
def test_fates_and_stats(spark, include):
    links = manifest.classified_links(texts(spark, LINKS), include)
    got = manifest.manifest_page_links(links).orderBy("ord").collect()
    want = [
        (1, "https://www.h.com/a", "a", False),
        (2, "https://www.h.com/a", "again", False),
        (3, "https://www.h.com/docs/full.txt?v=1", "txt", True),
        (4, "https://www.h.com/y", "same", False),
    ]
    if include:
        want.append((5, "https://www.h.com/o", "o", False))
    assert [(r.ord, r.url, r.title, r.is_full_content) for r in got] == want
    stats = manifest.manifest_stats(links, include).first()
    assert tuple(stats)[1:] == ((3, 5, 0, 3) if include else (2, 4, 1, 3))
    sections = manifest.manifest_section_stats(links, include).orderBy("section_ord").collect()
    assert [(r.title, r.link_count) for r in sections] == (
        [("Docs", 4), ("Optional", 1), ("Empty", 0)] if include else [("Docs", 4), ("Empty", 0)]
    )


def test_lookup_and_check(spark):
    sites = spark.createDataFrame(
        [(u, u) for u in ("https://a.com/x?y", "http://a.com/", "https://b.com", "bad")],
        "site string, base_url string",
    )
    answers = spark.createDataFrame(
        [
            ("https://a.com/llms.txt", 200, "# Title\n> d\n## S\n- [x](/x)"),
            ("http://a.com/llms.txt", 404, "# long enough text"),
            ("https://b.com/llms.txt", 200, "  123456789  "),
        ],
        "manifest_url string, status int, content string",
    )
    found = lookup_manifests(sites, answers)
    assert {r.site: r.usable for r in found.collect()} == {
        "https://a.com/x?y": True, "http://a.com/": False, "https://b.com": False, "bad": False
    }
    checked = manifest.manifest_check(found)
    check = {r.site: tuple(r)[1:8] for r in checked.collect()}
    assert check["https://a.com/x?y"] == (True, "https://a.com/llms.txt", "Title", "d", 1, 0, 0)
    assert check["bad"] == (False, None, None, None, None, None, None)
    sections = {r.site: (r.total_sections, [tuple(s) for s in r.sections or []]) for r in checked.collect()}
    assert sections["https://a.com/x?y"] == (1, [("S", False, 1)]) and sections["bad"] == (None, [])
    # The texts are split in one place of the plan.
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_check_lists_sections(spark):
    text = "- [before](/b)\n## A\n## Optional\n- [o](/o)\n## Optional\n## B\n- [x](/x)\n- [y](https://other.com/)\n# T\n> q"
    found = spark.createDataFrame(
        [("s", "https://a.com/", "https://a.com/llms.txt", text, True), ("e", "https://a.com/", "https://a.com/llms.txt", "plain text", True)],
        "site string, base_url string, manifest_url string, content string, usable boolean",
    )
    got = {r.site: r for r in manifest.manifest_check(found).collect()}
    assert [tuple(s) for s in got["s"].sections] == [("A", False, 0), ("B", False, 1)]
    assert (got["s"].total_sections, got["s"].total_links, got["s"].skipped_optional, got["s"].skipped_external) == (2, 1, 1, 1)
    assert (got["s"].title, got["s"].description, got["e"].title, got["e"].sections) == ("T", "q", "", [])
    every = {r.site: r for r in manifest.manifest_check(found, include_optional=True).collect()}
    assert [tuple(s) for s in every["s"].sections] == [("A", False, 0), ("Optional", True, 1), ("Optional", True, 0), ("B", False, 1)]


def read_manifest(text):
    """The same semantics, written as a plain loop."""
    title, description, details, gathered, gathering = "", None, None, [], False
    sections, links = [], []
    for line in text.split("\n"):
        t = line.strip(JS_SPACE)
        if line == "":
            continue
        if t == "":
            if gathering:
                gathered.append("")
        elif t.startswith("# "):
            title, gathering = t[2:].strip(JS_SPACE), False
        elif t[0] == ">":
            description, gathering = t[1:].strip(JS_SPACE), True
        elif t.startswith("## "):
            if gathering and gathered:
                details, gathering = "\n".join(gathered).strip(JS_SPACE), False
            sections.append(t[3:].strip(JS_SPACE))
        elif t[0] in "-*":
            if sections and "](" in t:
                links.append((len(sections), t[t.index("[") + 1 : t.index("]")]))
        elif gathering:
            gathered.append(line)
    if gathering and gathered:
        details = "\n".join(gathered).strip(JS_SPACE)
    return title, description, details, sections, links


def test_random_manifests(spark):
    rng = random.Random(7)
    parts = ["# t1", "# t2 ", "> q1", ">q2", "## A", "## optional", "text", "  text ", "", " ", "\t",
             "- [l](/x)", "* [m](/y): n", "- none", "### h", "---", "x\r"]
    contents = ["\n".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    df = texts(spark, *contents).repartition(8).cache()
    header = {r.site: (r.title, r.description) for r in manifest.manifest_header(df).collect()}
    details = {r.site: r.details for r in manifest.manifest_details(df).collect()}
    sections, links = {}, {}
    for r in manifest.manifest_sections(df).orderBy("section_ord").collect():
        sections.setdefault(r.site, []).append(r.title)
    for r in manifest.manifest_links(df).orderBy("pos").collect():
        links.setdefault(r.site, []).append((r.section_ord, r.title))
    for n, text in enumerate(contents):
        s = f"s{n}"
        got = (*header[s], details[s], sections.get(s, []), links.get(s, []))
        assert got == read_manifest(text), repr(text)

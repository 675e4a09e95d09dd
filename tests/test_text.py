import html.entities
import random

from pyspark.sql import functions as F

from corpusloom.functions.names import slug
from corpusloom.functions.text import decode_entities, js_trim


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_js_trim(spark):
    assert _one(spark, " ﻿\t\r\n　 a  b  ", js_trim) == "a  b"
    assert _one(spark, "​", js_trim) == "​"  # no white space in that sense
    assert _one(spark, None, js_trim) is None


SLUGS = {
    "Guide > Big.Table": "guide_big_table",
    "a_b": "ab",
    "中文": "",
    "a b": "a_b",
    ".start": "_start",
    "a -- b...c": "a_b_c",
    "Kſ x": "_x",  # look like K and s, but are not ASCII
    "C++ & C#": "c_c",
}


def test_slug(spark):
    df = spark.createDataFrame([(t,) for t in SLUGS], "t string")
    got = {r[0]: r[1] for r in df.select("t", slug(F.col("t"))).collect()}
    assert got == SLUGS


ENTITIES = {
    "a &amp;amp; b": "a &amp; b",
    "&lt;p&gt; &quot;x&quot; &apos;": "<p> \"x\" '",
    "&amp&lt": "&<",
    "&ampfoo; &copy2": "&foo; ©2",
    "&am &nope; &; & &#; &#x;": "&am &nope; &; & &#; &#x;",
    "&#65;&#x42;&#X43&#8212;": "ABC—",
    "&#0;&#xD800;&#x110000;": "���",
    "&#x80;&#x81;": "€\x81",
    "&#128512;": "\U0001f600",
    "plain": "plain",
}


def test_entities(spark):
    df = spark.createDataFrame([(t,) for t in ENTITIES], "t string")
    got = {r[0]: r[1] for r in df.select("t", decode_entities(F.col("t"))).collect()}
    assert got == ENTITIES
    href = decode_entities(F.lit("?a=1&amp;b&copy=2&lt;&copy"), in_attribute=True)
    assert spark.range(1).select(href).first()[0] == "?a=1&b&copy=2<©"


def test_entities_as_the_standard_reads_them(spark):
    rng, names = random.Random(1), list(html.entities.html5)
    cases = ["&check;", "&lbrace;", "&notit;", "&notin;", "a&amp b", "&ampx", "&NotEqualTilde;", "&colon;&Tab;&NewLine;", "x&gt;&gty", "&aelig", "&thorn="]
    parts = [lambda: "&" + rng.choice(names), lambda: rng.choice(names)[:3], lambda: rng.choice(["&", ";", "x=", " "])]
    cases += ["".join(rng.choice(parts)() for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r.c: r.d for r in df.select("c", decode_entities(F.col("c")).alias("d")).collect()}
    assert got == {c: html.unescape(c) for c in cases}
    attributes = {"?a&notit;": "?a&notit;", "&notin;": "∉", "?a=1&copy=2": "?a=1&copy=2", "&copyx": "&copyx", "&amp&lt": "&<", "&lt=": "&lt="}
    df = spark.createDataFrame([(c,) for c in attributes], "c string")
    got = {r.c: r.d for r in df.select("c", decode_entities(F.col("c"), in_attribute=True).alias("d")).collect()}
    assert got == attributes

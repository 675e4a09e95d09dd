"""Every registered query against its SQL, and the shape of the plans."""

import pytest
from check_oracles import difference, duck

from __spark_entry__ import entry, queries
from corpusloom.verify.fixtures import FIXTURES, Inputs, fixture_sql
from corpusloom.verify.oracles import oracles
from corpusloom.verify.queries import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registered()))
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    rel = con.sql(oracles()[name])
    assert difference(df.collect(), df.columns, rel.fetchall(), rel.columns) is None


def test_every_query_has_sql():
    assert set(registered()) == set(oracles()) <= set(queries())


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_fixtures_split_large_hosts_alike(spark, con, name):
    tables = {t: getattr(Inputs(spark, SF), t) for t in ("pages", "documents")}
    sql = fixture_sql(name, "spark", 16)
    df = spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql})
    rel = con.sql(fixture_sql(name, "duckdb", 16).replace("{pages}", "pages").replace("{documents}", "documents"))
    assert difference(df.collect(), df.columns, rel.fetchall(), rel.columns) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Pages move once, before they are split into tokens.
ONE_EXCHANGE = (
    "page_tokens page_nodes select_nodes extract_links content_area html_to_markdown "
    "html_skeleton skeleton_preview"
).split()


@pytest.mark.parametrize("name", ONE_EXCHANGE)
def test_one_exchange(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "Generate" not in below and "ReadSchema: struct<page_id:bigint,html:string>" in below


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert word not in plan, word


def test_simple_selectors_sort_tokens_once(spark):
    plan = plan_of(queries()["extract_links"](spark, SF))
    assert plan.count("Sort [") == 2  # tokens, then the few links found
    assert plan[plan.rindex("Sort [") :].count("Window") == 0


def test_urls_do_not_read_html(spark):
    for name in ("domain_rollup", "md_candidates", "path_titles"):
        assert "html:string" not in plan_of(queries()[name](spark, SF))


def test_bucketed_pages_do_not_move(spark):
    from corpusloom.operators.links import extract_links
    from corpusloom.operators.markdown import html_to_markdown
    from corpusloom.sources.captures import read_pages, write_clustered_pages

    pages = read_pages(spark, f"{SF}/pages.parquet")
    write_clustered_pages(pages, "clustered_pages", 8)
    try:
        stored = spark.table("clustered_pages")
        assert "Exchange hash" not in plan_of(html_to_markdown(stored, "body", clustered=True))
        links = extract_links(stored, "nav a", clustered=True)
        assert "Exchange hash" not in plan_of(links)
        assert links.exceptAll(extract_links(pages, "nav a")).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS clustered_pages")

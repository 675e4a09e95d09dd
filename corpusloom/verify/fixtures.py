"""Inputs the given tables do not hold, derived from `pages` and `documents`.

Each is one SELECT that Spark and DuckDB both run, so that a query and its SQL
counterpart see the same rows. `{pages}` and `{documents}` stand for the tables,
`{name}` for another fixture. A captured host is split into one documentation
site per 4,096 page ids, so no manifest outgrows a single text at any scale.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.captures import read_pages

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_STEM = f"regexp_replace({_PATH}, '/$', '')"

FIXTURES = {
    # Pages under their site's host: (page_id, site, url, html).
    "captures": f"""
SELECT page_id, site, concat('https://', site, regexp_replace(url, '^[a-z]+://[^/?#]*', '')) AS url, html
FROM (SELECT page_id, url, html,
  concat('d', CAST(floor(page_id / $PAGES_PER_SITE) AS BIGINT), '.', {_HOST}) AS site FROM {{pages}}) AS s""",
    # All pages, and a broken one of five kinds for every tenth.
    "structured": """
SELECT page_id, url, html FROM {pages} AS p UNION ALL
SELECT -page_id - 1 AS page_id, concat(url, '#broken') AS url, CASE page_id % 50
  WHEN 0 THEN '<table><tr><td>a<td>b<tr><th>c</table><p>x' WHEN 10 THEN '<body><dl><dt>k<dd>v<dt>l</dl>z</body>'
  WHEN 20 THEN '<div id=d><iframe src=x>in</div><footer>f</footer>' WHEN 30 THEN 'just text'
  ELSE '<ul><li>a<ul><li>b</ul><li>c</ul><select><option>x<option>y</select>' END AS html FROM {pages} AS b WHERE page_id % 10 = 0""",
    # (site, status, content): about 1 of 7 sites has no manifest, 1 of 7 a useless one.
    "manifest_texts": f"""
SELECT site, CASE WHEN length(site) % 7 = 0 THEN 404 ELSE 200 END AS status,
  concat('https://', site, '/llms.txt') AS manifest_url,
  concat('https://', site, '/') AS base_url, content
FROM (SELECT site, $JOIN_LINES AS content FROM (
  SELECT DISTINCT site, -1 AS sec, CAST(-1 AS BIGINT) AS ord, concat('# ', site, chr(10), '> Pages of ', site, chr(10), 'Captured.', chr(10), ' ', chr(10), 'Second line.') AS line FROM {{captures}}
  UNION ALL
  SELECT DISTINCT site, CAST(page_id % 3 AS INT), CAST(-1 AS BIGINT), concat('## ', CASE page_id % 3 WHEN 0 THEN 'Docs' WHEN 1 THEN 'Guides' ELSE 'Optional' END) FROM {{captures}}
  UNION ALL
  SELECT site, CAST(page_id % 3 AS INT), page_id, concat(CASE WHEN page_id % 2 = 0 THEN '- [' ELSE '* [' END,
    $SPACED_TITLE, '](',
    CASE WHEN page_id % 7 = 0 THEN concat('https://other.example.com/x', page_id) WHEN page_id % 5 = 0 THEN concat({_PATH}, '.txt') ELSE {_PATH} END, ')',
    CASE WHEN page_id % 4 = 0 THEN ': short note' ELSE '' END) FROM {{captures}}) AS l GROUP BY site) AS m""",
    # As captured: some texts are too short to be a manifest; older and refused captures lie about.
    "captured_manifests": """
SELECT manifest_url, status, CASE WHEN length(site) % 7 = 1 THEN ' tiny ' ELSE content END AS content, 2 AS captured_at
FROM {manifest_texts} AS t UNION ALL
SELECT manifest_url, 200, concat('# Old', chr(10), '## Docs', chr(10), '- [Old page](/old)'), 1 FROM {manifest_texts} AS o WHERE length(site) % 7 > 0 UNION ALL
SELECT manifest_url, 503, 'try again later', 3 FROM {manifest_texts} AS r WHERE length(site) % 5 = 0""",
    # One crawl job per site; the entry page is its first one.
    "jobs": """
SELECT site, min_by(url, page_id) AS base_url,
  CASE length(site) % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'follow' ELSE 'auto' END AS mode
FROM {captures} AS c GROUP BY site""",
    "site_config": """
SELECT site AS domain, CASE WHEN length(site) % 2 = 0 THEN 'article' END AS content_selector,
  CASE (length(site) + ascii(substring(site, 4, 1))) % 8 WHEN 1 THEN 'nav a' WHEN 2 THEN 'nav li > a' WHEN 3 THEN 'ul > li > a, footer a'
    WHEN 4 THEN 'nav ul a' WHEN 5 THEN 'a[href^="/th"]' WHEN 6 THEN 'article a, .ad a' WHEN 7 THEN 'nav a[href*=e]' END AS follow_selector,
  CASE WHEN length(site) % 5 = 0 THEN false WHEN length(site) % 5 = 1 THEN true END AS use_native_md
FROM (SELECT DISTINCT site FROM {captures} AS c) AS d WHERE length(site) % 4 > 0""",
    "overrides": """
SELECT site, CASE WHEN length(site) % 9 = 0 THEN 'nav a' WHEN length(site) % 9 = 2 THEN 'nav ul a' END AS follow_selector,
  CASE WHEN length(site) % 10 = 0 THEN 'main' WHEN length(site) % 10 = 4 THEN 'article > p' END AS content_selector,
  CASE WHEN length(site) % 4 = 2 THEN './docs/' END AS output_dir,
  length(site) % 5 = 0 AS no_native_md, length(site) % 8 = 4 AS no_manifest, length(site) % 6 = 0 AS with_optional
FROM (SELECT DISTINCT site FROM {captures} AS c) AS d WHERE length(site) % 2 = 0""",
    # Every page's fetch log; `bad certificate` is followed by another attempt on purpose.
    "fetch_attempts": """
SELECT page_id, url, CAST(k AS INT) AS attempt, 1704067200000 + page_id * 60000 + k * 2000 AS at_ms,
  CASE WHEN k < page_id % 4 THEN NULL WHEN page_id % 10 = 9 THEN 503 WHEN page_id % 10 = 8 THEN 404 ELSE 200 END AS status,
  CASE WHEN k < page_id % 4 THEN CASE WHEN page_id % 3 = 0 THEN 'connect ETIMEDOUT' WHEN page_id % 3 = 1 THEN 'read ECONNRESET' ELSE 'bad certificate' END
       WHEN page_id % 10 = 9 THEN 'HTTP 503' WHEN page_id % 10 = 8 THEN 'HTTP 404' END AS error
FROM (SELECT page_id, url, $EXPLODE AS k FROM {pages} AS p) AS a""",
    # Every page, and a page of its own for each document that has none.
    "sheets": """
SELECT page_id, url FROM {pages} AS p UNION ALL
SELECT doc_id, concat('https://', coalesce(source, 'none'), '.example.com/', coalesce(lang, 'und'), '/text', doc_id)
FROM {documents} AS d WHERE NOT EXISTS (SELECT 1 FROM {pages} AS q WHERE q.page_id = d.doc_id)""",
    # Answers to Markdown candidates, one per document; a third did not answer, and HTML
    # pages and tiny ones do not count, nor does the older answer of some of them.
    "md_bodies": f"""
SELECT md_url, CASE WHEN page_id % 3 = 2 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 11 = 0 THEN '<!DOCTYPE html><p>no</p>' WHEN page_id % 13 = 0 THEN 'tiny' ELSE text END AS body, page_id * 2 + 1 AS captured_at
FROM (SELECT page_id, concat({_ROOT}, {_STEM}, '.md') AS md_url FROM {{sheets}} AS p) AS u
JOIN {{documents}} AS d ON d.doc_id = u.page_id UNION ALL
SELECT concat({_ROOT}, {_STEM}, '.md'), 200, concat('an older answer of ', page_id), page_id * 2 FROM {{sheets}} AS o WHERE page_id % 4 = 1""",
    # Planned pages; every fifth is a full-content text.
    "planned": f"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat({_ROOT}, {_STEM}, '.txt') ELSE url END AS url,
  page_id % 5 = 0 AS is_full_content
FROM {{sheets}} AS p""",
    # A full text per document; some are empty once their system note is gone.
    "full_bodies": f"""
SELECT url, 200 AS status, CASE WHEN page_id % 15 = 0 THEN '<SYSTEM>only</SYSTEM> '
  ELSE concat('<SYSTEM>tool note', chr(10), page_id, '</SYSTEM>', chr(10), text) END AS body, page_id * 2 + 1 AS captured_at
FROM (SELECT page_id, concat({_ROOT}, {_STEM}, '.txt') AS url FROM {{sheets}} AS q) AS f
JOIN {{documents}} AS d ON d.doc_id = f.page_id UNION ALL
SELECT concat({_ROOT}, {_STEM}, '.txt'), 200, concat('an older text of ', page_id), page_id * 2 FROM {{sheets}} AS o WHERE page_id % 10 = 0""",
    # A job per captured host, named otherwise than its domain; every eleventh is refused.
    "host_jobs": f"""
SELECT DISTINCT concat('job-', {_HOST}) AS site, regexp_replace({_HOST}, '^www[.]', '') AS domain, './corpus/' AS output_dir,
  CASE WHEN length({_HOST}) % 11 = 0 THEN 'refused' END AS error FROM {{sheets}} AS h""",
    # What those jobs take: some of their pages share a title.
    "host_pages": f"""
SELECT concat('job-', {_HOST}) AS site, page_id AS ord, concat('Page ', page_id % 997) AS title, page_id, url, is_full_content
FROM {{planned}} AS p WHERE length({_HOST}) % 11 > 0""",
}

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_DIALECTS = {
    "spark": {
        "$JOIN_LINES": "listagg(line, chr(10)) WITHIN GROUP (ORDER BY sec, ord)",
        "$SPACED_TITLE": f"regexp_replace({_TITLE}, '[^A-Za-z0-9 ]+', '-')",
        "$EXPLODE": "explode(sequence(0L, page_id % 4))",
    },
    "duckdb": {
        "$JOIN_LINES": "string_agg(line, chr(10) ORDER BY sec, ord)",
        "$SPACED_TITLE": f"regexp_replace({_TITLE}, '[^A-Za-z0-9 ]+', '-', 'g')",
        "$EXPLODE": "unnest(range(0, page_id % 4 + 1))",
    },
}


# A fixture parameter: a site holds this many page ids of a host at most, so that its
# manifest stays one document however often a host was captured.
PAGES_PER_SITE = 4096


def fixture_sql(name: str, dialect: str, pages_per_site: int = PAGES_PER_SITE) -> str:
    """The SELECT of a fixture over the given tables, other fixtures nested in."""
    sql = FIXTURES[name].strip().replace("$PAGES_PER_SITE", str(pages_per_site))
    for mark, text in _DIALECTS[dialect].items():
        sql = sql.replace(mark, text)
    return re.sub(
        r"\{(\w+)\}",
        lambda m: f"({fixture_sql(m[1], dialect, pages_per_site)})" if m[1] in FIXTURES else m[0],
        sql,
    )


class Inputs:
    """The given tables of one data directory and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        # Not a Path: that would fold the two slashes of `viewfs://` or `s3a://`.
        self.dir = sf_dir.rstrip("/")

    @property
    def pages(self) -> DataFrame:
        return read_pages(self.spark, f"{self.dir}/pages.parquet")

    @property
    def documents(self) -> DataFrame:
        schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
        return self.spark.read.schema(schema).parquet(f"{self.dir}/documents.parquet")

    def derived(self, name: str) -> DataFrame:
        sql = fixture_sql(name, "spark")
        # Braces of the frame references only; patterns hold none.
        tables = {t: getattr(self, t) for t in ("pages", "documents") if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **tables)

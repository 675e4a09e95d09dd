"""DuckDB SQL stating what each registered query must return.

Written from the semantics, where possible in another way than the Spark plan:
by text patterns over whole pages, self-joins on intervals, ordered aggregates.
"""

from __future__ import annotations

from corpusloom.functions.text import JS_SPACE
from corpusloom.operators.tokens import BLOCK_TAGS, FOREIGN_TAGS, VOID_TAGS
from corpusloom.verify.fixtures import fixture_sql

_PREVIEW_NOTE = "...\n\n[truncated - see full file for complete structure]"


def _fixture(name: str) -> str:
    sql = fixture_sql(name, "duckdb")
    return "(" + sql.replace("{pages}", "pages").replace("{documents}", "documents") + ")"


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# White space as an SQL expression, since it holds control characters.
_WS = " || ".join(f"chr({ord(c)})" for c in JS_SPACE)
_WS_CLASS = r"\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def _decoded(x: str) -> str:
    """The references the tables hold; `&amp` last and once, also without `;`."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_DOMAIN = f"regexp_replace({_HOST}, '^www[.]', '')"


def _slug(x: str) -> str:
    kept = f"regexp_replace({x}, '[^A-Za-z0-9{_WS_CLASS}.-]', '', 'g')"
    return f"lower(regexp_replace({kept}, '[{_WS_CLASS}.-]+', '_', 'g'))"


def _encoded(x: str) -> str:
    """Percent-encoding of a path with query and fragment."""
    char = (
        "CASE WHEN regexp_matches(c, '^[!#$%&()*+,./0-9:;=?@A-Z\\[\\]_a-z|~''-]$') THEN c "
        "ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END"
    )
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {char}), '')"


# --- tokens and nodes ----------------------------------------------------------------

_TOKEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>"
    r"|</?[a-z][^>]*>|[^<]+|<"
)
_TOKENS = rf"""
split_pages AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}', 0) AS ts FROM pages),
raw_tokens AS (SELECT page_id, len(ts) AS n_tok, CAST(unnest(range(len(ts))) AS INTEGER) AS pos, unnest(ts) AS tok FROM split_pages),
named_tokens AS (SELECT *, CASE WHEN starts_with(tok, '<') THEN nullif(lower(regexp_extract(tok, '^</?([A-Za-z][^\s/>]*)', 1)), '') END AS tag FROM raw_tokens),
tokens AS (SELECT *, CASE WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text'
  WHEN starts_with(tok, '<!') THEN 'comment'
  WHEN tag IN ('script', 'style') AND NOT starts_with(tok, '</') THEN 'raw'
  WHEN starts_with(tok, '</') THEN 'close'
  WHEN tag IN ({_quoted(VOID_TAGS)}) OR tag IN ({_quoted(FOREIGN_TAGS)}) AND ends_with(tok, '/>') THEN 'void' ELSE 'open' END AS kind FROM named_tokens)"""


def _attr(name: str) -> str:
    return f"nullif({_decoded(f'''regexp_extract(tok, ' {name}="([^"]*)"', 1)''')}, '')"


# Tags nest properly here but for `p` and `b`, which reach to the next block tag.
_NODES = f"""{_TOKENS},
edges AS (SELECT page_id, pos, tag, kind FROM tokens WHERE kind IN ('open', 'close', 'void') AND tag IN ({_quoted(BLOCK_TAGS)})),
levels AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS level
  FROM tokens WHERE kind IN ('open', 'close')),
ends AS (SELECT o.page_id, o.pos, min(c.pos) AS close_pos FROM levels o JOIN levels c
  ON o.page_id = c.page_id AND o.tag = c.tag AND o.level = c.level AND c.kind = 'close' AND c.pos > o.pos WHERE o.kind = 'open' GROUP BY ALL),
starts AS (SELECT * FROM tokens WHERE kind IN ('open', 'void')),
bounded AS (SELECT s.*, b.pos AS b_pos, b.tag AS b_tag, b.kind AS b_kind FROM starts s ASOF LEFT JOIN edges b ON s.page_id = b.page_id AND s.pos < b.pos),
nodes AS (SELECT s.page_id, s.n_tok, s.pos, s.tag, s.tok, CAST(CASE WHEN s.kind = 'void' THEN s.pos
    WHEN s.tag = 'p' THEN CASE WHEN b_tag = 'p' AND b_kind = 'close' THEN b_pos ELSE coalesce(b_pos - 1, n_tok - 1) END
    WHEN s.tag = 'b' THEN coalesce(e.close_pos, b_pos - 1, n_tok - 1)
    ELSE coalesce(e.close_pos, n_tok - 1) END AS INTEGER) AS end_pos
  FROM bounded s LEFT JOIN ends e ON s.page_id = e.page_id AND s.pos = e.pos)"""

def _links(pages: str = "pages", links: str = "links") -> str:
    """Navigation links by text patterns, as CTE `links`."""
    return f"""
nav_text AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)(</nav>|$)', 1), '(?s)<a href="[^"]*">[^<]*</a>') AS anchors FROM {pages}),
anchors AS (SELECT page_id, url, CAST(unnest(range(len(anchors))) AS INTEGER) AS nth, unnest(anchors) AS a FROM nav_text),
read_links AS (SELECT page_id, url AS base, nth, {_decoded('''regexp_extract(a, 'href="([^"]*)"', 1)''')} AS href,
  {_trim(_decoded("regexp_extract(a, '>([^<]*)<', 1)"))} AS title FROM anchors),
{links} AS (SELECT page_id, base, CAST(row_number() OVER (PARTITION BY page_id ORDER BY nth) AS INTEGER) AS ord, href, title FROM read_links
  WHERE href <> '' AND title <> '' AND NOT contains(href, '_next') AND NOT contains(href, 'sitemap') AND NOT contains(href, 'favicon'))"""


def _followed(pages: str = "pages", links: str = "links") -> str:
    """Those links resolved and without repeats, as CTE `followed`."""
    return f"""{_links(pages, links)},
resolved AS (SELECT page_id, ord, href, title, regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || {_encoded("href")} AS url FROM {links}),
first_links AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY ord) = 1),
followed AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS ord, url, title FROM first_links)"""


# --- Markdown: pieces per token, block edges as marks, marks settled per page --------


def _markdown(area: str) -> str:
    text = _decoded("regexp_replace(tok, '[ \\t\\n\\r\\f]+', ' ', 'g')")
    escaped = f"regexp_replace({text}, '([\\\\*_#\\[\\]`])', '\\\\\\1', 'g')"
    href = _decoded("""regexp_extract(tok, 'href="([^"]*)"', 1)""")
    target = f"regexp_replace({href}, '([()])', '\\\\\\1', 'g')"
    blocks = [t for t in BLOCK_TAGS if t not in ("li", "h1")]
    edge, item, br = "chr(57344)", "chr(57345)", "chr(57346)"
    return rf"""{_TOKENS},
area AS (SELECT t.*, min(CASE WHEN tag = '{area}' AND kind = 'open' THEN pos END) OVER w AS a_from, coalesce(min(CASE WHEN tag = '{area}' AND kind = 'close' THEN pos END) OVER w, n_tok) AS a_to
  FROM tokens t WINDOW w AS (PARTITION BY page_id)),
pieces AS (SELECT page_id, pos, CASE WHEN kind = 'text' THEN {escaped}
  WHEN tag = 'br' THEN {br} WHEN tag = 'li' AND kind = 'open' THEN {item} || '- '
  WHEN tag = 'h1' AND kind = 'open' THEN {edge} || '# '
  WHEN tag IN ({_quoted(blocks)}, 'li', 'h1') THEN {edge}
  WHEN tag = 'a' AND kind = 'open' THEN '[' WHEN tag = 'a' AND kind = 'close' THEN '](' || lag_target || ')' ELSE '' END AS piece
  FROM (SELECT *, last_value(CASE WHEN tag = 'a' AND kind = 'open' THEN {target} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lag_target FROM area WHERE pos > a_from AND pos < a_to) q),
joined AS (SELECT page_id, string_agg(piece, '' ORDER BY pos) AS s FROM pieces GROUP BY page_id),
settled AS (SELECT page_id, {_trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, ' +', ' ', 'g'), '[ \x{e000}\x{e002}]*\x{e001}', chr(57345), 'g'), '[ \x{e002}]*\x{e000}[ \x{e000}\x{e002}]*', chr(10) || chr(10), 'g'), ' *\x{e002} *', '  ' || chr(10), 'g'), '\x{e001}', chr(10), 'g')")} AS markdown FROM joined)"""


# --- skeleton --------------------------------------------------------------------------


def _cut(x: str, limit: int, kept: int) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN substring({x}, 1, {kept}) || '...' ELSE {x} END"


_SKELETON = f"""{_NODES},
roots AS (SELECT page_id, pos AS r_from, end_pos AS r_to FROM nodes WHERE tag = 'body'),
kept AS (SELECT n.*, r_from, lead(n.pos) OVER (PARTITION BY n.page_id ORDER BY n.pos) AS next_pos FROM nodes n JOIN roots r ON n.page_id = r.page_id AND n.pos BETWEEN r_from AND r_to),
leaves AS (SELECT *, coalesce(next_pos > end_pos, true) AS leaf FROM kept),
leaf_text AS (SELECT l.page_id, l.pos, {_trim(_decoded("string_agg(t.tok, '' ORDER BY t.pos)"))} AS txt FROM leaves l JOIN tokens t
  ON l.page_id = t.page_id AND t.kind = 'text' AND t.pos BETWEEN l.pos AND l.end_pos WHERE leaf GROUP BY l.page_id, l.pos),
drawn AS (SELECT l.*, CASE WHEN l.pos = r_from THEN '' ELSE chr(10) || '  ' END || '<' || tag
  || coalesce(' class="' || {_attr("class")} || '"', '') || CASE WHEN tag = 'a' THEN coalesce(' href="' || {_cut(_attr("href"), 50, 47)} || '"', '') ELSE '' END AS head,
  {_cut("coalesce(txt, '')", 30, 27)} AS shown FROM leaves l LEFT JOIN leaf_text x ON l.page_id = x.page_id AND l.pos = x.pos),
events AS (SELECT page_id, pos AS place, 0 AS shut, pos AS nth, CASE WHEN NOT leaf THEN head || '>' WHEN shown = '' THEN head || ' />' ELSE head || '>' || shown || '</' || tag || '>' END AS piece FROM drawn
  UNION ALL SELECT page_id, end_pos, 1, -pos, chr(10) || '</' || tag || '>' FROM drawn WHERE NOT leaf),
skeletons AS (SELECT page_id, string_agg(piece, '' ORDER BY place, shut, nth) AS skeleton FROM events GROUP BY page_id)"""

# The broken pages of the fixture, elements and outlines by hand: kind, pos, end, parent, depth, tag, id.
_BROKEN_NODES = """
broken_nodes AS (SELECT * FROM (VALUES
  (0, 0, 9, NULL, 0, 'table', NULL), (0, 1, 5, 0, 1, 'tr', NULL), (0, 2, 3, 1, 2, 'td', NULL), (0, 4, 5, 1, 2, 'td', NULL),
  (0, 6, 8, 0, 1, 'tr', NULL), (0, 7, 8, 6, 2, 'th', NULL), (0, 10, 11, NULL, 0, 'p', NULL),
  (1, 0, 10, NULL, 0, 'body', NULL), (1, 1, 8, 0, 1, 'dl', NULL), (1, 2, 3, 1, 2, 'dt', NULL), (1, 4, 5, 1, 2, 'dd', NULL), (1, 6, 7, 1, 2, 'dt', NULL),
  (2, 0, 3, NULL, 0, 'div', 'd'), (2, 1, 2, 0, 1, 'iframe', NULL), (2, 4, 6, NULL, 0, 'footer', NULL),
  (4, 0, 9, NULL, 0, 'ul', NULL), (4, 1, 6, 0, 1, 'li', NULL), (4, 3, 6, 1, 2, 'ul', NULL), (4, 4, 5, 3, 3, 'li', NULL), (4, 7, 8, 0, 1, 'li', NULL),
  (4, 10, 15, NULL, 0, 'select', NULL), (4, 11, 12, 10, 1, 'option', NULL), (4, 13, 14, 10, 1, 'option', NULL)) AS v(kind, pos, end_pos, parent_pos, depth, tag, id))"""
_BROKEN_OUTLINES = {
    0: "<body>|  <table>|  <tr>|  <td>a</td>|  <td>b</td>|</tr>|  <tr>|  <th>c</th>|</tr>|</table>|  <p>x</p>|</body>",
    1: "<body>|  <dl>|  <dt>k</dt>|  <dd>v</dd>|  <dt>l</dt>|</dl>|</body>",
    2: '<body>|  <div id="d" />|  <footer>f</footer>|</body>',
    3: "<body>just text</body>",
    4: "<body>|  <ul>|  <li>|  <ul>|  <li>b</li>|</ul>|</li>|  <li>c</li>|</ul>|  <select>|  <option>x</option>|  <option>y</option>|</select>|</body>",
}
_OUTLINES = "SELECT page_id, skeleton FROM skeletons" + "".join(
    f" UNION ALL SELECT -page_id - 1, replace('{text}', '|', chr(10)) FROM pages WHERE page_id % 50 = {10 * kind}"
    for kind, text in _BROKEN_OUTLINES.items()
)

# --- manifests ---------------------------------------------------------------------------

_LINES = f"""
texts AS (SELECT site, base_url, string_split(content, chr(10)) AS ls FROM {_fixture("manifest_texts")}),
all_lines AS (SELECT site, base_url, CAST(unnest(range(len(ls))) AS INTEGER) AS pos, unnest(ls) AS line FROM texts),
lines AS (SELECT *, {_trim("line")} AS t, CASE WHEN {_trim("line")} = '' THEN 'blank' WHEN starts_with({_trim("line")}, '# ') THEN 'h1' WHEN starts_with({_trim("line")}, '>') THEN 'quote'
  WHEN starts_with({_trim("line")}, '## ') THEN 'h2' WHEN regexp_matches({_trim("line")}, '^[-*]') THEN 'item' ELSE 'other' END AS kind FROM all_lines WHERE line <> '')"""

_SECTIONS = f"""{_LINES},
heads AS (SELECT site, pos, CAST(row_number() OVER (PARTITION BY site ORDER BY pos) AS INTEGER) AS section_ord, {_trim("substring(t, 4)")} AS section FROM lines WHERE kind = 'h2'),
items AS (SELECT l.site, l.base_url, l.pos, h.section_ord, h.section, lower(h.section) = 'optional' AS is_optional, {_trim("substring(l.t, 2)")} AS txt
  FROM lines l ASOF JOIN heads h ON l.site = h.site AND l.pos > h.pos WHERE l.kind = 'item'),
links AS (SELECT *, {_trim(r"regexp_extract(txt, '\[([^\]]+)\]\(([^)]+)\)', 1)")} AS title, {_trim(r"regexp_extract(txt, '\[([^\]]+)\]\(([^)]+)\)', 2)")} AS ref,
  CASE WHEN regexp_matches(txt, '\\[[^\\]]+\\]\\([^)]+\\):') THEN {_trim(r"regexp_extract(txt, '\[[^\]]+\]\([^)]+\):\s*(.*)', 1)")} END AS notes FROM items
  WHERE regexp_matches(txt, '\\[[^\\]]+\\]\\([^)]+\\)'))"""

# References are absolute URLs or root-relative paths here.
_FATES = f"""{_SECTIONS},
fates AS (SELECT *, CASE WHEN regexp_matches(ref, '^[a-z]+:') THEN ref ELSE rtrim(base_url, '/') || ref END AS url,
  CASE WHEN regexp_matches(ref, '^[a-z]+:') THEN 'external' WHEN is_optional THEN 'optional' ELSE 'kept' END AS fate FROM links)"""

_STATS = """
stats AS (SELECT site, count(*) FILTER (fate = 'kept') AS total_links, count(*) FILTER (fate = 'optional') AS skipped_optional,
  count(*) FILTER (fate = 'external') AS skipped_external FROM fates GROUP BY site)"""

_LISTING = """
counted_sections AS (SELECT h.site, h.section_ord, h.section, lower(h.section) = 'optional' AS is_optional, count(*) FILTER (f.fate = 'kept') AS n
  FROM heads h LEFT JOIN fates f ON h.site = f.site AND h.section_ord = f.section_ord GROUP BY ALL),
listing AS (SELECT site, count(*) FILTER (NOT is_optional) AS total_sections,
  to_json(list({'title': section, 'is_optional': is_optional, 'link_count': n} ORDER BY section_ord) FILTER (n > 0 OR NOT is_optional))::VARCHAR AS sections FROM counted_sections GROUP BY site)"""

_HEADER = f"""
header AS (SELECT site, coalesce(arg_max({_trim("substring(t, 3)")}, pos) FILTER (kind = 'h1'), '') AS title,
  arg_max({_trim("substring(t, 2)")}, pos) FILTER (kind = 'quote') AS description FROM lines GROUP BY site)"""

_LOOKUP = f"""
looked_up AS (SELECT j.site, j.base_url, {_ROOT.replace("url", "j.base_url")} || '/llms.txt' AS manifest_url, m.content, m.content IS NOT NULL AS usable
  FROM {_fixture("jobs")} j LEFT JOIN (SELECT * FROM (SELECT manifest_url, arg_max(content, captured_at) AS content FROM {_fixture("captured_manifests")} WHERE status = 200 GROUP BY manifest_url) WHERE length({_trim("content")}) >= 10) m
  ON {_ROOT.replace("url", "j.base_url")} || '/llms.txt' = m.manifest_url)"""

# --- planning ------------------------------------------------------------------------------

_CONFIG = f"""
config AS (SELECT j.site, j.base_url, j.mode, j.site AS domain, coalesce(o.follow_selector, c.follow_selector) AS follow_selector,
  coalesce(o.content_selector, c.content_selector, 'body') AS content_selector, coalesce(o.output_dir, './') AS output_dir,
  CASE WHEN o.no_native_md THEN false ELSE coalesce(c.use_native_md, true) END AS use_native_md,
  CASE WHEN o.no_manifest THEN false ELSE true END AS use_manifest, coalesce(o.with_optional, false) AS include_optional
  FROM {_fixture("jobs")} j LEFT JOIN {_fixture("overrides")} o ON j.site = o.site LEFT JOIN {_fixture("site_config")} c ON c.domain = j.site),
ready AS (SELECT * REPLACE (CASE WHEN mode = 'single' THEN NULL ELSE follow_selector END AS follow_selector, mode = 'auto' AND use_manifest AS use_manifest),
  CASE WHEN mode = 'follow' AND follow_selector IS NULL THEN 'follow mode needs a follow selector' END AS error FROM config)"""

# What each follow selector of the fixtures means, by the elements around an anchor.
_SELECTED = {
    "nav a": "list_contains(around, 'nav')",
    "nav ul a": "list_contains(around[list_position(around, 'nav'):], 'ul')",
    "nav li > a": "list_contains(around, 'nav') AND around[-1] = 'li'",
    "ul > li > a, footer a": "around[-1] = 'li' AND around[-2] = 'ul' OR list_contains(around, 'footer')",
    'a[href^="/th"]': "starts_with(href, '/th')",
    "article a, .ad a": "list_contains(around, 'article') OR list_contains(around, 'ad')",
    "nav a[href*=e]": "list_contains(around, 'nav') AND contains(href, 'e')",
}
_OWN_CASES = "\n".join(f"  WHEN '{name}' THEN {test}" for name, test in _SELECTED.items())
_OWN_LINKS = f"""{_NODES},
own_anchors AS (SELECT a.page_id, a.pos, a.end_pos, coalesce({_attr("href").replace("tok", "a.tok")}, '') AS href,
  list(CASE WHEN {_attr("class").replace("tok", "u.tok")} = 'ad' THEN 'ad' ELSE u.tag END ORDER BY u.pos) AS around
  FROM nodes a LEFT JOIN nodes u ON u.page_id = a.page_id AND u.pos < a.pos AND a.pos <= u.end_pos WHERE a.tag = 'a' GROUP BY ALL),
own_texts AS (SELECT a.page_id, a.pos, {_trim(_decoded("string_agg(t.tok, '' ORDER BY t.pos)"))} AS title FROM own_anchors a JOIN tokens t
  ON t.page_id = a.page_id AND t.kind = 'text' AND t.pos BETWEEN a.pos AND a.end_pos GROUP BY ALL),
own_links AS (SELECT w.follow_selector, w.site, a.pos, title, regexp_extract(w.base_url, '^([a-z]+://[^/?#]*)', 1) || {_encoded("href")} AS url
  FROM ready w JOIN captured c ON c.url = w.base_url JOIN own_anchors a ON a.page_id = c.page_id JOIN own_texts t ON t.page_id = a.page_id AND t.pos = a.pos
  WHERE href <> '' AND title <> '' AND NOT contains(href, '_next') AND NOT contains(href, 'sitemap') AND NOT contains(href, 'favicon') AND CASE w.follow_selector
{_OWN_CASES} END),
own_firsts AS (SELECT * FROM own_links QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY pos) = 1),
own_followed AS (SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY pos) AS INTEGER) AS ord, url, title FROM own_firsts)"""

_PLAN = f"""captured AS {_fixture("captures")}, {_CONFIG}, {_FATES}, {_LOOKUP}, {_OWN_LINKS},
listed AS (SELECT f.site, 'manifest' AS source, CAST(row_number() OVER (PARTITION BY f.site ORDER BY pos) AS INTEGER) AS ord, regexp_replace(c.base_url, '^([a-z]+://[^/]*).*$', '\\1') || ref AS url, title, ends_with(ref, '.txt') AS is_full_content
  FROM fates f JOIN ready c ON f.site = c.site JOIN looked_up u ON f.site = u.site WHERE c.error IS NULL AND c.use_manifest AND u.usable AND (fate = 'kept' OR fate = 'optional' AND c.include_optional)),
rest AS (SELECT * FROM ready WHERE error IS NULL AND site NOT IN (SELECT site FROM listed)),
plan AS (SELECT * FROM listed
  UNION ALL SELECT r.site, 'follow', l.ord, l.url, l.title, false FROM rest r JOIN own_followed l ON l.site = r.site
  UNION ALL SELECT site, 'single', 1, base_url, coalesce(list_filter(string_split({_PATH.replace("url", "base_url")}, '/'), lambda s: s <> '')[-1], 'index'), false FROM rest WHERE follow_selector IS NULL)"""

# --- bodies and reports ----------------------------------------------------------------------

_STEM = f"regexp_replace({_PATH}, '/$', '')"


def _candidates(table: str) -> str:
    return rf"""
candidates AS (SELECT page_id, CAST(unnest(range(2)) AS INTEGER) AS rank, unnest(CASE
  WHEN regexp_matches({_STEM}, '^.+[.][A-Za-z0-9]+$') THEN [{_ROOT} || regexp_replace({_STEM}, '[.][A-Za-z0-9]+$', '') || '.md', {_ROOT} || {_STEM} || '.md']
  WHEN ends_with(url, '/') THEN [{_ROOT} || {_PATH} || 'index.md', {_ROOT} || {_STEM} || '.md']
  ELSE [{_ROOT} || {_STEM} || '.md', {_ROOT} || {_STEM} || '/index.md'] END) AS md_url FROM {table})"""


def _usable(status: str, body: str) -> str:
    return (
        f"({status} BETWEEN 200 AND 299 AND NOT starts_with({_trim(body)}, '<!DOCTYPE') "
        f"AND NOT starts_with({_trim(body)}, '<html') AND length({body}) >= 10)"
    )


_NATIVE = f"""{_candidates(_fixture("sheets"))},
native AS (SELECT c.page_id, c.md_url, c.rank, m.body FROM candidates c JOIN (SELECT * FROM (SELECT md_url, arg_max(body, captured_at) AS body FROM {_fixture("md_bodies")} WHERE status = 200 GROUP BY md_url) WHERE {_usable("200", "body")}) m ON c.md_url = m.md_url
  QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY c.rank) = 1)"""


def _cleaned(x: str) -> str:
    return _trim(f"regexp_replace({x}, '(?s)<SYSTEM>.*?</SYSTEM>[{_WS_CLASS}]*', '', 'g')")


_NAMED = f"""
named AS (SELECT {_DOMAIN} AS domain, {_slug("title")} AS slug, page_id, url, title, text AS body
  FROM (SELECT page_id, url, coalesce(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1], 'index') AS title FROM {_fixture("sheets")}) JOIN documents ON doc_id = page_id),
corpus AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY domain, slug ORDER BY page_id DESC) = 1)"""

# The area `article b`: from the first such tag to its close or the next block tag.
_AREA = f"""{_NODES},
first_b AS (SELECT b.page_id, min_by(b.pos, b.pos) AS b_from, min_by(b.end_pos, b.pos) AS b_to FROM nodes b JOIN nodes a ON a.page_id = b.page_id AND a.tag = 'article' AND b.pos > a.pos AND b.pos <= a.end_pos WHERE b.tag = 'b' GROUP BY b.page_id),
inners AS (SELECT t.page_id, string_agg(t.tok, '' ORDER BY t.pos) AS inner_html FROM tokens t JOIN first_b f ON t.page_id = f.page_id AND t.pos > b_from AND t.pos <= b_to AND NOT (t.tag = 'b' AND t.kind = 'close' AND t.pos = b_to) GROUP BY t.page_id),
areas AS (SELECT p.page_id, inner_html AS "inner", CASE WHEN inner_html IS NULL THEN 'content area not found: article b' END AS error FROM pages p LEFT JOIN inners i ON p.page_id = i.page_id)"""

_OUTCOMES = f"""{_AREA},
outcomes AS (SELECT a.page_id, a.url, CASE WHEN status IS NULL THEN 'exception' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN r.error IS NOT NULL THEN 'no_content' ELSE 'success' END AS outcome,
  coalesce(a.error, r.error) AS error, at_ms AS done_ms FROM {_fixture("fetch_attempts")} a JOIN areas r ON a.page_id = r.page_id QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY attempt DESC) = 1),
planned_sites AS (SELECT {_DOMAIN} AS site, page_id FROM pages)"""

_SUMMARY = """
summary AS (SELECT site, count(*) AS total, count(outcome) AS completed, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome <> 'success') AS failed,
  CAST(0 AS BIGINT) AS skipped, CAST(floor(count(outcome)::DOUBLE / count(*)::DOUBLE * 100) AS INTEGER) AS percent FROM planned_sites LEFT JOIN outcomes USING (page_id) GROUP BY site)"""


def _query(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_PICKED = _query(f"{_NATIVE}, {_markdown('article')}", f"""SELECT p.page_id, p.url, CASE WHEN is_full_content AND {_cleaned('f.body')} <> '' THEN 'full' WHEN NOT is_full_content AND n.body IS NOT NULL THEN 'native' WHEN s.markdown IS NOT NULL THEN 'html' END AS source,
 CASE WHEN is_full_content AND {_cleaned('f.body')} <> '' THEN {_cleaned('f.body')} WHEN NOT is_full_content AND n.body IS NOT NULL THEN n.body ELSE s.markdown END AS body
 FROM {_fixture('planned')} p LEFT JOIN (SELECT url, arg_max(body, captured_at) AS body FROM {_fixture('full_bodies')} GROUP BY url) f ON f.url = p.url LEFT JOIN native n ON n.page_id = p.page_id LEFT JOIN settled s ON s.page_id = p.page_id""")

_STATE = f"""picks AS ({_PICKED}), last_tries AS (SELECT * FROM {_fixture("fetch_attempts")} QUALIFY row_number() OVER (PARTITION BY url ORDER BY at_ms DESC, attempt DESC) = 1),
missing AS (SELECT p.page_id, CASE WHEN p.page_id IN (SELECT page_id FROM pages) THEN 'content area not found: article' ELSE 'no body captured' END AS reason FROM picks p WHERE p.body IS NULL),
state AS (SELECT h.site, j.domain, h.ord, h.url, {_slug("h.title")} AS slug, p.source,
  CASE WHEN p.body IS NOT NULL THEN 'success' WHEN t.url IS NULL THEN CASE WHEN reason <> 'no body captured' THEN 'no_content' END WHEN t.status IS NULL THEN 'exception' WHEN t.status NOT BETWEEN 200 AND 299 THEN 'http_error' ELSE 'no_content' END AS outcome,
  CASE WHEN p.body IS NULL THEN CASE WHEN t.url IS NOT NULL AND t.status IS NULL THEN coalesce(t.error, 'unknown error') WHEN t.status NOT BETWEEN 200 AND 299 THEN coalesce(t.error, 'HTTP ' || t.status) ELSE reason END END AS error, t.at_ms AS done_ms
  FROM {_fixture("host_pages")} h JOIN {_fixture("host_jobs")} j ON j.site = h.site JOIN picks p ON p.page_id = h.page_id LEFT JOIN last_tries t ON t.url = h.url LEFT JOIN missing m ON m.page_id = h.page_id)"""


def oracles() -> dict[str, str]:
    return {
        "page_scan": "SELECT page_id, url, html FROM pages",
        "manifest_lookup": _query(_LOOKUP, "SELECT * FROM looked_up"),
        "native_md_probe": _query(_NATIVE, "SELECT * FROM native"),
        "corpus_write": _query(_NAMED, "SELECT slug, url, title, body, domain FROM corpus"),
        "corpus_listing": _query(_NAMED, "SELECT domain, count(*) AS n_files FROM corpus GROUP BY domain"),
        "site_config_scan": f"SELECT domain, follow_selector, content_selector, CAST(NULL AS VARCHAR) AS output_dir, use_native_md, CAST(NULL AS BOOLEAN) AS use_manifest, CAST(NULL AS BOOLEAN) AS include_optional FROM {_fixture('site_config')}",
        "domain_rollup": f"SELECT {_DOMAIN} AS domain, count(*) AS n_pages FROM pages GROUP BY 1",
        "md_candidates": _query(_candidates("pages"), "SELECT * FROM candidates"),
        "name_collisions": _query(_followed(), f"SELECT {_DOMAIN} AS domain, {_slug('title')} AS slug, count(*) AS n, arg_max(url, (page_id, ord)) AS kept_url FROM followed GROUP BY 1, 2 HAVING count(*) > 1"),
        "path_titles": f"SELECT page_id, coalesce(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1], 'index') AS title FROM pages",
        "resolve_links": _query(_followed(), "SELECT page_id, ord, href, url FROM resolved"),
        "page_tokens": _query(_TOKENS, "SELECT page_id, pos, tok, tag, kind FROM tokens"),
        "page_nodes": _query(f"{_NODES}, {_BROKEN_NODES}", f"""SELECT n.page_id, n.pos, n.end_pos, max(u.pos) AS parent_pos, CAST(count(u.pos) AS INTEGER) AS depth, n.tag, any_value({_attr('id').replace('tok', 'n.tok')}) AS id,
 any_value({_attr('class').replace('tok', 'n.tok')}) AS classes, any_value({_attr('role').replace('tok', 'n.tok')}) AS role, any_value({_attr('href').replace('tok', 'n.tok')}) AS href
 FROM nodes n LEFT JOIN nodes u ON u.page_id = n.page_id AND u.pos < n.pos AND n.pos <= u.end_pos GROUP BY n.page_id, n.pos, n.end_pos, n.tag
 UNION ALL SELECT -p.page_id - 1, b.pos, b.end_pos, b.parent_pos, b.depth, b.tag, b.id, NULL, NULL, NULL FROM pages p JOIN broken_nodes b ON p.page_id % 50 = 10 * b.kind"""),
        "select_nodes": _query(_NODES, f"""SELECT DISTINCT n.page_id, n.pos, n.end_pos, n.tag FROM nodes n
 LEFT JOIN nodes a ON a.page_id = n.page_id AND a.pos < n.pos AND n.pos <= a.end_pos AND a.tag IN ('nav', 'article')
 LEFT JOIN (SELECT c.page_id, c.pos, arg_max(u.tag, u.pos) AS up FROM nodes c JOIN nodes u ON u.page_id = c.page_id AND u.pos < c.pos AND c.pos <= u.end_pos WHERE c.tag = 'a' GROUP BY ALL) q ON q.page_id = n.page_id AND q.pos = n.pos
 WHERE (n.tag = 'a' AND a.tag = 'nav' AND q.up = 'li') OR (n.tag = 'p' AND a.tag = 'article') OR {_attr('class').replace('tok', 'n.tok')} = 'ad' OR (n.tag = 'a' AND starts_with({_attr('href').replace('tok', 'n.tok')}, '/th'))"""),
        "extract_links": _query(_links(), "SELECT page_id, ord, href, title FROM links"),
        "follow_links": _query(_followed(), "SELECT page_id, ord, url, title FROM followed"),
        "content_area": _query(_AREA, 'SELECT page_id, "inner", error FROM areas'),
        "html_to_markdown": _query(_markdown("body"), "SELECT page_id, markdown FROM settled"),
        "html_skeleton": _query(_SKELETON, _OUTLINES),
        "skeleton_preview": _query(_SKELETON, f"SELECT page_id, CAST(length(skeleton) AS INTEGER) AS size, CASE WHEN length(skeleton) > 1000 THEN substring(skeleton, 1, 1000) || '{_PREVIEW_NOTE}' ELSE skeleton END AS preview FROM ({_OUTLINES}) AS o"),
        "manifest_lines": _query(_LINES, "SELECT site, pos, line, kind FROM lines"),
        "manifest_header": _query(f"{_LINES}, {_HEADER}", "SELECT site, title, description FROM header"),
        "manifest_details": _query(_LINES, f"""SELECT site, {_trim("string_agg(CASE kind WHEN 'blank' THEN '' ELSE line END, chr(10) ORDER BY pos)")} AS details FROM lines l
 WHERE kind IN ('blank', 'other') AND pos > (SELECT min(pos) FROM lines q WHERE q.site = l.site AND q.kind = 'quote') AND pos < (SELECT min(pos) FROM lines h WHERE h.site = l.site AND h.kind = 'h2') GROUP BY site"""),
        "manifest_sections": _query(_SECTIONS, "SELECT site, section_ord, section AS title, lower(section) = 'optional' AS is_optional FROM heads"),
        "manifest_links": _query(_SECTIONS, "SELECT site, section_ord, pos, title, ref AS url, notes FROM links"),
        "manifest_page_links": _query(_FATES, "SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY pos) AS INTEGER) AS ord, url, title, ends_with(ref, '.txt') AS is_full_content FROM fates WHERE fate = 'kept'"),
        "manifest_stats": _query(f"{_FATES}, {_STATS}", "SELECT h.site, h.total_sections, coalesce(total_links, 0) AS total_links, coalesce(skipped_optional, 0) AS skipped_optional, coalesce(skipped_external, 0) AS skipped_external FROM (SELECT site, count(*) FILTER (lower(section) <> 'optional') AS total_sections FROM heads GROUP BY site) h LEFT JOIN stats s ON h.site = s.site"),
        "manifest_section_stats": _query(_FATES, "SELECT h.site, h.section_ord, h.section AS title, lower(h.section) = 'optional' AS is_optional, count(*) FILTER (f.fate = 'kept') AS link_count FROM heads h LEFT JOIN fates f ON h.site = f.site AND h.section_ord = f.section_ord GROUP BY ALL HAVING count(*) FILTER (f.fate = 'kept') > 0 OR lower(h.section) <> 'optional'"),
        "manifest_check": _query(f"{_FATES}, {_STATS}, {_HEADER}, {_LOOKUP}, {_LISTING}", "SELECT u.site, usable AS found, CASE WHEN usable THEN manifest_url END AS manifest_url, CASE WHEN usable THEN h.title END AS title, CASE WHEN usable THEN h.description END AS description, CASE WHEN usable THEN coalesce(s.total_links, 0) END AS total_links, CASE WHEN usable THEN coalesce(s.skipped_optional, 0) END AS skipped_optional, CASE WHEN usable THEN coalesce(s.skipped_external, 0) END AS skipped_external, CASE WHEN usable THEN coalesce(l.total_sections, 0) END AS total_sections, CASE WHEN usable THEN coalesce(l.sections, '[]') END AS sections FROM looked_up u LEFT JOIN header h ON u.site = h.site LEFT JOIN stats s ON u.site = s.site LEFT JOIN listing l ON u.site = l.site"),
        "effective_config": _query(_CONFIG, "SELECT * FROM config"),
        "mode_rules": _query(_CONFIG, "SELECT site, mode, follow_selector, use_manifest, error FROM ready"),
        "crawl_plan": _query(_PLAN, "SELECT site, source, ord, url, title, is_full_content FROM plan"),
        "crawl_preview": _query(_PLAN, "SELECT p.site, p.ord AS n, p.title, p.url, count(*) OVER (PARTITION BY p.site) AS total_pages, CASE source WHEN 'manifest' THEN 'auto' ELSE source END AS mode, content_selector, rtrim(output_dir, '/') || '/' || r.domain AS output_directory, use_native_md FROM plan p JOIN ready r ON p.site = r.site"),
        "full_content_clean": f"SELECT url, {_cleaned('body')} AS body FROM {_fixture('full_bodies')}",
        "native_md_filter": f"SELECT 'document' AS origin, doc_id AS id, {_usable('200', 'text')} AS usable FROM documents UNION ALL SELECT 'page', page_id, {_usable('200', 'html')} FROM pages",
        "pick_body": _PICKED,
        "fetch_outcomes": _query(_OUTCOMES, "SELECT page_id, url, outcome, error, done_ms FROM outcomes"),
        "retry_audit": f"""SELECT page_id, url, count(*) AS n_attempts, count(*) FILTER (status IS NULL AND error <> 'bad certificate') AS n_retryable, count(*) FILTER (status IS NULL AND error = 'bad certificate') AS n_final,
 count(*) FILTER (status = 503) AS http_only, coalesce(CAST(sum(CASE WHEN status IS NULL THEN 1000 * CAST(pow(2, attempt) AS BIGINT) END) AS BIGINT), 0) AS backoff_ms,
 count(*) FILTER (status IS NULL AND error = 'bad certificate') > 0 AS broke_rule, arg_max(status IS NULL, attempt) AS gave_up FROM {_fixture('fetch_attempts')} GROUP BY page_id, url""",
        "run_summary": _query(f"{_OUTCOMES}, {_SUMMARY}", "SELECT * FROM summary"),
        "failure_report": _query(_OUTCOMES, "SELECT site, page_id, url, error FROM planned_sites JOIN outcomes USING (page_id) WHERE outcome <> 'success' ORDER BY site, done_ms, page_id"),
        "run_report": _query(f"{_OUTCOMES}, {_SUMMARY}, {_NAMED}", """SELECT s.site, completed = total AS finished, coalesce(n_files, 0) AS n_files, './corpus/' || s.site AS output_directory, total, success, failed, duration_ms FROM summary s
 LEFT JOIN (SELECT domain, count(*) AS n_files FROM corpus GROUP BY domain) c ON c.domain = s.site
 LEFT JOIN (SELECT site, max(done_ms) - min(done_ms) AS duration_ms FROM planned_sites JOIN outcomes USING (page_id) GROUP BY site) d ON d.site = s.site"""),
        "run_state": _query(_STATE, "SELECT * FROM state"),
        "job_report": _query(f"""{_STATE},
totals AS (SELECT site, count(*) AS total, count(outcome) AS completed, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome <> 'success') AS failed, max(done_ms) - min(done_ms) AS duration_ms FROM state GROUP BY site),
files AS (SELECT site, count(*) AS n_files FROM (SELECT * FROM state WHERE outcome = 'success' QUALIFY row_number() OVER (PARTITION BY domain, slug ORDER BY ord DESC, site DESC, url DESC) = 1) GROUP BY site)""",
            """SELECT j.site, j.error IS NULL AS succeeded, j.error, './corpus/' || j.domain AS output_directory, coalesce(n_files, 0) AS n_files, coalesce(total, 0) AS total,
 coalesce(completed, 0) AS completed, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, duration_ms FROM """ + _fixture("host_jobs") + """ j LEFT JOIN totals t ON t.site = j.site LEFT JOIN files f ON f.site = j.site"""),
    }

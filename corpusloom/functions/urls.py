"""URL expressions: parts, normal form, resolution, derived names.

They follow the URL standard's rules for http(s), ws(s) and ftp URLs, as plain
column expressions; hosts as `functions/hosts.py` has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hosts import canonical_host
from corpusloom.functions.layout import bound, computed

_SPECIAL = "(?:https?|wss?|ftp)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# C0 controls and space, cut from both ends of a URL.
_EDGE = "".join(map(chr, range(0x21)))
# What stays as it is in each part; the rest is percent-encoded.
_PATH_SAFE = r"!$-;=@-\[\]_a-z|~"
_QUERY_SAFE = r"!$-&(-;=?@-~"
_FRAGMENT_SAFE = r"!#-;=?-_a-~"
_OPAQUE_SAFE = r" -~"
# Hosts may not hold these; a bracketed IPv6 address may.
_HOST_OK = r"^(?:\[[0-9a-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|\x7f\ufffd]+)$"


def clean(url: Column) -> Column:
    """Strip what URL parsing ignores: edge controls, tabs and line ends."""
    return F.translate(F.btrim(url, F.lit(_EDGE)), "\t\n\r", "")


# The `_x` functions below take a cleaned URL.


def _scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def _is_special(u: Column) -> Column:
    return u.rlike(f"(?i)^{_SPECIAL}:")


def _part(u: Column, group: int) -> Column:
    """1 authority, 2 path, 3 query with `?`, 4 fragment with `#`."""
    pattern = rf"(?is)^{_SPECIAL}:[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    return F.regexp_extract(u, pattern, group)


def _host(u: Column) -> Column:
    """Host without user and port in its normal form, NULL if it has none."""
    pattern = rf"(?i)^{_SPECIAL}:[/\\]*(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:]*)"
    return canonical_host(F.lower(F.regexp_extract(u, pattern, 1)))


def _port_text(u: Column) -> Column:
    """What stands behind the host in the authority: '' or `:` and a number."""
    pattern = rf"(?i)^{_SPECIAL}:[/\\]*(?:[^/\\?#]*@)?(?:\[[^\]/\\?#]*\]|[^/\\?#:]*)([^/\\?#]*)"
    return F.regexp_extract(u, pattern, 1)


def _port(u: Column) -> Column:
    """`:port`, or empty when absent or the scheme's own."""
    port, s = F.regexp_extract(_port_text(u), ":0*([0-9]+)$", 1), _scheme(u)
    own = (
        (s.isin("http", "ws") & (port == "80"))
        | (s.isin("https", "wss") & (port == "443"))
        | ((s == "ftp") & (port == "21"))
    )
    shown = F.when((port == "") | own, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(_port_text(u) == "", F.lit("")).otherwise(shown)


def _valid(u: Column, host: Column) -> Column:
    port = _port_text(u)
    digits = F.regexp_extract(port, "^:0*([0-9]*)$", 1)
    small = (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535)
    named = F.coalesce(host.rlike(_HOST_OK), F.lit(False))
    return named & ((port == "") | port.rlike("^:[0-9]*$") & small)


def _root(u: Column, user: Column) -> Column:
    """scheme://user@host:port of a special URL, NULL if it cannot be parsed."""
    start, port = F.concat(_scheme(u), F.lit("://"), user), _port(u)
    return bound(_host(u), lambda h: F.when(_valid(u, h), F.concat(start, h, port)))


def hostname(url: Column) -> Column:
    """Host without port in its normal form; '' for opaque URLs; NULL if unparsable."""
    u = clean(url)
    named = bound(_host(u), lambda h: F.when(_valid(u, h), h))
    return F.when(_is_special(u), named).when(_scheme(u) != "", F.lit(""))


def origin(url: Column) -> Column:
    """scheme://host[:port] of a special URL, else NULL."""
    u = clean(url)
    return F.when(_is_special(u), _root(u, F.lit("")))


def domain(url: Column, unknown: str = "unknown") -> Column:
    """Host without a leading `www.`; `unknown` for what is no URL."""
    return F.coalesce(F.regexp_replace(hostname(url), r"^www\.", ""), F.lit(unknown))


def normal_host(href: Column) -> Column:
    """Host of a URL in normal form; '' for opaque ones."""
    pattern = r"^[a-z0-9+.\-]+://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
    return F.regexp_extract(href, pattern, 1)


def normal_path(href: Column) -> Column:
    """Path of a URL in normal form."""
    return F.regexp_extract(href, r"^[a-z0-9+.\-]+://[^/?#]*([^?#]*)", 1)


def _percent_encode(c: Column, safe: str) -> Column:
    def encode(ch: Column) -> Column:
        escaped = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(f"^[{safe}]$"), ch).otherwise(escaped)

    encoded = F.array_join(F.transform(F.split(c, ""), encode), "")
    return F.when(c.rlike(f"[^{safe}]"), encoded).otherwise(c)


def _fold_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    one, two = r"^(?:\.|%2[eE])$", r"^(?:\.|%2[eE]){2}$"
    segments = F.split(path, "/")

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg.rlike(two), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(seg.rlike(one), done)
            .otherwise(F.array_append(done, seg))
        )

    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"), step
    )
    tail = F.when(path.rlike(r"/(?:\.|%2[eE]){1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"/(?:\.|%2[eE]){1,2}(?:/|$)"), folded).otherwise(path)


def _pathname(u: Column) -> Column:
    raw = F.translate(_part(u, 2), "\\", "/")
    rooted = F.when(raw == "", F.lit("/")).otherwise(raw)
    return _percent_encode(_fold_dots(rooted), _PATH_SAFE)


def pathname(url: Column) -> Column:
    """Normal path of a special URL: `/` separators, folded, percent-encoded."""
    return _pathname(clean(url))


def _href(u: Column) -> Column:
    """Normal form of a cleaned absolute URL, NULL if it cannot be parsed."""
    s = _scheme(u)
    user = F.regexp_extract(_part(u, 1), "^(.*@)", 1)
    special = F.concat(
        _root(u, user),
        _pathname(u),
        _percent_encode(_part(u, 3), _QUERY_SAFE),
        _percent_encode(_part(u, 4), _FRAGMENT_SAFE),
    )
    rest = F.regexp_replace(u, _SCHEME, "")
    opaque = F.concat(s, F.lit(":"), _percent_encode(rest, _OPAQUE_SAFE))
    return F.when(_is_special(u), special).when(s != "", opaque)


def _normal_rest(rest: Column) -> Column:
    """Normal form of `/path?query#fragment`."""
    path = F.translate(F.regexp_extract(rest, "^[^?#]*", 0), "\\", "/")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(rest, r"(?s)(#.*)$", 1)
    return F.concat(
        _percent_encode(_fold_dots(path), _PATH_SAFE),
        F.when(query == "", query).otherwise(_percent_encode(query, _QUERY_SAFE)),
        F.when(fragment == "", fragment).otherwise(_percent_encode(fragment, _FRAGMENT_SAFE)),
    )


def base_parts(base: Column) -> Column:
    """What links need of their page's URL: (scheme, root, path, query), root NULL if unusable."""
    b = clean(base)
    user = F.regexp_extract(_part(b, 1), "^(.*@)", 1)
    return F.struct(
        _scheme(b).alias("scheme"),
        F.when(_is_special(b), _root(b, user)).alias("root"),
        F.when(_part(b, 2) == "", "/").otherwise(_part(b, 2)).alias("path"),
        _part(b, 3).alias("query"),
    )


def resolve_against(df: DataFrame, parts: str, ref: str, out: str) -> DataFrame:
    """Add `out`: `ref` seen from the page whose `base_parts` are in column `parts`."""
    b, r = F.col(parts), F.col("_ref")
    folder = F.regexp_replace(b["path"], r"[^/\\]*$", "")
    rest = (
        F.when(r == "", F.concat(b["path"], b["query"]))
        .when(r.rlike(r"^[/\\]"), r)
        .when(r.startswith("?"), F.concat(b["path"], r))
        .when(r.startswith("#"), F.concat(b["path"], b["query"], r))
        .otherwise(F.concat(folder, r))
    )
    absolute = F.when(r.rlike(_SCHEME), r).when(
        r.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), r)
    )
    # `https:x` seen from an https page is a relative reference.
    given = clean(F.col(ref))
    same = _is_special(given) & (_scheme(given) == b["scheme"]) & ~given.rlike(rf"{_SCHEME}[/\\]")
    df = computed(df, _ref=F.when(same, F.regexp_replace(given, _SCHEME, "")).otherwise(given))
    df = computed(df, _absolute=absolute)
    df = computed(df, _rest=F.when(F.col("_absolute").isNull(), rest))
    url = F.when(
        b["root"].isNotNull(),
        F.when(F.col("_absolute").isNotNull(), _href(F.col("_absolute"))).otherwise(
            F.concat(b["root"], _normal_rest(F.col("_rest")))
        ),
    )
    return computed(df, **{out: url}).drop("_ref", "_absolute", "_rest")


def resolve_links(df: DataFrame, base: str, ref: str, out: str = "url") -> DataFrame:
    """Add `out`: `ref` resolved against `base`; NULL where either is no URL."""
    based = computed(df, _base=base_parts(F.col(base)))
    return resolve_against(based, "_base", ref, out).drop("_base")


def md_candidates(url: Column) -> Column:
    """Ordered Markdown siblings of a page URL."""
    path = pathname(url)
    stem = F.regexp_replace(path, "/$", "")
    by_extension = r"^(.+)\.[A-Za-z0-9]+$"
    plain = F.concat(stem, F.lit(".md"))
    paths = (
        F.when(
            stem.rlike(by_extension),
            F.array(F.concat(F.regexp_extract(stem, by_extension, 1), F.lit(".md")), plain),
        )
        .when(url.endswith("/"), F.array(F.concat(path, F.lit("index.md")), plain))
        .otherwise(F.array(plain, F.concat(stem, F.lit("/index.md"))))
    )
    return bound(
        origin(url),
        lambda root: F.when(root.isNotNull(), F.transform(paths, lambda p: F.concat(root, p))),
    )


def path_title(url: Column) -> Column:
    """Last non-empty path segment, else `index`."""
    segments = F.filter(F.split(pathname(url), "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("index"))

"""Settings per crawl job: overrides, domain settings, defaults, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.layout import computed
from corpusloom.functions.text import js_trim
from corpusloom.functions.urls import domain, origin

# Defaults and the modes a job may ask for.
DEFAULT_CONTENT = "body"
DEFAULT_OUTPUT = "./"
MODES = ["auto", "follow", "single"]

OVERRIDES = {
    "follow_selector": "string",
    "content_selector": "string",
    "output_dir": "string",
    "no_native_md": "boolean",
    "no_manifest": "boolean",
    "with_optional": "boolean",
}


def effective_config(jobs: DataFrame, overrides: DataFrame, site_config: DataFrame) -> DataFrame:
    """Jobs (site, base_url, ...) with their settings: override, else domain, else default.

    Switches go one way: an override can turn native bodies and manifests off and
    optional sections on, not back. Both lookups have one row per key.
    """
    o = overrides.select(
        "site", *[F.col(c).cast(t).alias(f"_o_{c}") for c, t in OVERRIDES.items()]
    )
    c = site_config.select(*[F.col(n).alias(f"_c_{n}") for n in site_config.columns])
    joined = (
        computed(jobs, domain=domain(F.col("base_url"), unknown=""))
        .join(o, "site", "left")
        .join(c, F.col("domain") == F.col("_c_domain"), "left")
    )

    def layered(name: str, default: str | None) -> Column:
        return F.coalesce(F.col(f"_o_{name}"), F.col(f"_c_{name}"), F.lit(default)).alias(name)

    def switched(override: str, turned: bool, name: str, default: bool) -> Column:
        own = F.coalesce(F.col(f"_c_{name}"), F.lit(default))
        return F.when(F.col(f"_o_{override}"), F.lit(turned)).otherwise(own).alias(name)

    return joined.select(
        *jobs.columns,
        "domain",
        F.coalesce(F.col("_o_follow_selector"), F.col("_c_follow_selector")).alias(
            "follow_selector"
        ),
        layered("content_selector", DEFAULT_CONTENT),
        layered("output_dir", DEFAULT_OUTPUT),
        switched("no_native_md", False, "use_native_md", True),
        switched("no_manifest", False, "use_manifest", True),
        switched("with_optional", True, "include_optional", False),
    )


def apply_mode(jobs: DataFrame) -> DataFrame:
    """Make follow_selector and use_manifest agree with `mode`; `error` instead of failing.

    single: neither links nor manifest; follow: no manifest, a selector is a must;
    auto (also NULL): as set. An entry page must have a URL with a host.
    """
    mode = F.coalesce("mode", F.lit("auto"))
    # Settings alone, without entry pages, are fine too.
    url = F.col("base_url") if "base_url" in jobs.columns else F.lit("https://unnamed")
    selector = F.col("follow_selector")
    has_selector = F.coalesce(selector, F.lit("")) != ""
    return jobs.withColumns(
        {
            "mode": mode,
            "follow_selector": F.when(mode == "single", None).otherwise(selector),
            "use_manifest": F.when(mode.isin("single", "follow"), False).otherwise(
                F.coalesce("use_manifest", F.lit(True))
            ),
            "error": F.when(~mode.isin(MODES), F.concat(F.lit("unknown mode: "), mode)).when(
                (mode == "follow") & ~has_selector, "follow mode needs a follow selector"
            ).when(
                origin(url).isNull(), F.concat(F.lit("invalid entry URL: "), F.coalesce(url, F.lit("")))
            ),
        }
    )


def wants_links(selector: Column) -> Column:
    """Whether a follow selector is set and not blank."""
    return F.coalesce(js_trim(selector), F.lit("")) != ""

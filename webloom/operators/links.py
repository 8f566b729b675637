"""Link extraction: pages and stylesheets to internal links."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators.tokens import attribute_values

# Where links are looked for.
NAVIGATION = {"a": ("href",)}
RESOURCES = {
    "img": ("src", "data-src"),
    "script": ("src",),
    "link": ("href",),
    "video": ("src",),
    "audio": ("src",),
    "source": ("src", "data-src"),
}
# Fixed value: a local or remote stylesheet import, quoted and closed by ';'.
CSS_IMPORT = r"""@import\s+(?:url\(\s*)?["']([^"']+)["'](?:\s*\))?;"""


def internal_links(
    pages: DataFrame,
    patterns: Iterable[str] = (),
    domains: Iterable[str] = (),
    tags=None,
    keys: Sequence[str] = ("page_id", "url", "target_domain"),
) -> DataFrame:
    """Every occurrence of a link into the page's own site, in page order; no shuffle."""
    patterns, domains = list(patterns), list(domains)
    found = attribute_values(pages, tags or {**NAVIGATION, **RESOURCES}, keys)
    resolved = pin(
        found.where(U.is_navigable(F.col("raw"))), abs_url=U.resolve(F.col("url"), F.col("raw"))
    )
    kept = resolved.where(~U.is_rejected(F.col("abs_url"), F.col("target_domain"), patterns, domains))
    return kept.withColumn("norm_url", U.strip_fragment(F.col("abs_url")))


def internal_link_set(
    pages: DataFrame, patterns: Iterable[str] = (), domains: Iterable[str] = ()
) -> DataFrame:
    """Distinct internal URLs per page (partial distinct before the shuffle)."""
    return (
        internal_links(pages, patterns, domains)
        .select("page_id", "target_domain", "norm_url")
        .distinct()
    )


def html_edges(
    pages: DataFrame, patterns: Iterable[str] = (), domains: Iterable[str] = ()
) -> DataFrame:
    return (
        internal_links(pages, patterns, domains)
        .select("target_domain", F.col("url").alias("src_url"), F.col("norm_url").alias("dst_url"))
        .distinct()
    )


def css_imports(sheets: DataFrame) -> DataFrame:
    """Local imports of a stylesheet, resolved against its own URL."""
    found = sheets.select(
        "target_domain",
        F.col("url").alias("src_url"),
        F.explode(F.regexp_extract_all("css", F.lit(CSS_IMPORT), F.lit(1))).alias("raw"),
    ).where(~F.col("raw").rlike("^https?://"))
    return pin(found, dst_url=U.resolve(F.col("src_url"), F.col("raw")))


def css_edges(
    sheets: DataFrame, patterns: Iterable[str] = (), domains: Iterable[str] = ()
) -> DataFrame:
    """(target_domain, src_url, dst_url) of stylesheet imports; fragments are kept."""
    rejected = U.is_rejected(
        F.col("dst_url"), F.col("target_domain"), list(patterns), list(domains)
    )
    return css_imports(sheets).where(~rejected).select("target_domain", "src_url", "dst_url").distinct()

"""Media referenced on other hosts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators.tokens import attribute_values

# Every tag is searched for every attribute.
MEDIA_TAGS = {
    tag: ("src", "href", "data-src")
    for tag in ("img", "script", "link", "video", "audio", "source")
}
# Fixed value: remote url() reference of a stylesheet.
CSS_REMOTE_URL = r"""url\(\s*["']?(https?://[^"'\\)]+)["']?\s*\)"""

# Extensions that count as media.
MEDIA_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp",
    ".mp4", ".webm", ".avi", ".mkv", ".mov",
    ".svg", ".ico", ".bmp", ".css", ".js", ".woff2",
)
MEDIA_FOLDER = "images"


def html_media_references(pages: DataFrame) -> DataFrame:
    return attribute_values(pages, MEDIA_TAGS, ("page_id", "target_domain"))


def css_media_references(sheets: DataFrame) -> DataFrame:
    return sheets.select(
        "target_domain",
        F.explode(F.regexp_extract_all("css", F.lit(CSS_REMOTE_URL), F.lit(1))).alias("raw"),
    )


def _external(references: DataFrame, extensions: Iterable[str]) -> DataFrame:
    raw = F.col("raw")
    return references.where(
        raw.rlike("^https?://")
        & (U.host(raw) != F.col("target_domain"))
        & U.is_media(raw, extensions)
    ).select("target_domain", U.strip_query(raw).alias("url"))


def html_media(pages: DataFrame, extensions: Iterable[str] = MEDIA_EXTENSIONS) -> DataFrame:
    return _external(html_media_references(pages), list(extensions)).distinct()


def css_media(sheets: DataFrame, extensions: Iterable[str] = MEDIA_EXTENSIONS) -> DataFrame:
    return _external(css_media_references(sheets), list(extensions)).distinct()


def external_media(
    pages: DataFrame, sheets: DataFrame, extensions: Iterable[str] = MEDIA_EXTENSIONS
) -> DataFrame:
    """Distinct (target_domain, url) over pages and stylesheets, queries stripped."""
    extensions = list(extensions)
    return (
        _external(html_media_references(pages), extensions)
        .unionByName(_external(css_media_references(sheets), extensions))
        .distinct()
    )


def scan_counters(
    pages: DataFrame, sheets: DataFrame, extensions: Iterable[str] = MEDIA_EXTENSIONS
) -> DataFrame:
    """Per site: references seen in HTML and CSS, and distinct media among them."""
    seen = (
        html_media_references(pages)
        .select("target_domain", F.lit(1).alias("html"), F.lit(0).alias("css"), "raw")
        .unionByName(
            css_media_references(sheets).select(
                "target_domain", F.lit(0).alias("html"), F.lit(1).alias("css"), "raw"
            )
        )
    )
    raw = F.col("raw")
    media = (
        raw.rlike("^https?://")
        & (U.host(raw) != F.col("target_domain"))
        & U.is_media(raw, list(extensions))
    )
    # First per (site, media URL), then per site: a large site is counted by many tasks.
    per_url = (
        seen.withColumn("_url", F.when(media, U.strip_query(raw)))
        .groupBy("target_domain", "_url")
        .agg(F.sum("html").alias("html"), F.sum("css").alias("css"))
    )
    return per_url.groupBy("target_domain").agg(
        F.sum("html").alias("html_urls"),
        F.sum("css").alias("css_urls"),
        F.count("_url").alias("unique_media"),
    )


def url_map(media: DataFrame, files: DataFrame, mark_shared: bool = False) -> DataFrame:
    """Media URLs whose file is in the site's media folder: (target_domain, url, filename).

    ``mark_shared`` adds ``shared``, true for a file name that several URLs of the site map to; it
    reads the media set a second time, so give a stored one.
    """
    names = pin(media, filename=U.basename(F.col("url"))).where(F.col("filename") != "")
    present = (
        files.where(F.col("path").rlike(f"^{MEDIA_FOLDER}/[^/]+$"))
        .select("target_domain", F.regexp_extract("path", "[^/]+$", 0).alias("filename"))
        .distinct()
    )
    found = names.join(present, ["target_domain", "filename"])
    found = found.select("target_domain", "url", "filename")
    if not mark_shared:
        return found
    uses = found.groupBy("target_domain", "filename").agg((F.count("*") > 1).alias("shared"))
    return found.join(uses, ["target_domain", "filename"])

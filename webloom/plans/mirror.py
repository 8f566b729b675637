"""The whole treatment of saved sites as one lazily composed plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators import crawl, media, offline, relink, report, stylesheets, validate
from webloom.session import cut_lineage


def with_path(pages: DataFrame) -> DataFrame:
    return pages if "path" in pages.columns else pin(pages, path=U.local_path(F.col("url")))


@dataclass
class Mirror:
    """Validate, collect media, rewrite links, clean, count.

    Every result is a DataFrame that is planned when it is asked for.  A site without external
    media keeps its links and stylesheets (``skip_without_media``).  Internal links are rewritten
    only when the inventory of saved pages is given.
    """

    source: DataFrame
    sheets: DataFrame
    files: DataFrame
    extensions: Sequence[str] = media.MEDIA_EXTENSIONS
    fetch_log: DataFrame | None = None
    page_inventory: DataFrame | None = None
    skip_without_media: bool = True

    def __post_init__(self) -> None:
        self.source = with_path(self.source)

    @cached_property
    def verdict(self) -> DataFrame:
        return validate.site_verdict(validate.check_pages(self.source))

    @cached_property
    def media(self) -> DataFrame:
        """Stored once: the other results use it without reading the pages again."""
        return cut_lineage(media.external_media(self.source, self.sheets, self.extensions))

    @cached_property
    def url_map(self) -> DataFrame:
        return media.url_map(self.media, self.files)

    def _in_media_sites(self, rows: DataFrame, how: str) -> DataFrame:
        """Rows of sites with (left_semi) or without (left_anti) media."""
        sites = self.media.select("target_domain").distinct()
        return rows.join(sites, "target_domain", how)

    @cached_property
    def pages(self) -> DataFrame:
        cors_pages = None
        if self.skip_without_media:
            keys = self.source.select("page_id", "target_domain")
            cors_pages = self._in_media_sites(keys, "left_semi")
        linked = relink.relink(self.source, self.url_map, self.page_inventory, cors_pages)
        cleaned = offline.clean_pages(
            linked.withColumnsRenamed(
                {"html": "_original", "new_html": "html", "changed": "_relinked"}
            )
        )
        return cleaned.select(
            *[
                F.col("_original").alias("html") if c == "html" else F.col(c)
                for c in self.source.columns
            ],
            "new_html",
            "removed",
            (F.col("_relinked") | F.col("changed")).alias("changed"),
        )

    @cached_property
    def stylesheets(self) -> DataFrame:
        if not self.skip_without_media:
            return stylesheets.rewrite_stylesheets(self.sheets, self.url_map)
        treated = self._in_media_sites(self.sheets, "left_semi")
        untreated = self._in_media_sites(self.sheets, "left_anti").withColumns(
            {"new_css": F.col("css"), "steps_applied": F.lit(0)}
        )
        return stylesheets.rewrite_stylesheets(treated, self.url_map).unionByName(
            untreated, allowMissingColumns=True
        )

    @cached_property
    def totals(self) -> DataFrame:
        def sized(rows: DataFrame, text: str) -> DataFrame:
            return rows.select("target_domain", "path", F.octet_length(text).alias("length"))

        stored = (
            sized(self.source, "html")
            .unionByName(sized(self.sheets, "css"))
            .unionByName(self.files.select("target_domain", "path", "length"))
        )
        return report.site_totals(stored, self.fetch_log)


@dataclass
class Resumed:
    """Find what a broken-off crawl still needs, and process what is there."""

    source: DataFrame
    sheets: DataFrame
    files: DataFrame
    seeds: DataFrame
    max_depth: int = 0
    patterns: Sequence[str] = ()
    domains: Sequence[str] = ()

    def __post_init__(self) -> None:
        self.source = with_path(self.source)

    @cached_property
    def stored(self) -> DataFrame:
        return self.source.select("target_domain", "path").unionByName(
            self.sheets.select("target_domain", "path")
        )

    @cached_property
    def status(self) -> DataFrame:
        edges = crawl.crawl_edges(self.source, self.sheets, self.patterns, self.domains)
        return crawl.with_status(crawl.reachable(edges, self.seeds, self.max_depth), self.stored)

    @cached_property
    def missing(self) -> DataFrame:
        return self.status.where(F.col("status") == "missing")

    @cached_property
    def mirror(self) -> Mirror:
        return Mirror(self.source, self.sheets, self.files, page_inventory=self.stored)

"""Every registered query: a function of (spark, sf_dir) over the whole given tables."""

from __future__ import annotations

import uuid
from functools import reduce, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from checks.site_fixture import (
    NESTED,
    PAGES,
    built,
    derived,
    numbered_links,
    raw_pages,
    site_pages,
    site_rules,
    site_sheets,
    wide_rules,
)
from webloom.functions import html as H
from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators import (
    crawl,
    links,
    media,
    offline,
    ranges,
    relink,
    report,
    rewrite,
    rule_index,
    rules,
    stylesheets,
    tokens,
    validate,
)
from webloom.plans import mirror
from webloom.session import cut_lineage, shared_folder
from webloom.sources import files as file_tables
from webloom.sources import folders, settings
from webloom.streaming import jobs

PATTERNS = ("action=", "Special:", "sort=", "f=[0-9]+&")
DOMAINS = ("analytics.", "matomo.")
MAX_DEPTH = 4

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- derived inputs -------------------------------------------------------------------------


_PLANS: dict = {}


def shared(function):
    """Build the plan of a derived input once per session; the data is not kept."""

    @wraps(function)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, function.__name__, sf_dir)
        if key not in _PLANS:
            _PLANS[key] = function(spark, sf_dir)
        return _PLANS[key]

    return plan


raw_pages, site_pages, site_sheets = shared(raw_pages), shared(site_pages), shared(site_sheets)


@shared
def hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pages with their own host as site."""
    return raw_pages(spark, sf_dir).withColumn("target_domain", U.host(F.col("url")))


@shared
def pages_with_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirror.with_path(site_pages(spark, sf_dir))


@shared
def media_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.external_media(site_pages(spark, sf_dir), site_sheets(spark, sf_dir))


@shared
def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the media that 'arrived': two thirds of the media set."""
    arrived = media_set(spark, sf_dir).where(F.length("url") % 3 != 0)
    return arrived.groupBy(
        "target_domain", F.concat(F.lit("images/"), U.basename(F.col("url"))).alias("path")
    ).agg(F.max(F.length("url") * 1000).cast("bigint").alias("length"))


@shared
def mapped_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.url_map(media_set(spark, sf_dir), media_files(spark, sf_dir))


@shared
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages (one in ten is missing) and all stylesheets."""
    pages = pages_with_path(spark, sf_dir).where(F.col("page_id") % 10 != 7)
    sheets = site_sheets(spark, sf_dir)
    return pages.select(
        "target_domain", "path", F.octet_length("html").cast("bigint").alias("length")
    ).unionByName(
        sheets.select("target_domain", "path", F.octet_length("css").cast("bigint").alias("length"))
    )


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every saved page and stylesheet, and the media that arrived."""
    parts = [
        pages_with_path(spark, sf_dir).select("target_domain", "path", F.octet_length("html").alias("length")),
        site_sheets(spark, sf_dir).select("target_domain", "path", F.octet_length("css").alias("length")),
        media_files(spark, sf_dir),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("length", F.col("length").cast("bigint"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every site."""
    first = F.min_by("url", "page_id").alias("url")
    return site_pages(spark, sf_dir).groupBy("target_domain").agg(first)


@shared
def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_edges(
        site_pages(spark, sf_dir), site_sheets(spark, sf_dir), PATTERNS, DOMAINS
    )


def reached(spark: SparkSession, sf_dir: str, max_depth: int = 0) -> DataFrame:
    return crawl.reachable(site_edges(spark, sf_dir), seeds(spark, sf_dir), max_depth)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_set(spark, sf_dir).withColumn("status", F.length("url") % 6)


@shared
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct link value of a page with its resolved form."""
    tags = {**links.NAVIGATION, **links.RESOURCES}
    values = tokens.attribute_values(
        site_pages(spark, sf_dir), tags, ("page_id", "url", "target_domain")
    )
    distinct_values = values.select("page_id", "url", "target_domain", "raw").distinct()
    return pin(distinct_values, abs_url=U.resolve(F.col("url"), F.col("raw")))


# --- scans and sinks ------------------------------------------------------------------------


@query
def page_scan(spark, sf_dir):
    return (
        hosted(spark, sf_dir)
        .where(F.length("html") > 0)
        .select("page_id", "url", "target_domain", "html")
    )


@query
def stylesheet_scan(spark, sf_dir):
    return site_sheets(spark, sf_dir).where(F.length("css") > 0)


@query
def token_table(spark, sf_dir):
    return tokens.token_table(raw_pages(spark, sf_dir))


@query
def token_round_trip(spark, sf_dir):
    """Tokens put together again, compared with the page."""
    pages = raw_pages(spark, sf_dir)
    joined = (
        tokens.token_table(pages)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
        .select("page_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("joined"))
    )
    same = F.coalesce("joined", F.lit("")) == F.coalesce("html", F.lit(""))
    return pages.join(joined, "page_id", "left").select("page_id", same.alias("same"))


@query
def changed_pages(spark, sf_dir):
    done = site_pages(spark, sf_dir).withColumn(
        "new_html", offline.add_fallback_style(F.col("html"))
    )
    return file_tables.changed_only(done, "html", "new_html").select("page_id", "new_html")


@query
def failure_numbers(spark, sf_dir):
    failed = rewrite.failure_rows(guarded(spark, sf_dir), ["page_id"])
    return rewrite.numbered_failures(failed, ["page_id"], last_number=7).select(
        "number", "page_id", "step", "error"
    )


def _folder(spark: SparkSession, rows: DataFrame, column: str) -> str:
    """Texts as files at their paths below the shared folder."""
    folder = f"{shared_folder(spark)}/sites/{uuid.uuid4().hex}"
    folders.write_texts(rows, column, folder)
    return folder


def _page_folder(spark: SparkSession, sf_dir: str) -> str:
    """The given pages as files, dealt into a few folders, one of them within another."""
    place = F.concat(F.lit("d"), F.col("page_id") % 23, F.when(F.col("page_id") % 2 == 0, "/_e").otherwise(""))
    path = F.concat(place, F.lit("/p"), "page_id", F.when(F.col("page_id") % 3 == 0, ".htm").otherwise(".html"))
    return _folder(spark, raw_pages(spark, sf_dir).select(path.alias("path"), "html"), "html")


def _page_of(path: str) -> Column:
    return F.regexp_extract(path, "p([0-9]+)\\.html?$", 1).cast("bigint").alias("page_id")


@query
def folder_pages(spark, sf_dir):
    """Files scanned as pages."""
    found = file_tables.read_pages(spark, _page_folder(spark, sf_dir), "example.org")
    return found.select(_page_of("path"), "html")


@query
def folder_inventory(spark, sf_dir):
    return file_tables.inventory(spark, _page_folder(spark, sf_dir), "*.{html,htm}").select(
        _page_of("path"), "length"
    )


def _sheet_folder(spark: SparkSession, sf_dir: str) -> str:
    """Stylesheets of all sites as files, each site in a folder; some are empty."""
    rows = site_sheets(spark, sf_dir).select(
        F.concat("target_domain", F.lit("/"), "path").alias("path"),
        F.when(F.length("css") % 11 == 0, "").otherwise(F.col("css")).alias("css"),
    )
    return _folder(spark, rows, "css")


@query
def folder_stylesheets(spark, sf_dir):
    """The stylesheet scan of one folder that holds all sites, empty files among them."""
    found = file_tables.read_stylesheets(spark, _sheet_folder(spark, sf_dir), "example.org")
    return found.select("path", "url", "css")


@query
def written_back(spark, sf_dir):
    """Cleaned pages written over the files they came from, and the whole folder read again."""
    pages = pages_with_path(spark, sf_dir).withColumn("path", F.concat_ws("/", "target_domain", F.col("page_id") % 7, _file_name()))
    folder = _folder(spark, pages, "html")
    cleaned = offline.clean_pages(pages)
    file_tables.write_back(cleaned, "html", "new_html", folder)
    found = file_tables.texts(spark, folder, "*.html", "new_html")
    return found.select(_page_of("path"), "new_html")


def _file_name() -> Column:
    return F.concat(F.lit("p"), "page_id", F.lit(".html"))


@query
def failed_url_file(spark, sf_dir):
    """The list of failed URLs as a text file, read back."""
    folder = f"{shared_folder(spark)}/failed/{uuid.uuid4().hex}"
    file_tables.write_url_list(report.failed_urls(fetch_log(spark, sf_dir)), folder)
    return spark.read.text(folder).select(F.col("value").alias("url"))


@query
def loaded_settings(spark, sf_dir):
    """Settings with limits and rules taken from the pages, written as a file and loaded."""
    folder = f"{shared_folder(spark)}/settings/{uuid.uuid4().hex}"
    values = F.struct(
        (F.count("*") % 50 + 1).alias("Timeout"),
        (F.max("page_id") % 7).alias("MaxDepth"),
        F.array(F.max("url"), F.lit("action=")).alias("RejectPatterns"),
        F.lit(1).alias("_Note"),
    )
    raw_pages(spark, sf_dir).agg(F.to_json(values).alias("value")).write.text(folder)
    return settings.load_settings(spark, folder).select(
        "timeout", "max_depth", "retries", F.array_join("reject_patterns", " ").alias("patterns")
    )


@query
def media_inventory(spark, sf_dir):
    return media_files(spark, sf_dir)


@query
def output_inventory(spark, sf_dir):
    return all_files(spark, sf_dir)


# --- URL functions --------------------------------------------------------------------------


@query
def default_scheme(spark, sf_dir):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(
        F.col("url")
    )
    return raw_pages(spark, sf_dir).select(
        "page_id", U.with_default_scheme(bare).alias("full_url")
    )


@query
def host_names(spark, sf_dir):
    """Hosts of addresses with capitals, user and port."""
    noisy = F.concat(
        F.regexp_extract("url", "^[a-z]+://", 0),
        F.lit("user:pw@"),
        F.upper(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)),
        F.lit(":8080"),
        F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1),
    )
    return raw_pages(spark, sf_dir).select(
        "page_id", U.host(F.col("url")).alias("host"), U.host(noisy).alias("noisy_host")
    )


@query
def reference_filter(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id",
        "raw",
        U.is_navigable(F.col("raw")).alias("navigable"),
        U.is_http(F.col("abs_url")).alias("http"),
    )


@query
def resolved_links(spark, sf_dir):
    return references(spark, sf_dir).select("page_id", "raw", "abs_url")


@query
def stripped_urls(spark, sf_dir):
    url = F.col("url")
    return raw_pages(spark, sf_dir).select(
        "page_id",
        U.strip_fragment(url).alias("no_fragment"),
        U.strip_query(url).alias("no_query"),
    )


@query
def pattern_rejects(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id", "raw", U.any_pattern(F.col("abs_url"), PATTERNS).alias("rejected")
    )


@query
def domain_rejects(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id", "raw", U.any_substring(U.host(F.col("abs_url")), DOMAINS).alias("rejected")
    )


@query
def same_host(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id", "raw", (U.host(F.col("abs_url")) == F.col("target_domain")).alias("internal")
    )


@query
def reject_reasons(spark, sf_dir):
    reason = U.reject_reason(F.col("abs_url"), F.col("target_domain"), PATTERNS, DOMAINS)
    return (
        references(spark, sf_dir)
        .groupBy("target_domain", F.coalesce(reason, F.lit("kept")).alias("reason"))
        .agg(F.count("*").alias("refs"))
    )


@query
def file_paths(spark, sf_dir):
    path = U.file_path(F.col("url"))
    both = raw_pages(spark, sf_dir).select("url").union(site_pages(spark, sf_dir).select("url"))
    return both.select(
        "url",
        path.alias("file_path"),
        U.save_path(path).alias("save_path"),
        U.depth(path).cast("bigint").alias("depth"),
    )


@query
def relative_paths(spark, sf_dir):
    """Path of every page as seen from the site's stylesheet folder and from a deep folder."""
    path = F.col("path")
    return pages_with_path(spark, sf_dir).select(
        "page_id",
        U.relative_path(path, F.lit("s/a.css")).alias("from_sheets"),
        U.relative_path(path, F.concat(path, F.lit("/d/e/x.html"))).alias("from_below"),
        U.relative_path(path, path).alias("from_itself"),
    )


@query
def media_urls(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id", "raw", U.is_media(F.col("abs_url"), media.MEDIA_EXTENSIONS).alias("media")
    )


@query
def base_names(spark, sf_dir):
    return references(spark, sf_dir).select(
        "page_id", "raw", U.basename(F.col("abs_url")).alias("basename")
    )


@query
def decoded_attributes(spark, sf_dir):
    return tokens.attribute_values(site_pages(spark, sf_dir), links.NAVIGATION).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "raw"
    )


# --- rules ----------------------------------------------------------------------------------


def range_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range expression per page; some without values, some that are no ranges."""
    n = F.col("page_id")
    block = (
        F.when(n % 11 == 0, F.concat(n % 7 + 5, F.lit(".."), n % 3))
        .when(n % 13 == 0, F.concat(n % 7 + 5, F.lit(".."), n % 3, F.lit("..-2")))
        .when(n % 17 == 0, F.lit("x..y"))
        .when(n % 5 == 0, F.concat(n % 7, F.lit(".."), n % 7 + n % 20, F.lit("..3")))
        .when(n % 2 == 0, F.concat(n % 7, F.lit(".."), n % 7 + n % 20, F.lit("%3, 5,9")))
        .otherwise(F.concat(n % 7, F.lit(".."), n % 7 + n % 20))
    )
    return raw_pages(spark, sf_dir).select("page_id", block.alias("block"))


@query
def range_values(spark, sf_dir):
    return range_patterns(spark, sf_dir).select(
        "page_id", F.explode(rules.range_values(F.col("block"))).alias("value")
    )


@query
def range_checks(spark, sf_dir):
    return range_patterns(spark, sf_dir).select(
        "page_id", rules.is_range(F.col("block")).alias("valid")
    )


@query
def expanded_patterns(spark, sf_dir):
    """Patterns with two blocks: the second one varies slowest."""
    pattern = F.concat(
        F.lit("f={"), F.col("block"), F.lit("}&p={1.."), F.col("page_id") % 3 + 1, F.lit("}&")
    )
    return (
        range_patterns(spark, sf_dir)
        .select("page_id", F.posexplode(rules.expanded(pattern)).alias("n", "pattern"))
        .withColumn("n", F.col("n").cast("bigint"))
    )


@query
def rule_lists(spark, sf_dir):
    text = F.concat_ws(" ; ", F.col("url"), F.lit(""), F.lit("a=b"), F.col("target_domain"), F.lit(" "))
    return (
        hosted(spark, sf_dir)
        .select("page_id", F.posexplode(rules.listed(text)).alias("n", "entry"))
        .withColumn("n", F.col("n").cast("bigint"))
    )


@query
def merged_settings(spark, sf_dir):
    """Settings per site with overrides."""
    per_site = site_pages(spark, sf_dir).groupBy("target_domain").agg(
        F.lit(2).alias("parallel_downloads"),
        (F.count("*") % 5).cast("int").alias("max_depth"),
        F.lit(0.5).alias("wait_between_requests"),
        F.array(F.lit("action="), F.max("url")).alias("reject_patterns"),
    )
    merged = rules.merge_overrides(
        per_site, parallel=8, depth=0, wait=0, extra_reject=["f={1..3}&; Special:", " ;"]
    )
    return merged.withColumn("reject_patterns", F.array_join("reject_patterns", "|"))


@query
def whole_url_rejects(spark, sf_dir):
    """The combined expression: domain rules match anywhere in the URL."""
    pattern = U.combined_reject_regex(PATTERNS, DOMAINS)
    return references(spark, sf_dir).select(
        "page_id", "raw", F.col("abs_url").rlike(pattern).alias("rejected")
    )


# --- extraction -----------------------------------------------------------------------------


@query
def navigation_links(spark, sf_dir):
    return links.internal_links(
        site_pages(spark, sf_dir), PATTERNS, DOMAINS, tags=links.NAVIGATION
    ).select("page_id", F.col("pos").cast("bigint").alias("pos"), "tag", "attr", "raw", "norm_url")


@query
def resource_links(spark, sf_dir):
    return links.internal_links(
        site_pages(spark, sf_dir), PATTERNS, DOMAINS, tags=links.RESOURCES
    ).select("page_id", F.col("pos").cast("bigint").alias("pos"), "tag", "attr", "raw", "norm_url")


@query
def internal_link_set(spark, sf_dir):
    return links.internal_link_set(hosted(spark, sf_dir), PATTERNS, DOMAINS)


@query
def links_per_host(spark, sf_dir):
    found = links.internal_link_set(hosted(spark, sf_dir), PATTERNS, DOMAINS)
    distinct_urls = found.groupBy("target_domain", "norm_url").agg(F.count("*").alias("pages"))
    return distinct_urls.groupBy("target_domain").agg(
        F.count("*").alias("urls"), F.sum("pages").alias("links")
    )


@query
def html_edges(spark, sf_dir):
    return links.html_edges(site_pages(spark, sf_dir), PATTERNS, DOMAINS)


@query
def css_imports(spark, sf_dir):
    return links.css_edges(site_sheets(spark, sf_dir), PATTERNS, DOMAINS)


@query
def html_media(spark, sf_dir):
    return media.html_media(site_pages(spark, sf_dir))


@query
def css_media(spark, sf_dir):
    return media.css_media(site_sheets(spark, sf_dir))


@query
def external_media(spark, sf_dir):
    return media_set(spark, sf_dir)


@query
def scan_counters(spark, sf_dir):
    return media.scan_counters(site_pages(spark, sf_dir), site_sheets(spark, sf_dir))


@query
def page_addresses(spark, sf_dir):
    return pages_with_path(spark, sf_dir).select(
        "page_id", U.page_address(F.col("target_domain"), F.col("path")).alias("address")
    )


# --- crawl graph ----------------------------------------------------------------------------


@query
def reachable_within(spark, sf_dir):
    return reached(spark, sf_dir, MAX_DEPTH)


@query
def reachable_all(spark, sf_dir):
    return reached(spark, sf_dir).drop("processed")


@query
def cached_urls(spark, sf_dir):
    return crawl.cached_urls(_linked_urls(spark, sf_dir), stored_files(spark, sf_dir))


@query
def missing_urls(spark, sf_dir):
    return crawl.missing_urls(_linked_urls(spark, sf_dir), stored_files(spark, sf_dir))


@query
def rule_table_rejects(spark, sf_dir):
    """The first of thousands of rules of its site that each linked URL falls under; -1 if none."""
    found = rule_index.first_rule(_linked_urls(spark, sf_dir), site_rules(spark, sf_dir))
    return found.withColumn("rule", F.coalesce("rule", F.lit(-1)))


@query
def wide_range_rejects(spark, sf_dir):
    """Ranges of a million and a thousand values in one rule: each is one expression."""
    links_, wide = numbered_links(spark, sf_dir), ranges.compacted(wide_rules(spark, sf_dir))
    found = rule_index.first_rule(links_, wide).withColumn("rule", F.coalesce("rule", F.lit(-1)))
    return links_.join(found, ["target_domain", "url"]).select("page_id", "url", "rule")


def _linked_urls(spark, sf_dir):
    return site_edges(spark, sf_dir).select("target_domain", F.col("dst_url").alias("url")).distinct()


@query
def crawl_edges(spark, sf_dir):
    return site_edges(spark, sf_dir)


@query
def edges_of_available(spark, sf_dir):
    available = site_pages(spark, sf_dir).where(F.col("page_id") % 10 != 7)
    return crawl.edges_of_available(site_edges(spark, sf_dir), available)


@query
def crawl_stats(spark, sf_dir):
    status = crawl.with_status(reached(spark, sf_dir, MAX_DEPTH), stored_files(spark, sf_dir))
    return crawl.crawl_stats(status, with_total=True)


@query
def resume_list(spark, sf_dir):
    """Reachable within the depth and not on disk."""
    status = crawl.with_status(reached(spark, sf_dir, MAX_DEPTH), stored_files(spark, sf_dir))
    return status.where(F.col("status") == "missing").select("target_domain", "url", "depth", "path")


@query
def politeness_schedule(spark, sf_dir):
    """A request waits for the one before it; only what is missing is asked for."""
    return crawl.politeness_schedule(resume_list(spark, sf_dir), wait_ms=3000).select(
        "target_domain", "url", "depth", "start_ms"
    )


@query
def crawl_figures(spark, sf_dir):
    found = cut_lineage(reached(spark, sf_dir, MAX_DEPTH))
    log = found.select("target_domain", "url", (F.length("url") % 6).alias("status"))
    log = log.where(F.length("url") % 5 != 0)
    return crawl.crawl_figures(found, stored_files(spark, sf_dir), log)


@query
def resume_plan(spark, sf_dir):
    """What the plan of a resumed run still has to fetch."""
    plan = mirror.Resumed(
        pages_with_path(spark, sf_dir).where(F.col("page_id") % 10 != 7),
        site_sheets(spark, sf_dir),
        media_files(spark, sf_dir),
        seeds(spark, sf_dir),
        MAX_DEPTH,
        PATTERNS,
        DOMAINS,
    )
    return plan.missing.select("target_domain", "url", "depth", "path")


@query
def download_batches(spark, sf_dir):
    return crawl.download_batches(media_set(spark, sf_dir), parallel=4)


# --- link rewriting -------------------------------------------------------------------------


@query
def url_map(spark, sf_dir):
    stored = cut_lineage(media_set(spark, sf_dir))
    return media.url_map(stored, media_files(spark, sf_dir), mark_shared=True)


@query
def relinked_external(spark, sf_dir):
    done = relink.relink_external(pages_with_path(spark, sf_dir), mapped_media(spark, sf_dir))
    return done.select("page_id", "new_html", "changed")


@query
def without_cors(spark, sf_dir):
    return site_pages(spark, sf_dir).select(
        "page_id", H.map_items(F.col("html"), H.ITEM, relink.without_cors).alias("new_html")
    )


@query
def relinked_internal(spark, sf_dir):
    done = relink.relink_internal(pages_with_path(spark, sf_dir), stored_files(spark, sf_dir))
    return done.select("page_id", "new_html", "changed")


@query
def relinked_pages(spark, sf_dir):
    done = relink.relink(
        pages_with_path(spark, sf_dir), mapped_media(spark, sf_dir), stored_files(spark, sf_dir)
    )
    return done.select("page_id", "new_html", "changed")


@query
def modified_pages(spark, sf_dir):
    done = relink.relink_internal(pages_with_path(spark, sf_dir), stored_files(spark, sf_dir))
    return relink.modified_pages(done)


# --- stylesheets ----------------------------------------------------------------------------


@query
def inlined_stylesheets(spark, sf_dir):
    return stylesheets.inline_imports(site_sheets(spark, sf_dir)).select(
        "target_domain", "path", "inlined", "n_inlined"
    )


@query
def google_fonts(spark, sf_dir):
    done = stylesheets.inline_imports(site_sheets(spark, sf_dir))
    return done.select(
        "target_domain", "path", stylesheets.strip_google_fonts(F.col("inlined")).alias("new_css")
    )


@query
def localized_stylesheets(spark, sf_dir):
    done = stylesheets.localize(
        site_sheets(spark, sf_dir), mapped_media(spark, sf_dir), "css", "new_css"
    )
    return done.select("target_domain", "path", "new_css")


@query
def neutral_stylesheets(spark, sf_dir):
    return site_sheets(spark, sf_dir).select(
        "target_domain", "path", stylesheets.neutralize_remote(F.col("css")).alias("new_css")
    )


@query
def relative_stylesheets(spark, sf_dir):
    new = stylesheets.absolute_to_relative(F.col("css"), U.up_prefix(F.col("path")))
    return site_sheets(spark, sf_dir).select("target_domain", "path", new.alias("new_css"))


def _rewritten_sheets(spark, sf_dir):
    return stylesheets.rewrite_stylesheets(site_sheets(spark, sf_dir), mapped_media(spark, sf_dir))


@query
def rewritten_stylesheets(spark, sf_dir):
    return _rewritten_sheets(spark, sf_dir).select(
        "target_domain", "path", "new_css", "steps_applied"
    )


@query
def stylesheet_counts(spark, sf_dir):
    return stylesheets.stylesheet_counts(_rewritten_sheets(spark, sf_dir))


# --- offline cleaning -----------------------------------------------------------------------


@query
def removal_candidates(spark, sf_dir):
    return offline.removal_candidates(site_pages(spark, sf_dir)).select(
        "page_id", "rule_no", "element"
    )


@query
def removed_elements(spark, sf_dir):
    return offline.remove_elements(site_pages(spark, sf_dir)).select(
        "page_id", "new_html", "removed"
    )


@query
def nested_removal(spark, sf_dir):
    """Elements inside elements of the same name, unclosed ones and stray end tags among them."""
    pages = built(derived(spark, raw_pages(spark, sf_dir), NESTED))
    rules = [r for r in offline.REMOVAL_RULES if r.tag == "noscript"]
    return offline.remove_elements(pages, rules=rules).select("page_id", "new_html", "removed")


@query
def fallback_style(spark, sf_dir):
    return site_pages(spark, sf_dir).select(
        "page_id", offline.add_fallback_style(F.col("html")).alias("new_html")
    )


@query
def cleaned_scripts(spark, sf_dir):
    return site_pages(spark, sf_dir).select(
        "page_id", offline.clean_scripts(F.col("html")).alias("new_html")
    )


@query
def cleaned_pages(spark, sf_dir):
    return offline.clean_pages(site_pages(spark, sf_dir)).select(
        "page_id", "new_html", "removed", "changed"
    )


@query
def cleaned_counts(spark, sf_dir):
    return (
        offline.clean_pages(site_pages(spark, sf_dir))
        .groupBy("target_domain")
        .agg(F.count_if("changed").alias("modified"), F.sum("removed").alias("removed"))
    )


# --- validation -----------------------------------------------------------------------------


def _checked(spark, sf_dir):
    return validate.check_pages(pages_with_path(spark, sf_dir))


@query
def page_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("page_id", *validate.ISSUES, "valid")


@query
def raw_page_checks(spark, sf_dir):
    return validate.check_pages(raw_pages(spark, sf_dir)).select(
        "page_id", *validate.ISSUES, "valid"
    )


@query
def site_verdict(spark, sf_dir):
    return validate.site_verdict(_checked(spark, sf_dir))


@query
def issue_files(spark, sf_dir):
    return validate.issue_rows(_checked(spark, sf_dir))


@query
def issue_preview(spark, sf_dir):
    return validate.issue_preview(validate.issue_rows(_checked(spark, sf_dir)))


# --- guarded rewriting ----------------------------------------------------------------------


@F.pandas_udf(StringType())
def _squeeze_blanks(text: pd.Series) -> pd.Series:
    return text.str.replace(r" {2,}", " ", regex=True)


STEPS = (
    rewrite.RewriteStep("drop head end", r"(?i)</head\s*>"),
    rewrite.RewriteStep("local images", r"https://img\.example\.org", "img"),
    rewrite.RewriteStep("drop body", r"(?i)</?body[^>]*>"),
    rewrite.RewriteStep("plain copyright", lambda c: F.replace(c, F.lit("&copy;"), F.lit("(c)"))),
)


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.run_steps(site_pages(spark, sf_dir), "html", STEPS, rewrite.html_error)


@query
def guarded_rewrite(spark, sf_dir):
    return guarded(spark, sf_dir).select("page_id", "new_text", "steps_applied")


@query
def rewrite_failures(spark, sf_dir):
    return rewrite.failure_rows(guarded(spark, sf_dir), ["page_id"]).select(
        "page_id", "step", "error", "content"
    )


@query
def guarded_stylesheets(spark, sf_dir):
    steps = (
        rewrite.RewriteStep("no headings", r"h[1-4]\{[^}]*\}"),
        rewrite.RewriteStep("drop everything", r"(?s)^.*$"),
    )
    return rewrite.run_steps(site_sheets(spark, sf_dir), "css", steps, rewrite.css_error).select(
        "target_domain", "path", "new_text", "steps_applied", F.size("failures").alias("failed")
    )


@query
def user_function_step(spark, sf_dir):
    """A step given as Python code, run on Arrow batches."""
    steps = (rewrite.RewriteStep("squeeze blanks", _squeeze_blanks),)
    spaced = site_pages(spark, sf_dir).withColumn(
        "html", F.replace("html", F.lit(". "), F.lit(".   "))
    )
    return rewrite.run_steps(spaced, "html", steps, rewrite.html_error).select(
        "page_id", "new_text", "steps_applied"
    )


# --- report ---------------------------------------------------------------------------------


@query
def site_totals(spark, sf_dir):
    return report.site_totals(all_files(spark, sf_dir), fetch_log(spark, sf_dir))


@query
def failed_urls(spark, sf_dir):
    return report.failed_urls(fetch_log(spark, sf_dir)).select("target_domain", "url")


def _arrival(pages: DataFrame) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)


@query
def site_durations(spark, sf_dir):
    seen = site_pages(spark, sf_dir).withColumn("ts", _arrival(None))
    spans = seen.groupBy("target_domain").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    took = report.duration(F.col("a"), F.col("b"))
    seconds = took.cast("interval second").cast("decimal(18,6)").cast("bigint")
    return spans.select("target_domain", seconds.alias("seconds"))


# --- whole plans ----------------------------------------------------------------------------


def _mirror(spark, sf_dir, **options):
    return mirror.Mirror(
        pages_with_path(spark, sf_dir),
        site_sheets(spark, sf_dir),
        media_files(spark, sf_dir),
        fetch_log=fetch_log(spark, sf_dir),
        **options,
    )


@query
def mirrored_pages(spark, sf_dir):
    return _mirror(spark, sf_dir).pages.select("page_id", "new_html", "removed", "changed")


@query
def mirrored_totals(spark, sf_dir):
    return _mirror(spark, sf_dir).totals


@query
def resumed_pages(spark, sf_dir):
    """After a broken-off crawl: internal links of the pages that are there become local."""
    done = _mirror(spark, sf_dir, page_inventory=stored_files(spark, sf_dir))
    return done.pages.select("page_id", "new_html", "removed", "changed")


def _partly_without_media(spark, sf_dir):
    """Only images named '..7.png' count as media, so that some sites have none."""
    return _mirror(spark, sf_dir, extensions=("7.png",))


@query
def early_exit_pages(spark, sf_dir):
    """Pages of sites without external media keep their links and CORS attributes."""
    done = _partly_without_media(spark, sf_dir)
    return done.pages.select("page_id", "new_html", "removed", "changed")


@query
def early_exit_stylesheets(spark, sf_dir):
    done = _partly_without_media(spark, sf_dir)
    return done.stylesheets.select("target_domain", "path", "new_css", "steps_applied")


# --- streams --------------------------------------------------------------------------------


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived site pages arriving as a stream, one a minute; the table is one file or a folder of files.

    A stream takes the path of a file for that of a folder, but not if it is a pattern.
    """
    schema = raw_pages(spark, sf_dir).schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages.parque[t]")
    return built(derived(spark, arriving, PAGES)).withColumn("ts", _arrival(None))


def _stream_folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query
def stream_issue_counts(spark, sf_dir):
    out, state = _stream_folders(spark)
    counts = jobs.issue_counts(page_stream(spark, sf_dir))
    jobs.start_counts(counts, out, state).awaitTermination()
    return jobs.current_counts(spark, out)


@query
def stream_page_verdicts(spark, sf_dir):
    out, state = _stream_folders(spark)
    jobs.start_append(jobs.page_verdicts(page_stream(spark, sf_dir)), out, state).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_missing_urls(spark, sf_dir):
    inventory = stored_files(spark, sf_dir)
    out, state = _stream_folders(spark)
    found = jobs.discovered_urls(page_stream(spark, sf_dir), PATTERNS, DOMAINS, late=None)
    jobs.start_missing_urls(found, inventory, out, state).awaitTermination()
    return spark.read.parquet(out).select("target_domain", "url", "path")

"""Page validation: one narrow pass over the pages, then counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.binding import pin
from webloom.session import cut_lineage

# Names of the issues and the limits of a readable body and of a preview.
ISSUES = ("missing_head", "missing_body", "empty_body", "has_binary_content")
MIN_BODY_TEXT = 5
PREVIEW = 5

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_HEAD = r"(?i)<head[^>]*>"
_BODY = r"(?i)<body[^>]*>"


def body_text(text: Column) -> Column:
    return H.visible_text(F.regexp_extract(text, rf"(?is)<body[^>]*>(.*)\z", 1))


def check_pages(pages: DataFrame) -> DataFrame:
    """Add one flag per issue and ``valid``; an empty text is invalid without any issue."""
    text = F.col("html")
    filled = F.coalesce(text, F.lit("")) != ""
    has_body = text.rlike(_BODY)
    return pin(
        pages,
        **{
            "missing_head": filled & ~text.rlike(_HEAD),
            "missing_body": filled & ~has_body,
            "empty_body": filled & has_body & (F.length(body_text(text)) < MIN_BODY_TEXT),
            "has_binary_content": filled & text.rlike(_CONTROL),
        },
    ).withColumn(
        "valid",
        filled & ~(F.col("missing_head") | F.col("missing_body"))
        & ~(F.col("empty_body") | F.col("has_binary_content")),
    )


def issue_rows(
    checked: DataFrame, keys: Sequence[str] = ("target_domain", "path")
) -> DataFrame:
    """One row per page and issue: the list of files per issue, as a table of any length."""
    flags = F.array(*[F.when(F.col(name), F.lit(name)) for name in ISSUES])
    return checked.select(*keys, F.explode(F.array_compact(flags)).alias("issue"))


def site_verdict(checked: DataFrame) -> DataFrame:
    """Per site: pages with each issue and whether all pages are valid."""
    return checked.groupBy("target_domain").agg(
        *[F.count_if(name).alias(name) for name in ISSUES],
        F.bool_and("valid").alias("all_valid"),
    )


def issue_preview(issues: DataFrame, limit: int = PREVIEW) -> DataFrame:
    """First files per site and issue, and how many more there are.

    The ranking keeps only ``limit`` rows per group already before the shuffle (window group
    limit), so the size of a site does not matter; the count is a partial aggregate.  Issues, far
    smaller than the pages, are stored once, so pages are not cut twice.
    """
    issues = cut_lineage(issues)
    keys = ["target_domain", "issue"]
    first = issues.withColumn(
        "rank", F.row_number().over(W.partitionBy(*keys).orderBy("path"))
    ).where(F.col("rank") <= limit)
    counts = issues.groupBy(*keys).agg(F.count("*").alias("files"))
    return first.join(counts, keys).withColumn(
        "more", F.greatest(F.col("files") - limit, F.lit(0))
    )

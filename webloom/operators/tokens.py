"""Lossless token table and tag attributes of a page table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.binding import pin


def token_table(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per token: (keys, pos, kind, tag, text).  Texts in order of pos give the page."""
    pieces = F.flatten(
        F.zip_with(
            H.gaps(F.col("html")),
            H.items(F.col("html")),
            lambda gap, item: F.array(gap, F.coalesce(item, F.lit(""))),
        )
    )
    text = F.col("text")
    kind = (
        F.when(F.col("pos") % 2 == 0, "gap")
        .when(text.startswith("<!--"), "comment")
        .when(H.tag_name(text).isin(*H.RAW_TEXT_ELEMENTS), "element")
        .otherwise("tag")
    )
    return (
        pages.select(*keys, F.posexplode(pieces).alias("pos", "text"))
        .where(text != "")
        .select(
            *keys,
            "pos",
            kind.alias("kind"),
            F.when(F.col("pos") % 2 == 1, H.tag_name(text)).otherwise("").alias("tag"),
            "text",
        )
    )


def attribute_values(
    pages: DataFrame,
    wanted: Mapping[str, Sequence[str]],
    keys: Sequence[str] = ("page_id", "target_domain"),
) -> DataFrame:
    """Non-empty attribute values of the wanted tags: (keys, pos, tag, attr, raw).

    ``pos`` is the number of the item in the page.  Narrow: items are filtered inside the row and
    only the wanted ones become rows.
    """
    names = "|".join(wanted)
    numbered = F.transform(
        H.items(F.col("html")), lambda item, i: F.struct(i.alias("pos"), item.alias("item"))
    )
    relevant = F.filter(numbered, lambda n: n["item"].rlike(rf"(?i)^<(?:{names})[\s/>]"))
    tags = pin(
        pages.select(*keys, F.inline(relevant)),
        tag=H.tag_name(F.col("item")),
        _markup=H.start_tag(F.col("item")),
    )
    attrs = sorted({a for names in wanted.values() for a in names})
    values = [
        F.struct(
            F.lit(attr).alias("attr"),
            F.when(
                F.col("tag").isin(*[t for t, names in wanted.items() if attr in names])
                & F.col("_markup").rlike(rf"(?i){attr}\s*="),
                H.attribute(F.col("_markup"), attr),
            ).alias("raw"),
        )
        for attr in attrs
    ]
    return tags.select(*keys, "pos", "tag", F.inline(F.array(*values))).where(F.col("raw") != "")

"""Rewrite links in pages to local files.

Only link values travel: (page, item number, attribute, value) goes to the lookup and the hits come
back as a list per page.  The page text is shuffled at most once, for the join with its edits (not
at all if the page table is bucketed by page_id), and is changed inside its row.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import urls as U
from webloom.functions.binding import let, pin
from webloom.operators.media import MEDIA_FOLDER
from webloom.operators.tokens import attribute_values

# What is rewritten.
EXTERNAL_TAGS = {tag: ("href", "src") for tag in ("link", "script", "img")}
INTERNAL_TAGS = {
    "a": ("href",),
    **{tag: ("src", "href") for tag in ("img", "script", "link", "video", "audio", "source")},
}
PAGE_KEYS = ("page_id", "target_domain", "path")


def link_edits(
    pages: DataFrame,
    url_map: DataFrame | None = None,
    inventory: DataFrame | None = None,
    keep_fragment: bool = False,
) -> DataFrame:
    """Values that get a local path: (page_id, pos, attr, value).

    Remote media with a local copy if a map is given, links into the own site whose file exists if
    an inventory is given.  Every reference has one key, 'u:' and a remote URL or 'p:' and a path
    in the site, so both are found by one scan of the pages and one join.
    """
    wanted = {
        **(EXTERNAL_TAGS if url_map is not None else {}),
        **(INTERNAL_TAGS if inventory is not None else {}),
    }
    raw, key = F.col("raw"), ["target_domain", "_key"]
    found = attribute_values(pages, wanted, PAGE_KEYS)
    dictionaries = []
    own = F.lit(None).cast("string")
    if inventory is not None:
        base = U.page_address(F.col("target_domain"), F.col("path"))
        allowed = U.is_navigable(raw) & ((F.col("tag") == "a") | ~raw.startswith("../"))
        found = pin(found, _abs=F.when(allowed, U.resolve(base, raw)))
        kept = ~U.is_rejected(F.col("_abs"), F.col("target_domain"))
        found = pin(
            found, _target=F.when(F.col("_abs").isNotNull() & kept, U.local_path(F.col("_abs")))
        )
        own = F.concat(F.lit("p:"), "_target")
        paths = inventory.select("target_domain", "path").distinct()
        dictionaries.append(
            paths.select("target_domain", F.concat(F.lit("p:"), "path").alias("_key"), "path")
        )
    if url_map is not None:
        remote = F.col("tag").isin(*EXTERNAL_TAGS) & raw.rlike("^https?://")
        own = F.coalesce(own, F.when(remote, F.concat(F.lit("u:"), U.strip_query(raw))))
        dictionaries.append(
            url_map.select(
                "target_domain",
                F.concat(F.lit("u:"), "url").alias("_key"),
                F.concat(F.lit(f"{MEDIA_FOLDER}/"), "filename").alias("path"),
            )
        )
    dictionary = reduce(DataFrame.unionByName, dictionaries).withColumnRenamed("path", "_file")
    references = pin(found, _key=own).where(F.col("_key").isNotNull())
    hits = references.join(dictionary, key)
    value = F.concat(U.up_prefix(F.col("path")), "_file")
    if inventory is not None:
        inside = U.relative_path(F.col("_file"), F.col("path"))
        if keep_fragment:
            inside = F.concat(inside, F.regexp_extract("_abs", "#.*$", 0))
        value = F.when(F.col("_key").startswith("p:"), inside).otherwise(value)
    return hits.select("page_id", "pos", "attr", value.alias("value"))


def without_cors(item: Column) -> Column:
    """Drop integrity and crossorigin values; a bare attribute stays."""
    tested = item.rlike(r"(?i)^<(?:link|script|img)[\s/>]") & item.rlike(
        r"(?i)(?:integrity|crossorigin)\s*="
    )
    without = let(H.drop_attribute(item, "integrity"), lambda i: H.drop_attribute(i, "crossorigin"))
    return F.when(tested, without).otherwise(item)


def _with_value(entry: Column, following: Column, text: Column) -> Column:
    """The item with the value of the next entry, if that is an edit of this item."""
    mine = following["pos"] == entry["pos"]
    return (
        F.when(mine & (following["rank"] == 1), H.set_attribute(text, "href", following["text"]))
        .when(mine & (following["rank"] == 2), H.set_attribute(text, "src", following["text"]))
        .otherwise(text)
    )


def apply_edits(
    pages: DataFrame,
    edits: DataFrame,
    strip_cors: bool = False,
    cors_pages: DataFrame | None = None,
) -> DataFrame:
    """Add ``new_html`` and ``changed`` to the pages.

    ``cors_pages`` (page_id) limits the removal of CORS attributes to these pages; they travel
    with the edits as entries at position -1, so the page text is still joined only once.
    Items (rank 0) and their edits (rank 1, 2: an item has at most a src and an href edit) are
    sorted together, so an item finds its edits in the next two places; the cost stays
    n log n in the size of the page.
    """
    edit = F.struct(
        "pos",
        F.when(F.col("attr") == "href", 1).otherwise(2).alias("rank"),
        F.col("value").alias("text"),
    )
    if cors_pages is not None:
        mark = cors_pages.select(
            "page_id", F.lit(-1).alias("pos"), F.lit("").alias("attr"), F.lit("").alias("value")
        )
        edits = edits.unionByName(mark)
    per_page = edits.groupBy("page_id").agg(
        F.collect_list(edit).alias("_all"), F.bool_or(F.col("pos") == -1).alias("_marked")
    )
    in_scope = F.col("_marked").eqNullSafe(True) if cors_pages is not None else F.lit(strip_cors)
    staged = pin(
        pages.join(per_page, "page_id", "left"),
        _edits=F.filter("_all", lambda e: e["pos"] >= 0),
        _cors=in_scope & F.col("html").rlike(r"(?i)(?:integrity|crossorigin)\s*="),
        _items=H.items(F.col("html")),
    )
    staged = pin(
        staged,
        _sorted=F.array_sort(
            F.concat(
                F.transform(
                    "_items",
                    lambda item, i: F.struct(
                        i.alias("pos"), F.lit(0).alias("rank"), item.alias("text")
                    ),
                ),
                F.coalesce("_edits", F.array().cast("array<struct<pos:int,rank:int,text:string>>")),
            )
        ),
    )

    def edited(entry: Column, i: Column) -> Column:
        text = F.when(F.col("_cors"), without_cors(entry["text"])).otherwise(entry["text"])
        for step in (1, 2):
            following = F.get(F.col("_sorted"), i + step)
            text = let(text, partial(_with_value, entry, following))
        return F.struct(entry["rank"].alias("rank"), F.when(entry["rank"] == 0, text).alias("text"))

    new_items = F.transform(
        F.filter(F.transform("_sorted", edited), lambda e: e["rank"] == 0), lambda e: e["text"]
    )
    touched = (F.size("_edits") > 0) | F.col("_cors")
    new_html = F.when(touched, H.splice(H.gaps(F.col("html")), new_items)).otherwise(F.col("html"))
    return (
        pin(staged, new_html=new_html)
        .withColumn("changed", F.col("new_html") != F.col("html"))
        .drop("_all", "_marked", "_edits", "_cors", "_items", "_sorted")
    )


def relink_external(pages: DataFrame, url_map: DataFrame) -> DataFrame:
    return apply_edits(pages, link_edits(pages, url_map), strip_cors=True)


def relink_internal(
    pages: DataFrame, inventory: DataFrame, keep_fragment: bool = False
) -> DataFrame:
    edits = link_edits(pages, inventory=inventory, keep_fragment=keep_fragment)
    return apply_edits(pages, edits)


def relink(
    pages: DataFrame,
    url_map: DataFrame,
    inventory: DataFrame | None = None,
    cors_pages: DataFrame | None = None,
) -> DataFrame:
    """External and, with an inventory, internal links with one pass over the page text."""
    edits = link_edits(pages, url_map, inventory)
    return apply_edits(pages, edits, strip_cors=True, cors_pages=cors_pages)


def modified_pages(rewritten: DataFrame) -> DataFrame:
    return rewritten.groupBy("target_domain").agg(
        F.count_if("changed").alias("modified"), F.count("*").alias("pages")
    )

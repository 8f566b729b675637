"""Stylesheet rewriting: import inlining, local copies, neutral remote references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import urls as U
from webloom.functions.binding import pin
from webloom.operators.links import CSS_IMPORT
from webloom.operators.media import MEDIA_FOLDER
from webloom.operators.rewrite import RewriteStep, css_error, run_steps
from webloom.session import cut_lineage

MAX_IMPORT_DEPTH = 10
# The comments that stand for imports, each around the name of the imported sheet.
EXTERNAL_IMPORT = ('/* External @import "', '" stripped for offline use */')
MISSING_IMPORT = ('/* @import "', '" - FILE NOT FOUND */\n')
CIRCULAR_IMPORT = ('/* @import "', '" - CIRCULAR REFERENCE SKIPPED */\n')
DEEP_IMPORT = ('/* @import "', '" - MAX DEPTH REACHED */\n')
INLINED_IMPORT = ("/* INLINED: ", " */\n")
# The names of the steps.
STEP_NAMES = (
    "Inline CSS @import statements",
    "Strip Google Fonts @import markers",
    "Rewrite external CSS URLs to local",
    "Strip external url() references",
    "Convert absolute local paths to relative",
)

# Patterns and texts of the rewritten stylesheet.
GOOGLE_FONTS_MARKER = (
    r'/\* External @import "https://fonts\.googleapis\.com/[^"]+" stripped for offline use \*/'
)
GOOGLE_FONTS_TEXT = "/* Google Fonts @import stripped for offline use */"
REMOTE_URL = r"""url\(\s*["']?https?://[^"'\\)]+["']?\s*\)"""
REMOTE_URL_TEXT = 'url("about:blank") /* External URL stripped for offline use */'
ABSOLUTE_URL = r"""url\(\s*(["']?)/([^"'\)]*)\1\s*\)"""
# A remote url() in full: quote, address, query, quote.
MAPPED_URL = r"""url\(\s*(["']?)(https?://[^\s"'?#>\)\\]+)(\?[^\s"'#>\)]+)?["']?\s*\)"""

SHEET = ["target_domain", "path"]


def _comment(around: tuple[str, str], name: Column) -> Column:
    return F.concat(F.lit(around[0]), name, F.lit(around[1]))


def _imports(css: Column) -> Column:
    """Imports of a sheet with their places; the texts between them have the even places."""
    return F.transform(
        F.regexp_extract_all(css, F.lit(CSS_IMPORT), F.lit(1)),
        lambda raw, i: F.struct((2 * i + 1).alias("place"), raw.alias("raw")),
    )


def _texts(css: Column, below: Column) -> Column:
    """Texts between the imports of a sheet, numbered below a place."""
    return F.filter(
        F.transform(
            F.split(css, CSS_IMPORT, -1),
            lambda t, i: F.struct(F.concat(below, F.array(2 * i)).alias("order_key"), t.alias("text")),
        ),
        lambda t: t["text"] != "",
    )


def _opened(below: Column) -> Column:
    """Imports of a sheet as rows below a place."""
    return F.inline(
        F.transform(
            "imports",
            lambda i: F.struct(
                F.concat(below, F.array(i["place"])).alias("order_key"), i["raw"].alias("raw")
            ),
        )
    )


def _climbed(at: Column, segment: Column) -> Column:
    """Depth below the site's folder after one more segment, and the least depth so far."""
    depth = at["depth"] + F.when(segment == "..", -1).otherwise(1)
    return F.struct(depth.alias("depth"), F.least(at["low"], depth).alias("low"))


def inline_imports(sheets: DataFrame) -> DataFrame:
    """Replace imports by the imported text: adds ``inlined`` and ``n_inlined``.

    The rounds move no stylesheet text.  An open import is a row of its place in the outermost
    sheet (``order_key``), its path and the imports it came through (``stack``); each round joins
    the open imports with the imports of every sheet.  Texts are joined to the resulting places at
    the end, and put together per outermost sheet; adaptive execution splits a popular import.  A path is resolved
    from the folder of the outermost sheet.
    """
    no_ints, no_texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    structure = cut_lineage(sheets.select(*SHEET, _imports(F.col("css")).alias("imports")))
    on = ["target_domain", "_target"]
    known = structure.select("target_domain", F.col("path").alias("_target"), "imports")
    raw, folder = F.col("raw"), U.folder_of(F.col("path"))
    joined = F.when(folder == "", raw).otherwise(F.concat(folder, F.lit("/"), raw))
    # A path from the root of the host, or one that leaves the site, is no path of a stored file.
    inside = F.aggregate(
        F.filter(F.split(joined, "/", -1), lambda s: ~s.isin("", ".")),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda a, s: _climbed(a, s),
    )["low"] >= 0
    target = F.when(raw.startswith("/") | ~inside, "").otherwise(U.normalize_path(joined))
    outcome = (
        F.when(
            raw.rlike("^https?://"),
            _comment(EXTERNAL_IMPORT, raw),
        )
        .when(F.col("imports").isNull(), _comment(MISSING_IMPORT, raw))
        .when(
            F.array_contains("stack", raw),
            _comment(CIRCULAR_IMPORT, raw),
        )
        .when(
            F.size("stack") >= MAX_IMPORT_DEPTH,
            _comment(DEEP_IMPORT, raw),
        )
    )

    open_imports = structure.select(*SHEET, no_texts.alias("stack"), _opened(no_ints))
    opened_below = _opened(F.col("order_key"))
    longer_stack = F.concat("stack", F.array(raw)).alias("stack")
    texts = [sheets.select(*SHEET, F.inline(_texts(F.col("css"), no_ints)), F.lit(0).alias("n"))]
    rounds = []
    stopped = F.col("_stop").isNotNull()
    while True:
        aimed = pin(open_imports, _target=target)
        judged = cut_lineage(pin(aimed.join(known, on, "left"), _stop=outcome))
        texts.append(
            judged.where(stopped).select(
                *SHEET, "order_key", F.col("_stop").alias("text"), F.lit(0).alias("n")
            )
        )
        rounds.append(judged.where(~stopped).select(*SHEET, *on[1:], "order_key", "raw"))
        open_imports = judged.where(~stopped).select(*SHEET, longer_stack, opened_below)
        if open_imports.isEmpty():
            break
    places = reduce(DataFrame.unionByName, rounds)
    heading = F.concat("order_key", F.array(F.lit(-1))).alias("order_key")
    texts.append(
        places.select(
            *SHEET, heading, _comment(INLINED_IMPORT, raw).alias("text"), F.lit(1).alias("n")
        )
    )
    bodies = sheets.select("target_domain", F.col("path").alias("_target"), "css").join(
        places.select(*on).distinct(), on, "left_semi"
    )
    texts.append(
        places.join(bodies, on).select(
            *SHEET, F.inline(_texts(F.col("css"), F.col("order_key"))), F.lit(0).alias("n")
        )
    )
    inlined = (
        reduce(DataFrame.unionByName, texts)
        .groupBy(*SHEET)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("order_key", "text"))), lambda p: p["text"]
                ),
                "",
            ).alias("inlined"),
            F.sum("n").alias("n_inlined"),
        )
    )
    return sheets.join(inlined, SHEET, "left").withColumns(
        {
            "inlined": F.coalesce("inlined", "css"),
            "n_inlined": F.coalesce("n_inlined", F.lit(0)).cast("bigint"),
        }
    )


def strip_google_fonts(css: Column) -> Column:
    return F.regexp_replace(css, GOOGLE_FONTS_MARKER, GOOGLE_FONTS_TEXT)


def neutralize_remote(css: Column) -> Column:
    return F.regexp_replace(css, REMOTE_URL, REMOTE_URL_TEXT)


def absolute_to_relative(css: Column, prefix: Column) -> Column:
    """The prefix holds dots and slashes only, so it is safe in a replacement."""
    return F.regexp_replace(css, F.lit(ABSOLUTE_URL), F.concat(F.lit("url($1"), prefix, F.lit("$2$1)")))


def localize(sheets: DataFrame, url_map: DataFrame, text: str, out: str) -> DataFrame:
    """Point remote url() references that have a local copy to it.

    The references are looked up as rows and come back as one list per sheet, in order, with an
    entry for every match of the pattern; gaps and entries are then interleaved in the row.
    """
    references = (
        sheets.select(
            *SHEET,
            F.posexplode(F.regexp_extract_all(text, F.lit(MAPPED_URL), F.lit(0))).alias("pos", "ref"),
        )
        .withColumn("_url", F.regexp_extract("ref", MAPPED_URL, 2))
    )
    targets = url_map.select("target_domain", F.col("url").alias("_url"), "filename")
    found = references.join(targets, ["target_domain", "_url"], "left")
    quote = F.regexp_extract("ref", MAPPED_URL, 1)
    local = F.concat(
        F.lit("url("), quote, U.up_prefix(F.col("path")), F.lit(f"{MEDIA_FOLDER}/"), F.col("filename"),
        quote, F.lit(")"),
    )
    lists = found.groupBy(*SHEET).agg(
        F.array_sort(
            F.collect_list(F.struct("pos", F.coalesce(local, F.col("ref")).alias("text")))
        ).alias("_refs")
    )
    return (
        pin(
            sheets.join(lists, SHEET, "left"),
            **{
                out: F.when(F.col("_refs").isNull(), F.col(text)).otherwise(
                    H.splice(
                        F.split(F.col(text), MAPPED_URL, -1),
                        F.transform("_refs", lambda r: r["text"]),
                    )
                )
            },
        )
        .drop("_refs")
    )


def rewrite_stylesheets(sheets: DataFrame, url_map: DataFrame) -> DataFrame:
    """All steps in order, each guarded: adds ``new_css``, ``steps_applied``, ``failures`` and flags.

    The two steps that need joins (imports, local copies) are computed beside the text and enter
    the guarded sequence as columns; local copies are looked up in the text after the font step,
    which is what the guard would keep: a sheet of comments is not blank.  The inlined text is
    stored once, as the look-up and the result both read it.
    """
    filled = sheets.where(F.col("css") != "")
    inlined = inline_imports(sheets).where(F.col("css") != "")
    with_fonts = run_steps(
        inlined,
        "css",
        [
            RewriteStep(STEP_NAMES[0], lambda _: F.col("inlined")),
            RewriteStep(STEP_NAMES[1], strip_google_fonts),
        ],
        css_error,
        out="_text",
    ).withColumnsRenamed({"steps_applied": "_first_steps", "failures": "_first_failures"})
    localized = localize(cut_lineage(with_fonts), url_map, "_text", "_localized")
    rest = run_steps(
        localized,
        "_text",
        [
            RewriteStep(STEP_NAMES[2], lambda _: F.col("_localized")),
            RewriteStep(STEP_NAMES[3], neutralize_remote),
            RewriteStep(
                STEP_NAMES[4],
                lambda css: absolute_to_relative(css, U.up_prefix(F.col("path"))),
            ),
        ],
        css_error,
        out="new_css",
    )
    return rest.select(
        *filled.columns,
        "new_css",
        (F.col("_first_steps") + F.col("steps_applied")).alias("steps_applied"),
        F.concat(
            "_first_failures",
            F.transform("failures", lambda f: f.withField("step_no", f["step_no"] + 2)),
        ).alias("failures"),
        "n_inlined",
        F.col("new_css").contains("Google Fonts @import stripped").alias("fonts_stripped"),
        F.col("new_css").contains("External URL stripped for offline use").alias("urls_stripped"),
    )


def stylesheet_counts(rewritten: DataFrame) -> DataFrame:
    changed = F.col("steps_applied") > 0
    return rewritten.groupBy("target_domain").agg(
        F.count_if(changed).alias("modified"),
        F.sum("n_inlined").cast("bigint").alias("imports_inlined"),
        F.count_if(changed & F.col("fonts_stripped")).alias("fonts_stripped"),
        F.count_if(changed & F.col("urls_stripped")).alias("urls_stripped"),
    )



"""URL functions: Column -> Column, built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.binding import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"

# Prefixes of references that lead nowhere on the site.
NON_NAVIGABLE = ("#", "javascript:", "mailto:", "data:")

# Extensions that are kept as the name of a saved file.
KNOWN_EXTENSIONS = (
    ".css", ".js", ".html", ".htm", ".json", ".xml",
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp4", ".webm", ".avi", ".mkv", ".mov", ".mp3", ".pdf",
)


def with_default_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host without user info and port; '' if there is none."""
    found = F.regexp_extract(
        url, _AUTHORITY + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1
    )
    return F.lower(F.regexp_replace(found, r"^\[|\]$", ""))


def is_navigable(ref: Column, *more_prefixes: str) -> Column:
    prefixes = "|".join(re.escape(p) for p in (*NON_NAVIGABLE, *more_prefixes))
    return ~ref.rlike(f"^(?:{prefixes})")


def is_http(url: Column) -> Column:
    return url.rlike("^(?i)https?:")


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _without_dot_segments(path: Column) -> Column:
    """Fold '.' and '..'; a path without them is returned as it is."""
    return let(path, _fold_dots)


def _fold_dots(path: Column) -> Column:

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    folded = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    ending = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(folded, ending), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), joined).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen from ``base`` (RFC 3986, with empty segments kept
    in root-relative paths and dropped from relative ones)."""
    clean = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    schemes = F.struct(
        base.alias("base"),
        clean.alias("ref"),
        F.lower(F.regexp_extract(clean, _SCHEME, 1)).alias("scheme"),
        F.lower(F.regexp_extract(base, _SCHEME, 1)).alias("base_scheme"),
    )
    return let(schemes, _resolve_schemes)


def _resolve_schemes(s: Column) -> Column:
    local = F.regexp_replace(s["ref"], _SCHEME, "")
    tidy = F.regexp_replace(F.regexp_replace(local, "#$", ""), r"^([^?#]*)\?(#.*)?$", "$1$2")

    def without_scheme(tidy: Column) -> Column:
        rest = F.regexp_replace(tidy, "^//([/?#]|$)", "$1")
        parts = F.struct(
            F.concat(
                s["base_scheme"],
                F.lit("://"),
                F.regexp_extract(s["base"], _AUTHORITY + "([^/?#]*)", 1),
            ).alias("root"),
            path_of(s["base"]).alias("base_path"),
            F.regexp_extract(s["base"], r"^[^?#]*(\?[^#]+)", 1).alias("base_query"),
            F.regexp_extract(rest, "^[^?#]*", 0).alias("path"),
            F.regexp_extract(rest, r"^[^?#]*(.*)$", 1).alias("tail"),
        )
        return F.when(
            tidy.rlike("^//[^/?#]"), F.concat(s["base_scheme"], F.lit(":"), tidy)
        ).otherwise(let(parts, _join_paths))

    return (
        F.when(s["ref"] == "", s["base"])
        .when((s["scheme"] != "") & (s["scheme"] != s["base_scheme"]), s["ref"])
        .otherwise(let(tidy, without_scheme))
    )


def _join_paths(p: Column) -> Column:
    same_page = F.concat(
        p["root"],
        p["base_path"],
        F.when(p["tail"].startswith("?"), F.lit("")).otherwise(p["base_query"]),
        p["tail"],
    )
    folder = F.when(p["base_path"] == "", F.lit("/")).otherwise(
        F.regexp_replace(p["base_path"], "[^/]*$", "")
    )
    # Empty segments between two others go, leading and trailing slash stay.
    relative = F.regexp_replace(F.concat(folder, p["path"]), "/{2,}", "/")
    merged = F.when(p["path"].startswith("/"), p["path"]).otherwise(relative)
    rooted = let(
        _without_dot_segments(merged),
        lambda r: F.when(r.startswith("/"), r).otherwise(F.concat(F.lit("/"), r)),
    )
    return F.when(p["path"] == "", same_page).otherwise(F.concat(p["root"], rooted, p["tail"]))


def _plain_path(url: Column) -> Column:
    """Path without ';parameters' of the last segment."""
    return F.regexp_replace(path_of(url), ";[^/]*$", "")


def file_path(url: Column) -> Column:
    """Relative path under which a URL is stored: '?' becomes '@', '/' in the query '%2F'."""
    named = let(
        _plain_path(url),
        lambda p: F.when((p == "") | p.endswith("/"), F.concat(p, F.lit("index.html"))).otherwise(p),
    )
    clean = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(named, "/(?:\\./)+", "/"), "/{2,}", "/"), "^/", ""
    )
    query = F.replace(query_of(url), F.lit("/"), F.lit("%2F"))
    return F.concat(
        clean, let(query, lambda q: F.when(q != "", F.concat(F.lit("@"), q)).otherwise(""))
    )


def suffix(path: Column) -> Column:
    """Extension of the last path segment in lower case, '' for dot files and trailing dots."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def save_path(path: Column) -> Column:
    return let(
        path,
        lambda p: F.when(suffix(p).isin(*KNOWN_EXTENSIONS), p).otherwise(F.concat(p, F.lit(".html"))),
    )


def local_path(url: Column) -> Column:
    """Where the page or file of a URL is kept below the site folder."""
    return save_path(file_path(url))


def depth(path: Column) -> Column:
    """Folder levels of a relative path; one outside the root counts 0."""
    return F.when(path.startswith("/") | path.startswith("../"), F.lit(0)).otherwise(
        F.size(F.split(path, "/", -1)) - 1
    )


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def normalize_path(path: Column) -> Column:
    """Fold dot segments and empty segments of a relative path."""
    return _without_dot_segments(F.regexp_replace(path, "/{2,}", "/"))


def relative_path(target: Column, from_file: Column) -> Column:
    """Path of ``target`` as seen from the folder of ``from_file``."""

    def parts(path: Column) -> Column:
        return F.filter(F.split(path, "/", -1), lambda s: s != "")

    def climb(p: Column) -> Column:
        shorter = F.least(F.size(p["to"]), F.size(p["start"]))
        # Prefixes are equal up to the common length and for no length beyond it.
        equal = F.filter(
            F.sequence(F.lit(0), shorter),
            lambda n: F.slice(p["to"], F.lit(1), n) == F.slice(p["start"], F.lit(1), n),
        )
        return let(
            F.size(equal) - 1,
            lambda common: F.array_join(
                F.concat(
                    F.array_repeat(F.lit(".."), F.size(p["start"]) - common),
                    F.slice(p["to"], common + 1, F.size(p["to"])),
                ),
                "/",
            ),
        )

    both = F.struct(parts(target).alias("to"), parts(folder_of(from_file)).alias("start"))
    return let(both, climb)


def up_prefix(path: Column) -> Column:
    return F.repeat(F.lit("../"), depth(path))


def is_media(url: Column, extensions: Iterable[str]) -> Column:
    alternatives = "|".join(re.escape(e) for e in extensions)
    return url.rlike(rf"(?i)(?:{alternatives})(?:\?.*)?$")


def basename(url: Column) -> Column:
    return F.regexp_extract(_plain_path(url), "([^/]+)/*$", 1)


def page_address(domain: Column, path: Column) -> Column:
    """Address a stored file stands for."""
    return F.concat(F.lit("https://"), domain, F.lit("/"), path)


# --- reject rules ---------------------------------------------------------------------------

_BACK_REFERENCE = re.compile(r"\\[1-9]|\\k<")
_CHUNK = 100


def any_pattern(text: Column, patterns: Iterable[str]) -> Column:
    """True if one of the regular expressions is found in the text.

    Rules come from settings, so they are literals in the plan: no join, no shuffle.  They are
    folded into alternations of at most 100; a rule with a back-reference keeps its own test.
    """
    patterns = list(patterns)
    alone = [p for p in patterns if _BACK_REFERENCE.search(p)]
    shared = [p for p in patterns if not _BACK_REFERENCE.search(p)]
    chunks = [
        "|".join(f"(?:{p})" for p in shared[i : i + _CHUNK]) for i in range(0, len(shared), _CHUNK)
    ]
    return reduce(lambda a, p: a | text.rlike(p), chunks + alone, F.lit(False))


def any_substring(text: Column, needles: Iterable[str]) -> Column:
    return any_pattern(text, [re.escape(n) for n in needles])


def reject_reason(
    url: Column,
    target_domain: Column,
    patterns: Iterable[str] = (),
    domains: Iterable[str] = (),
) -> Column:
    """Why a URL is not part of the site, cheapest test first; NULL if it is."""
    patterns, domains = list(patterns), list(domains)

    def past_scheme(name: Column) -> Column:
        return (
            F.when(name != target_domain, "host")
            .when(any_pattern(url, patterns), "pattern")
            .when(any_substring(name, domains), "domain")
        )

    return (
        F.when(~is_navigable(url), "prefix")
        .when(~is_http(url), "scheme")
        .otherwise(let(host(url), past_scheme))
    )


def is_rejected(url: Column, target_domain: Column, patterns=(), domains=()) -> Column:
    return reject_reason(url, target_domain, patterns, domains).isNotNull()


def combined_reject_regex(patterns: Iterable[str], domains: Iterable[str]) -> str | None:
    """One expression over whole URLs; here a domain rule may match anywhere in the URL."""
    parts = list(patterns)
    domains = list(domains)
    if domains:
        parts.append("(" + "|".join(domains) + ")")
    return f".*({'|'.join(parts)}).*" if parts else None

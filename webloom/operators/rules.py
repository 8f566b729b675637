"""Rule lists: ranges in patterns, ';' lists, merging of settings.  All row-local."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.binding import let

_BLOCK = r"\{([^{}]+)\}"
_INTEGER = r"^\s*[+-]?\d+(?:_\d+)*\s*$"


def _integer(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[\s+_]", "")
    return F.when(text.rlike(_INTEGER), digits.try_cast("bigint"))


def range_values(expression: Column) -> Column:
    """Values of ``a..b[..step][%x,y]`` as strings; NULL if it is no range or nothing is left."""
    def parsed(halves: Column) -> Column:
        bounds = F.split(F.get(halves, F.lit(0)), r"\.\.", -1)
        return F.struct(
            F.size(bounds).alias("n"),
            _integer(F.get(bounds, F.lit(0))).alias("start"),
            _integer(F.get(bounds, F.lit(1))).alias("end"),
            _integer(F.get(bounds, F.lit(2))).alias("given"),
            F.transform(
                F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ","), lambda e: F.trim(e)
            ).alias("excluded"),
        )

    def stepped(p: Column) -> Column:
        given = F.when(p["given"].isNull() | (p["given"] == 0), F.lit(1).cast("bigint"))
        return p.withField("step", F.coalesce(given, p["given"]))

    def numbers(p: Column) -> Column:
        rising = (p["step"] > 0) & (p["start"] <= p["end"])
        falling = (p["step"] < 0) & (p["start"] >= p["end"])
        texts = F.transform(
            F.sequence(p["start"], p["end"], p["step"]), lambda n: n.cast("string")
        )
        kept = F.filter(texts, lambda n: ~F.array_contains(p["excluded"], n))
        return F.when(p["n"].isin(2, 3) & (rising | falling), kept)

    halves = F.split(expression, "%", 2)
    values = let(let(let(halves, parsed), stepped), numbers)
    return let(values, lambda v: F.when(F.size(v) > 0, v))


def is_range(expression: Column) -> Column:
    return range_values(expression).isNotNull()


def expanded(pattern: Column) -> Column:
    """All patterns that the ``{...}`` blocks stand for; the right-most block varies slowest.

    A block that is no range stays as it is written.
    """
    blocks = F.regexp_extract_all(pattern, F.lit(_BLOCK), F.lit(1))
    texts = F.split(pattern, _BLOCK, -1)
    choices = F.transform(
        blocks,
        lambda b: F.coalesce(range_values(b), F.array(F.concat(F.lit("{"), b, F.lit("}")))),
    )
    pairs = F.reverse(
        F.zip_with(
            F.slice(texts, F.lit(1), F.size(blocks)),
            choices,
            lambda t, c: F.struct(t.alias("text"), c.alias("choices")),
        )
    )
    return F.aggregate(
        pairs,
        F.slice(texts, F.size(texts), F.lit(1)),
        lambda tails, pair: F.flatten(
            F.transform(
                tails,
                lambda tail: F.transform(
                    pair["choices"], lambda c: F.concat(pair["text"], c, tail)
                ),
            )
        ),
    )


def listed(text: Column) -> Column:
    """Trimmed non-empty entries of a ';' list."""
    return F.filter(F.transform(F.split(text, ";"), lambda e: F.trim(e)), lambda e: e != "")


def expand_patterns(df: DataFrame, column: str, keys: Iterable[str] = ()) -> DataFrame:
    """Rows (keys, pattern_no, pattern) of a column of ';' lists with ranges."""
    patterns = F.flatten(F.transform(listed(F.col(column)), expanded))
    return df.select(*keys, F.posexplode(patterns).alias("pattern_no", "pattern"))


def merge_overrides(
    settings: DataFrame,
    parallel: int | None = None,
    depth: int | None = None,
    wait: float | None = None,
    extra_reject: Iterable[str] = (),
) -> DataFrame:
    """Settings rows with overrides: counts if positive, wait if not negative, patterns appended."""
    extra = list(extra_reject)
    changes = {}
    if parallel is not None and parallel > 0:
        changes["parallel_downloads"] = F.lit(parallel)
    if depth is not None and depth > 0:
        changes["max_depth"] = F.lit(depth)
    if wait is not None and wait >= 0:
        changes["wait_between_requests"] = F.lit(float(wait))
    if extra:
        added = F.flatten(
            F.transform(
                F.flatten(F.transform(F.array(*[F.lit(e) for e in extra]), listed)), expanded
            )
        )
        changes["reject_patterns"] = F.concat("reject_patterns", added)
    return settings.withColumns(changes) if changes else settings

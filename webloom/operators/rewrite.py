"""Ordered rewrite steps with a guard after each: a step that breaks the text is undone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.binding import let, pin
from webloom.functions.html import BLANK
from webloom.operators.joins import ordinal

FAILURE_TYPE = "array<struct<step_no:int,step:string,pattern:string,error:string,content:string>>"


@dataclass(frozen=True)
class RewriteStep:
    """``apply`` is a regular expression (Java syntax) or a function of the text column.

    The function may use other columns of the row, and may be a pandas UDF.
    """

    name: str
    apply: str | Callable[[Column], Column]
    replacement: str = ""

    def run(self, text: Column) -> Column:
        if callable(self.apply):
            return self.apply(text)
        return F.regexp_replace(text, self.apply, self.replacement)

    @property
    def pattern(self) -> str:
        return "<callable>" if callable(self.apply) else self.apply


# Tags a rewrite must not lose, with the name used in messages.
_STRUCTURE = (
    ("missing </head>", r"(?i)</head\s*>"),
    ("missing <body>", r"(?i)<body[^>]*>"),
    ("missing </body>", r"(?i)</body\s*>"),
)


def html_error(before: Column, after: Column) -> Column:
    """Message when a structural tag was lost, else NULL."""
    lost = [F.when(before.rlike(p) & ~after.rlike(p), F.lit(name)) for name, p in _STRUCTURE]
    return let(
        F.concat_ws(", ", *lost),
        lambda names: F.when(names != "", F.concat(F.lit("HTML validation failed: "), names)),
    )


def css_error(before: Column, after: Column) -> Column:
    return F.when(after.rlike(rf"(?U)\A{BLANK}*+\z"), F.lit("CSS content is empty"))


def run_steps(
    df: DataFrame,
    text: str,
    steps: Sequence[RewriteStep],
    error: Callable[[Column, Column], Column],
    out: str = "new_text",
) -> DataFrame:
    """Add ``out``, ``steps_applied`` and ``failures`` to the rows; no shuffle.

    Results of a step are pinned, so no step's expression is repeated inside another one.
    """
    df = pin(
        df,
        **{out: F.col(text), "steps_applied": F.lit(0), "failures": F.array().cast(FAILURE_TYPE)},
    )
    for number, step in enumerate(steps, 1):
        df = pin(df, _candidate=step.run(F.col(out)))
        changed = F.col("_candidate") != F.col(out)
        df = pin(df, _error=F.when(changed, error(F.col(out), F.col("_candidate"))))
        rejected = F.array(
            F.struct(
                F.lit(number).alias("step_no"),
                F.lit(step.name).alias("step"),
                F.lit(step.pattern).alias("pattern"),
                F.col("_error").alias("error"),
                F.col("_candidate").alias("content"),
            )
        )
        kept = changed & F.col("_error").isNull()
        df = pin(
            df,
            **{
                "failures": F.when(
                    F.col("_error").isNotNull(), F.concat("failures", rejected)
                ).otherwise(F.col("failures")),
                "steps_applied": F.col("steps_applied") + kept.cast("int"),
                out: F.when(kept, F.col("_candidate")).otherwise(F.col(out)),
            },
        ).drop("_candidate", "_error")
    return df


def failure_rows(rewritten: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rewritten.where(F.size("failures") > 0).select(*keys, F.inline("failures"))


def numbered_failures(
    failures: DataFrame, keys: Sequence[str], last_number: int = 0
) -> DataFrame:
    """Five-digit running numbers that continue after ``last_number``.

    Only keys are sorted and numbered; the rejected contents are joined to their numbers.
    """
    own = [*keys, "step_no"]
    numbers = ordinal(failures.select(*own), [], own, "_n")
    number = F.format_string("%05d", F.col("_n") + last_number)
    return failures.join(numbers.select(*own, number.alias("number")), own)



"""Fill-in-the-middle texts: a document is cut twice at unit borders and written in another order.

A unit is a run of ASCII letters or any other single code point.  One ``fullmatch`` of a repeated
group walks the whole text; the match keeps the end of every repetition, so the number of units and
both cuts are read off it without a loop.  The group is possessive: nothing is kept for backtracking,
and a text of n units needs memory for n offsets.

The two cuts and the form follow from the SHA-256 of the doc_id alone, so they are the same in every
run and on every executor.  The inverse (``restored``) is built-in column functions: no text that is
rearranged holds a mark, so splitting the output at the marks gives back its three parts.

Nulls: a null text is an empty text.  A null doc_id is written as nothing in what is hashed.  Empty texts,
and texts that hold a mark, stay as they are (``plain``).  Rows are independent, so repeated rows and ids
stay; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_map, slices, texts_of

# The marks before prefix, suffix and middle, and the units of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"([A-Za-z]++|[^A-Za-z])*+"
#: Of 100 documents, those that stay plain, and of 100 others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of text that a task turns into output at once.
SLICE = 8 << 20


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that depend on the id only."""
    name = "" if doc_id is None else str(doc_id)
    digest = sha256(f"1:{name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(text: str, doc_id: int | None, units) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = units.fullmatch(text).ends(1)
    n = len(ends)
    first, second, third, fourth = draws(doc_id)
    if not n or third % 100 >= 100 - PLAIN or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if fourth % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        units = regex.compile(UNITS)
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        for part in slices(batches, "text", SLICE):
            ids = part.column("doc_id")
            rows = [
                rearranged(t or "", i, units) for t, i in zip(texts_of(part), ids.to_pylist())
            ]
            yield {"doc_id": ids, **dict(zip(names, map(list, zip(*rows))))}

    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(
        F.array(F.lit(2), F.lit(3), F.lit(1))
    )
    return F.when(form == "plain", output).otherwise(
        F.concat(*[F.element_at(parts, order[k] + 1) for k in range(3)])
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every text."""
    return transformed(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


#: DuckDB SQL of ``digests`` over ``documents``.
SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
    CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1,
    CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3,
    CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4
  FROM units
), cut AS (
  SELECT doc_id, text, n,
    array_to_string(u[1:least(c1, c2)], '') AS prefix,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90
      THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

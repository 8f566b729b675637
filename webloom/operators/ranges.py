"""Patterns with ``{a..b..step%x,y}`` blocks as one regular expression each, without a product of their values.

An interval of numbers is a few alternatives over digits (1 to 1,000,000 are three), exclusions split an
interval, and blocks follow one another in the expression, so its size is the sum over blocks and not their
product.  It matches where one of the expanded patterns does.  A block of another step than one is the
list of its values; a block that a quantifier, a bracket or a backslash touches keeps its pattern expanded,
as there the text of a value means more than its digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.session import let_workers_import

_BLOCK = re.compile(r"\{([^{}]+)\}")
_INTEGER = re.compile(r"\s*[+-]?[0-9]+(?:_[0-9]+)*\s*")


def bounds(block: str) -> tuple[range, list[int]] | None:
    """Values and exclusions of a block; None if it is no range or nothing is left of it."""
    text, _, without = block.partition("%")
    numbers = [int(p) if _INTEGER.fullmatch(p) else None for p in text.split("..")]
    if len(numbers) not in (2, 3) or None in numbers[:2]:
        return None
    start, end, step = (*numbers, None)[:3]
    step = step or 1
    values = range(start, end + (1 if step > 0 else -1), step)
    gone = {e.strip(" ") for e in without.split(",")}
    excluded = sorted({int(e) for e in gone if re.fullmatch(r"0|-?[1-9][0-9]*", e) and int(e) in values})
    return (values, excluded) if len(values) > len(excluded) else None


def _digits(a: int, b: int) -> str:
    return str(a) if a == b else f"[{a}-{b}]"


def _free(n: int) -> str:
    return "" if n == 0 else "[0-9]" if n == 1 else f"[0-9]{{{n}}}"


def _same_length(low: str, high: str) -> Iterator[str]:
    """Alternatives for all numbers between two of as many digits."""
    k = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), len(low))
    if k == len(low):
        yield low
        return
    prefix, rest = low[:k], len(low) - k - 1
    first, last = int(low[k]), int(high[k])
    if set(low[k + 1 :]) - {"0"}:
        yield from (prefix + low[k] + x for x in _same_length(low[k + 1 :], "9" * rest))
        first += 1
    upper = set(high[k + 1 :]) - {"9"}
    if first <= last - bool(upper):
        yield prefix + _digits(first, last - bool(upper)) + _free(rest)
    if upper:
        yield from (prefix + high[k] + x for x in _same_length("0" * rest, high[k + 1 :]))


def interval(low: int, high: int) -> list[str]:
    """Alternatives that match the decimal numbers from ``low`` to ``high``, as they are written."""
    out = []
    if low < 0:
        out += ["-" + x for x in interval(max(1, -high), -low)]
        low = 0
    while low <= high:
        top = min(high, 10 ** len(str(low)) - 1)
        out += _same_length(str(low), str(top))
        low = top + 1
    return out


def _alternatives(values: range, excluded: Sequence[int]) -> list[str]:
    if abs(values.step) != 1:
        return [str(v) for v in values if v not in set(excluded)]
    low, high = sorted((values[0], values[-1]))
    out = []
    for gone in [*excluded, high + 1]:
        if low < gone:
            out += interval(low, gone - 1)
        low = gone + 1
    return out


def compact(pattern: str) -> str:
    """One expression that is found in a text if one of the expanded patterns is."""
    parts = _BLOCK.split(pattern)
    texts, blocks = parts[::2], [bounds(b) for b in parts[1::2]]
    if not any(blocks):
        return pattern
    touched = any(
        found and (after[:1] in ("*", "+", "?", "{") or (not after and k + 1 < len(blocks) and not blocks[k + 1]))
        for k, (found, after) in enumerate(zip(blocks, texts[1:]))
    )
    if touched or "[" in pattern or any(t.endswith("\\") for t in texts):
        return _expanded(parts, blocks)
    out = texts[0]
    for found, raw, after in zip(blocks, parts[1::2], texts[1:]):
        out += f"(?:{'|'.join(_alternatives(*found))})" if found else f"{{{raw}}}"
        out += after
    return out


def _expanded(parts: Sequence[str], blocks: Sequence[tuple[range, list[int]] | None]) -> str:
    choices = [
        [str(v) for v in found[0] if v not in set(found[1])] if found else [f"{{{raw}}}"]
        for found, raw in zip(blocks, parts[1::2])
    ]
    texts = parts[::2]
    return "|".join(
        f"(?:{texts[0]}{''.join(c + t for c, t in zip(choice, texts[1:]))})" for choice in product(*choices)
    )


def compacted(rules: DataFrame, column: str = "text") -> DataFrame:
    """The rules with their patterns as expressions without ranges; nulls stay."""
    let_workers_import(rules.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            found = [None if p is None else compact(p) for p in batch.column(column).to_pylist()]
            yield batch.set_column(at, column, pa.array(found, pa.string()))

    return rules.mapInArrow(run, rules.schema)

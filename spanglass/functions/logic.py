"""Predicates and arithmetic with the table language's rules for nulls, integers and patterns.

They differ from Spark's in a few places: a null operand makes AND and OR null,
integer division truncates, IN never gives null, LIKE has no escape character, and
comparison of NaN with = follows IEEE.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*parts: Column) -> Column:
    """AND that is null if any operand is null."""
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(known, reduce(lambda a, b: a & b, parts))


def any_of(*parts: Column) -> Column:
    """OR that is null if any operand is null."""
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(known, reduce(lambda a, b: a | b, parts))


def where_any_of(*parts: tuple[Column, list[Column]]) -> Column:
    """The same OR as a filter: (predicate, the columns it reads) each.  Unlike a CASE, it reaches the Parquet scan."""
    leaves = [c.isNotNull() for _, columns in parts for c in columns]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [p for p, _ in parts]), *leaves])


def divide_int(a: Column, b: Column) -> Column:
    """Truncating division of integers; division by zero raises under ANSI rules."""
    return F.call_function("div", a, b)


def divide(a: Column, b: Column) -> Column:
    """Division of floats; by zero it gives an infinity or NaN."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y != 0, F.try_divide(x, y)).when(x.isNotNull() & y.isNotNull(), zero)


def truth(x: Column, kind: str) -> Column:
    """Integers are true where not zero; ``kind`` is the column's type name."""
    return x if kind == "boolean" else x != 0


def equals(a: Column, b: Column) -> Column:
    """= on floats: NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def is_in(x: Column, values: list) -> Column:
    """IN a list: nulls in it match nothing, and the result is only null for a null ``x``."""
    return F.when(x.isNotNull(), x.isin([v for v in values if v is not None]))


def not_in(x: Column, values: list) -> Column:
    return ~is_in(x, values)


def in_ranges(x: Column, *ranges: tuple[float | None, float | None] | tuple[float | None, float | None, float]) -> Column:
    """Within inclusive ranges, open where a bound is None; a third number is a step from the lower bound."""

    def one(r: tuple) -> Column:
        low, high, step = (*r, None)[:3]
        parts = [x >= low] if low is not None else []
        parts += [x <= high] if high is not None else []
        if step is not None:
            off = (x - (low or 0)) % step
            parts.append((F.abs(off) < 1e-10) | (F.abs(off - step) < 1e-10))
        return reduce(lambda a, b: a & b, parts, x.isNotNull())

    return reduce(lambda a, b: a | b, map(one, ranges))


def like(x: Column, pattern: str) -> Column:
    """LIKE with % and _ only; a backslash stands for itself."""
    return x.like(pattern.replace("\\", "\\\\"))


def glob(x: Column, pattern: str) -> Column:
    """Shell pattern with * and ?, over the whole text."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return x.rlike(f"(?s)^{body}$")


def matches(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regular expression found anywhere."""
    return x.rlike(("(?i)" if ignore_case else "") + pattern)


def near(a: Column, b: Column, tolerance: float = 1e-13) -> Column:
    """Relative closeness; two zeros are near."""
    largest = F.greatest(F.abs(a), F.abs(b))
    return F.when(largest == 0, F.lit(True)).otherwise(F.abs(a - b) <= tolerance * largest)


def near_abs(a: Column, b: Column, tolerance: float = 1e-13) -> Column:
    return F.abs(a - b) <= tolerance


def iif(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition takes the second value."""
    return F.when(condition, yes).otherwise(no)


def sign(x: Column) -> Column:
    """1 or -1; positive zero counts as positive, NaN stays."""
    return F.when(F.isnan(x), x).when((x > 0) | (x.cast("string") == "0.0") | (x.cast("string") == "0"), F.lit(1.0)).otherwise(F.lit(-1.0))


def log(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0 and NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def substring(x: Column, start: int, length: int) -> Column:
    """``start`` counts from 0."""
    return F.substring(x, start + 1, length)


def trim(x: Column) -> Column:
    """All Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def left_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+", "")


def right_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def smaller(a: Column, b: Column) -> Column:
    """Null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def truncated(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def ilike(x: Column, pattern: str) -> Column:
    """LIKE without regard to case; a backslash stands for itself."""
    return x.ilike(pattern.replace("\\", "\\\\"))


def capitalize(x: Column) -> Column:
    """First letter of each word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")

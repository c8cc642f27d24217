"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: str | Column) -> Column:
    """NULL, or nothing but spaces."""
    return col(c).isNull() | (F.trim(col(c).cast("string")) == "")


def differs(a: Column, b: Column) -> Column:
    """NULL-safe change test: NULL to value and value to NULL both count."""
    return ~a.eqNullSafe(b)


def relative_gap(a: str | Column, b: str | Column) -> Column:
    """|a-b| over the larger of the two; NULL when either is NULL or the larger is not positive."""
    a, b = col(a), col(b)
    top = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    return F.try_divide(F.abs(a - b), F.when(top > 0, top))


def days_apart(a: str | Column, b: str | Column) -> Column:
    return F.abs(F.datediff(col(a), col(b)))


def surrogate_key(*cols: str | Column) -> Column:
    """SHA-256 over the parts joined by a double pipe; NULL when any part is NULL.

    `concat_ws` skips NULLs, so two different keys could collide without the guard.
    """
    parts = [col(c).cast("string") for c in cols]
    present = parts[0].isNotNull()
    for part in parts[1:]:
        present = present & part.isNotNull()
    return F.when(present, F.sha2(F.concat_ws("||", *parts), 256))


def date_key(c: str | Column) -> Column:
    """yyyyMMdd as an int."""
    d = col(c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def json_tags(c: str | Column) -> Column:
    """JSON text to array<string>; text that is not such an array gives NULL."""
    return F.from_json(col(c), "array<string>")


def valid_at(at: Column, valid_from: str | Column = "valid_from", valid_to: str | Column = "valid_to") -> Column:
    """Half-open window test, start included and end excluded."""
    return (at >= col(valid_from)) & (at < col(valid_to))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def numbers_in(text: str | Column) -> Column:
    """Every number written in the text, thousands separators removed."""
    found = F.regexp_extract_all(col(text), F.lit(v.NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, ",", "").try_cast("double"))


def mentions_number(text: str | Column, expected: str | Column, tolerance: float) -> Column:
    """Some number in the text equals `expected` as is, as a percentage, or in thousands, millions or billions."""
    e = col(expected)
    forms = F.array(e, e * 100, e / 1e3, e / 1e6, e / 1e9)
    hit = F.exists(
        numbers_in(text),
        lambda n: F.exists(
            forms, lambda f: F.coalesce(F.abs(n - f) <= tolerance * F.greatest(F.abs(f), F.lit(1e-9)), F.lit(False))
        ),
    )
    return F.when(col(text).isNotNull() & e.isNotNull(), hit)


def mentions_text(text: str | Column, part: str | Column) -> Column:
    """Containment without regard to case."""
    return F.contains(F.lower(col(text)), F.lower(col(part)))

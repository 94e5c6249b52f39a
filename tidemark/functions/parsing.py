"""Scalar parsing: numbers from text, codes, window cutoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n"


def clean_code(c: Column) -> Column:
    """Trim and upper-case a contract code."""
    return F.upper(F.trim(c, F.lit(_BLANKS)))


def number_or_null(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The cast alone would also take type suffixes (1d, 1f) and hexadecimal floats. The guard
    is a few substring tests, as this runs on every cell of a tape.
    """
    text = F.trim(c.cast("string"), F.lit(_BLANKS))
    suffix = F.right(text, F.lit(1)).isin("d", "D", "f", "F") & (F.lower(F.right(text, F.lit(3))) != "inf")
    hexadecimal = text.contains("x") | text.contains("X")
    return F.when(~suffix & ~hexadecimal, text.try_cast("double"))


def number_or_zero(c: Column) -> Column:
    """Text to double; anything that is not a number becomes 0."""
    return F.coalesce(number_or_null(c), F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either side is null."""
    return a / F.nullif(b, F.lit(0.0))


def at_clock(session_date: Column, hour: int, minute: int, second: int = 0,
             prev_day: bool = False) -> Column:
    """Wall-clock time on the session date (or the day before), without a zone."""
    base = F.date_sub(session_date, 1) if prev_day else session_date
    offset = F.expr(f"INTERVAL '{hour:02d}:{minute:02d}:{second:02d}' HOUR TO SECOND")
    return base.cast("timestamp_ntz") + offset


def window_cutoff(session_date: Column, hh_mm: tuple[int, int], *, prev_day: bool = False,
                  inclusive: bool = True) -> Column:
    """Latest instant that still belongs to a boundary minute.

    Inclusive cutoffs reach to second 59 of the minute, exclusive ones stop at second 0.
    Both are compared with ``<=``.
    """
    return at_clock(session_date, *hh_mm, 59 if inclusive else 0, prev_day)

"""Text formats of the reports and text sinks. Tables keep typed doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "n/a"


def fixed(c: Column, decimals: int = 2) -> Column:
    """Fixed decimals, ties to even, empty text for null."""
    text = F.format_string(f"%.{decimals}f", F.bround(c, decimals))
    return F.when(c.isNotNull(), text).otherwise("")


def whole(c: Column) -> Column:
    """Rounded to even with thousands separators."""
    return F.when(c.isNotNull(), F.format_number(c, 0)).otherwise(NOT_AVAILABLE)


def padded(c: Column, width: int) -> Column:
    """Right-aligned; longer text is kept whole."""
    return F.format_string(f"%{width}s", c)


def signed_percent(c: Column) -> Column:
    sign = F.when(c < 0, "-").otherwise("+")
    return F.concat(sign, F.format_string("%.0f", F.abs(F.bround(c, 0))), F.lit("%"))


def have_note(n: Column, tier: Column) -> Column:
    return F.format_string("n/a (have %d of %d)", n.cast("int"), tier.cast("int"))

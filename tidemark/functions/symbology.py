"""Contract symbology as closed-form column expressions.

Every function is a pure expression of a code and an as-of date: no lookup table, no join.
Two identities keep the expressions small enough for code generation:

* A month has rolled once the date is past the first of the month, so with
  ``y = year(as_of)`` the front contract delivers in ``y`` or, when rolled, in ``y + 1``.
* A year digit stands for the year ``y - 1 + k`` with ``k = (digit - y + 1) mod 10``, hence
  the position of a contract is ``k``, less 1 when its month has rolled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import clean_code
from tidemark.settings import COTTON, MONTH_LETTERS, MONTH_NAMES, MONTH_WORDS, Market, listed

_DIGITS = "0123456789"


def _lookup(pairs: dict, key: Column) -> Column:
    """Value of a literal map, null for an unknown key."""
    return F.try_element_at(F.expr(f"map({', '.join(repr(x) for kv in pairs.items() for x in kv)})"), key)


def _months(market: Market) -> dict[str, int]:
    return {w: MONTH_WORDS.index(w) + 1 for w in market.active_months}


def _letter(month: int) -> str:
    return MONTH_LETTERS[month - 1]


def _rolled(month: Column, as_of: Column) -> Column:
    """1 when the date is past the first of the month, else 0."""
    return (F.month(as_of) * 100 + F.dayofmonth(as_of) > month * 100 + 1).cast("int")


def _digit_offset(digit: Column, as_of: Column) -> Column:
    return F.pmod(digit - F.year(as_of) + 1, F.lit(10))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once, at this point of the plan.

    A filter or join on a plain projected column is pushed down with its whole expression,
    through aggregates and joins to the scan, and would map codes on every raw row instead of
    on the few rows left here. A generator stops that.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("*", made).select(*df.columns, *[F.col("_made")[n].alias(n) for n in columns])


def month_of_letter(letter: Column) -> Column:
    """F..Z -> 1..12, null for any other character."""
    return _lookup({c: i + 1 for i, c in enumerate(MONTH_LETTERS)}, letter)


def year_of_digit(digit: Column, as_of: Column) -> Column:
    """The year ending in ``digit`` among last year .. eight years ahead."""
    return F.year(as_of) - 1 + _digit_offset(digit, as_of)


def first_live_year(month: Column, as_of: Column) -> Column:
    """Delivery year of position 1: a month is live up to and including its first day."""
    return F.year(as_of) + _rolled(month, as_of)


def _last_digit(body: Column) -> Column:
    return F.substring(body, -1, 1).try_cast("int")


def exchange_letter(code: Column) -> Column:
    """Month letter of a valid exchange code (prefix + letter + year digit), else null."""
    body = clean_code(code)
    return F.when(body.rlike(f"^.+[{MONTH_LETTERS}][0-9]$"), F.substring(body, -2, 1))


def exchange_year(code: Column, as_of: Column) -> Column:
    """Four-digit delivery year of a valid exchange code, else null."""
    return F.when(exchange_letter(code).isNotNull(), year_of_digit(_last_digit(clean_code(code)), as_of))


def exchange_parts(code: Column, as_of: Column) -> Column:
    """struct(prefix, month_code, month_num, delivery_year); null for an invalid code."""
    body = clean_code(code)
    letter = exchange_letter(code)
    return F.when(
        letter.isNotNull(),
        F.struct(
            F.substr(body, F.lit(1), F.length(body) - 2).alias("prefix"),
            letter.alias("month_code"),
            month_of_letter(letter).alias("month_num"),
            exchange_year(code, as_of).alias("delivery_year"),
        ),
    )


def exchange_position(code: Column, as_of: Column) -> Column:
    """1 for the front contract of its month, 2 for the next year's, and so on."""
    month = month_of_letter(exchange_letter(code))
    return _digit_offset(_last_digit(clean_code(code)), as_of) - _rolled(month, as_of)


def is_excluded_code(code: Column, market: Market = COTTON) -> Column:
    return F.substring(clean_code(code), 1, 3).isin(*market.excluded_prefixes)


def is_excluded_generic(generic: Column, market: Market = COTTON) -> Column:
    return clean_code(generic).rlike("^(" + "|".join(market.excluded_generics) + ")")


def _slot(stem: Column, digit: Column, as_of: Column, market: Market) -> Column:
    """Slot name of prefix + month letter and a year digit, null when not tracked."""
    stems = {market.prefix + _letter(m): (w, m) for w, m in _months(market).items()}
    stems = {k: v for k, v in stems.items() if k not in market.excluded_prefixes}
    month = _lookup({k: m for k, (_, m) in stems.items()}, stem)
    name = _lookup({k: market.prefix + w for k, (w, _) in stems.items()}, stem)
    position = _digit_offset(digit, as_of) - _rolled(month, as_of)
    tracked = _lookup({p: str(p) for p in market.positions}, position)
    return F.concat(name, tracked)


def generic_of_exchange(code: Column, as_of: Column, market: Market = COTTON) -> Column:
    """Slot name of an exchange code, null outside the tracked months and positions."""
    body = clean_code(code)
    stem = F.substr(body, F.lit(1), F.length(body) - 1)
    return _slot(stem, _last_digit(body), as_of, market)


def _option_stem(body: Column, market: Market) -> Column:
    """Prefix + letter that decides an option's month: serials by their first three
    characters, other codes of unusual length by the letter before the year digit."""
    three = F.substring(body, 1, 3)
    plain = (F.length(body) == 4) | three.isin(*[s for s, _ in market.serial_parents])
    return F.when(plain, three).when(F.length(body) >= 3, F.concat(F.substring(body, 1, 2), F.substring(body, -2, 1)))


def parent_prefix(code: Column, market: Market = COTTON) -> Column:
    """Futures prefix an option month settles into; null when the month is not tracked."""
    stem = _option_stem(clean_code(code), market)
    active = [_letter(m) for m in _months(market).values()]
    direct = F.when(F.substring(stem, 3, 1).isin(*active), stem)
    return F.coalesce(_lookup(dict(market.serial_parents), stem), direct) if market.serial_parents else direct


def option_slot(code: Column, as_of: Column, market: Market = COTTON) -> Column:
    """Slot of an option code: drop excluded months, roll serials, then map the future."""
    body = clean_code(code)
    stem = _option_stem(body, market)
    parents = {market.prefix + _letter(m): market.prefix + _letter(m) for m in _months(market).values()}
    future = _lookup(parents | dict(market.serial_parents), stem)
    return F.when(~is_excluded_code(code, market), _slot(future, _last_digit(body), as_of, market))


def boundary_slot(code: Column, as_of: Column, market: Market = COTTON) -> Column:
    """Slot of a boundary reading, which may already be spelled as a slot name."""
    body = clean_code(code)
    return F.when(body.isin(*market.slots), body).otherwise(generic_of_exchange(body, as_of, market))


def resolve_generic(generic: Column, as_of: Column, years_ahead: int = 15) -> Column:
    """struct describing the contract a slot name means on a date; null when it means none, or one further ahead."""
    body = clean_code(generic)
    stem = F.rtrim(body, F.lit(_DIGITS))
    word = F.substring(stem, -3, 3)
    prefix = F.substr(stem, F.lit(1), F.length(stem) - 3)
    position = F.substr(body, F.length(stem) + 1).try_cast("int")
    month = _lookup({w: i + 1 for i, w in enumerate(MONTH_WORDS)}, word)
    letter = _lookup(dict(zip(MONTH_WORDS, MONTH_LETTERS)), word)
    year = first_live_year(month, as_of) + position - 1
    known = body.rlike("^[A-Z]{4,}[0-9]+$") & (position >= 1) & (year <= F.year(as_of) + years_ahead)
    return F.when(
        known,
        F.struct(
            F.concat(prefix, letter, (year % 10).cast("string")).alias("ice_code"),
            F.concat(stem, position.cast("string")).alias("generic_code"),
            prefix.alias("prefix"),
            letter.alias("month_code"),
            _lookup(dict(zip(MONTH_WORDS, MONTH_NAMES)), word).alias("month_name"),
            month.alias("month_num"),
            year.alias("delivery_year"),
            position.alias("position"),
        ),
    )


def enrich(df: DataFrame, generic: str, as_of: str, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    """Keep rows whose slot is tracked and add the contract it stands for on the date."""
    markets = listed(market)
    slots = {f"{k.prefix}{w}{p}": (m, p) for k in markets for w, m in _months(k).items() for p in k.positions}
    prefixes = {f"{k.prefix}{w}{p}": k.prefix for k in markets for w in _months(k) for p in k.positions}
    key, day = F.col(generic), F.col(as_of)
    month = _lookup({s: m for s, (m, _) in slots.items()}, key)
    position = _lookup({s: p for s, (_, p) in slots.items()}, key)
    letter = _lookup({s: _letter(m) for s, (m, _) in slots.items()}, key)
    rows = df.withColumn(generic, clean_code(key)).filter(key.isin(*slots)).withColumn(
        "delivery_year", first_live_year(month, day) + position - 1)
    return rows.select(
        *df.columns,
        F.concat(_lookup(prefixes, key), letter, (F.col("delivery_year") % 10).cast("string")).alias("ice_code"),
        letter.alias("month_code"),
        _lookup({s: MONTH_NAMES[m - 1] for s, (m, _) in slots.items()}, key).alias("month_name"),
        "delivery_year", position.alias("position"),
    )


def universe(sessions: DataFrame, as_of: str = "session_date", market: Market = COTTON) -> DataFrame:
    """Every tracked slot with its contract, for every session date."""
    entries = [F.struct(
        F.lit(f"{market.prefix}{w}{p}").alias("generic_code"), F.lit(market.prefix).alias("prefix"),
        F.lit(_letter(m)).alias("month_code"), F.lit(MONTH_NAMES[m - 1]).alias("month_name"),
        F.lit(m).alias("month_num"), F.lit(p).alias("position"))
        for w, m in _months(market).items() for p in market.positions]
    rows = sessions.select(as_of, F.explode(F.array(*entries)).alias("s")).select(as_of, "s.*")
    year = first_live_year(F.col("month_num"), F.col(as_of)) + F.col("position") - 1
    return rows.withColumn("delivery_year", year).withColumn(
        "ice_code", F.concat("prefix", "month_code", (F.col("delivery_year") % 10).cast("string")))

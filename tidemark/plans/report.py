"""Report lines as rows (session_date, section, ord, line); the text sink keeps the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import NOT_AVAILABLE, padded, signed_percent, whole
from tidemark.functions.sessions import session_keys
from tidemark.functions.symbology import enrich
from tidemark.operators.ranking import rank_contracts
from tidemark.operators.trailing import change_percent, direction
from tidemark.settings import COTTON, Market, listed

# Line formats of the two reports.
OPTION_BLOCKS = {"overnight": "OVERNIGHT (prev 21:00 -> 07:00 ET)", "day": "DAY (07:00 -> 14:20 ET)"}
FUTURES_BLOCKS = {"night": "NIGHT (open 21:00 -> 07:00 ET)", "day": "DAY (07:00 -> 14:20 ET)",
                  "full": "FULL (open 21:00 -> 14:20 ET)"}
FUTURES_LABELS = {"overnight": "OVERNIGHT (interim, no-write)",
                  "eod": "EOD (sidecar -- same-day final after 14:20 close)"}
SOURCE_LABELS = {"live": "Sidecar (live boundary readings)",
                 "seed": "Seed bars (historical full only)"}
HIGH_MARK, LOW_MARK = "  *** HIGH (>=2x)", "  *** LOW (<=0.5x)"


def _lines(df: DataFrame, section, *items: tuple[int, Column | str]) -> DataFrame:
    """Several numbered lines per row; null lines are left out."""
    as_col = [(o, t if isinstance(t, Column) else F.lit(t)) for o, t in items]
    many = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), t.alias("line")) for o, t in as_col])).alias("l")
    place = section if isinstance(section, Column) else F.lit(section)
    keys = session_keys(df)
    return df.select(*keys, place.alias("section"), many).select(
        *keys, "section", "l.ord", "l.line").filter(F.col("line").isNotNull())


def _ratio_text(c: Column) -> Column:
    return F.when(c.isNull(), NOT_AVAILABLE).otherwise(
        F.concat(F.format_string("%.2f", F.bround(c, 2)), F.lit("x")))


def rvol_lines(rvol: DataFrame, section: Column, empty: Column) -> DataFrame:
    """One line per tier."""
    flag = F.when(F.col("flag") == "HIGH", HIGH_MARK).when(F.col("flag") == "LOW", LOW_MARK).otherwise("")
    note = F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit("  ["), "note", F.lit("]")))
    head = F.concat(F.lit("  RVOL-"), padded(F.col("tier").cast("string"), 2), F.lit("  "))
    full = F.concat(head, F.lit("avg="), padded(whole(F.col("avg")), 9), F.lit("  rvol="),
                    _ratio_text(F.col("rvol")), flag, note)
    line = F.when(F.col("avg").isNull(), F.concat(head, empty)).otherwise(full)
    return rvol.select(*session_keys(rvol), section.alias("section"), (100 + F.col("tier")).alias("ord"),
                       line.alias("line"))


def _previous(value: Column, prev: Column) -> Column:
    change = change_percent(value, prev)
    tail = F.when(change.isNull(), "").otherwise(
        F.concat(F.lit("   "), direction(value, prev), F.lit(" "), signed_percent(change)))
    return F.when(prev.isNotNull(), F.concat(F.lit("  vs prev session: "), whole(prev), tail))


def _index(labels: dict[str, str], key: Column, start: int = 1) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in labels]), key).cast("int") + (start - 1)


def _title(labels: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), key)


def options_report(sessions: DataFrame, totals: DataFrame, slots: DataFrame, rvol: DataFrame,
                   commodity: Column, generated_at: Column, windows, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    keys = session_keys(sessions)
    labels = {w: t for w, t in OPTION_BLOCKS.items() if w in windows}
    window = F.col("window")
    section = _index(labels, window)
    day = F.date_format("session_date", "yyyy-MM-dd")
    head = _lines(sessions, 0, (0, F.concat(F.lit("SESSION VOLUME -- "), commodity, F.lit(" -- "), day)), (1, "=" * 60))
    blocks = sessions.select(*keys, F.explode(F.array(*[F.lit(w) for w in labels])).alias("window"))
    titles = _lines(blocks, section, (0, ""), (1, _title(labels, window)), (2, "-" * 40))
    missing = _lines(blocks.join(totals.select(*keys, "window"), [*keys, "window"], "left_anti"),
                     section, (3, "  No data for this window."))
    pc = F.col("pc_ratio")
    pc_text = F.when(F.coalesce(pc, F.lit(0.0)) == 0, "").otherwise(
        F.concat(F.lit("   (P/C "), F.format_string("%.2f", F.bround(pc, 2)), F.lit(")")))
    stamp = "yyyy-MM-dd HH:mm:ss"
    span = F.concat(F.coalesce(F.concat(F.date_format("snapshot_ts_start", stamp), F.lit(" -> ")), F.lit("")),
                    F.date_format("snapshot_ts", stamp))
    body = _lines(
        totals, section,
        (3, F.concat(F.lit("  Total          : "), whole(F.col("total")))),
        (4, F.concat(F.lit("  Calls / Puts   : "), whole(F.col("call")), F.lit(" / "), whole(F.col("put")), pc_text)),
        (5, F.concat(F.lit("  Snapshot       : "), span)),
        (7, ""), (200, ""), (201, "  By contract (total | call | put):"),
        (300, F.when(F.col("total") <= 0, F.lit("    (no volume recorded)"))),
    )
    first = rvol.filter(F.col("tier") == listed(market)[0].tiers[0])
    prev = _lines(first, section, (6, _previous(F.col("total"), F.col("prev"))))
    tiers = rvol_lines(rvol, section, F.lit("n/a (0 sessions)"))
    ranked = enrich(rank_contracts(slots, [*keys, "window"], "total"), "generic_code",
                    "session_date", market)
    contract = F.concat(
        F.format_string("    %-8s (%s/%d)  ", "generic_code", "ice_code", "delivery_year"),
        padded(whole(F.col("total")), 9), F.lit("  |  "), padded(whole(F.col("call")), 8), F.lit("  |  "),
        padded(whole(F.col("put")), 8))
    by_contract = ranked.select(*keys, section.alias("section"),
                                (300 + F.col("rank")).alias("ord"), contract.alias("line"))
    foot = _lines(sessions, 9, (0, ""), (1, _generated(generated_at)))
    return _union(head, titles, missing, body, prev, tiers, by_contract, foot)


def futures_report(sessions: DataFrame, totals: DataFrame, contracts: DataFrame, rvol: DataFrame,
                   commodity: Column, generated_at: Column, window: str, market: Market | Sequence[Market] = COTTON) -> DataFrame:
    keys = session_keys(sessions)
    metric = F.col("metric")
    section = _index(FUTURES_BLOCKS, metric)
    day = F.date_format("session_date", "yyyy-MM-dd")
    label = FUTURES_LABELS.get(window, window.upper())
    head = _lines(sessions, 0,
                  (0, F.concat(F.lit("FUTURES SESSION VOLUME -- "), commodity, F.lit(" -- "), day, F.lit(f" -- {label}"))),
                  (1, "=" * 64))
    source = _lines(totals, 0, (2, F.concat(F.lit("  Source: "), F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_LABELS.items() for x in kv]), F.col("source")),
        F.col("source")))))
    nothing = _lines(sessions.join(totals.select(*keys), keys, "left_anti"), 0,
                     (3, ""), (4, "  No data for this session."))
    long = totals.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FUTURES_BLOCKS])).alias("m")) \
        .select(*keys, "m.metric", "m.value")
    known = F.col("value").isNotNull()
    body = _lines(
        long, section, (0, ""), (1, _title(FUTURES_BLOCKS, metric)), (2, "-" * 44),
        (3, F.when(known, F.concat(F.lit("  Total : "), whole(F.col("value"))))
            .otherwise("  n/a (historical seed -- night/day not available)")),
        (5, F.when(known, F.lit(""))))
    shown = rvol.filter(F.col("value").isNotNull())
    prev = _lines(shown.filter(F.col("tier") == listed(market)[0].tiers[0]), section,
                  (4, _previous(F.col("value"), F.col("prev"))))
    have = F.format_string("n/a (have %d of %d)", F.col("n").cast("int"), F.col("tier").cast("int"))
    tiers = rvol_lines(shown, section, have)

    def three(c: str) -> Column:
        return F.when(F.col(c).isNull(), NOT_AVAILABLE).otherwise(F.format_string("%.3f", F.bround(F.col(c), 3)))

    tilt = _lines(totals, 4, (0, ""), (1, "NIGHT vs DAY tilt"), (2, "-" * 44),
                  (3, F.concat(F.lit("  night_share (night/full)   : "), three("night_share"))),
                  (4, F.concat(F.lit("  night_day_ratio (night/day): "), three("night_day_ratio"))),
                  (5, ""), (6, "By contract (full | night | day):"),
                  (7, F.when(F.coalesce(F.col("full"), F.lit(0.0)) <= 0, F.lit("  (no volume recorded)"))))
    ranked = rank_contracts(contracts, keys, "full")
    line = F.concat(F.format_string("  %-8s (%s/%d)  ", "generic_code", "ice_code", "delivery_year"),
                    padded(whole(F.col("full")), 9), F.lit("  |  "), padded(whole(F.col("night")), 8),
                    F.lit("  |  "), padded(whole(F.col("day")), 8))
    by_contract = ranked.select(*keys, F.lit(4).alias("section"), (7 + F.col("rank")).alias("ord"),
                                line.alias("line"))
    foot = _lines(sessions, 9, (0, ""), (1, _generated(generated_at)))
    return _union(head, source, nothing, body, prev, tiers, tilt, by_contract, foot)


def _generated(at: Column) -> Column:
    return F.concat(F.lit("Generated: "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def _union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    out = first
    for df in rest:
        out = out.unionByName(df)
    return out

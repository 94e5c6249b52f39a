from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import symbology as S
from tidemark.functions.parsing import number_or_null, number_or_zero, window_cutoff
from tidemark.functions.sessions import is_closed, next_business_day
from tidemark.settings import COTTON, MONTH_LETTERS, MONTH_WORDS, Market


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize("generic,as_of,ice,year", [
    ("CTDEC1", "2026-06-17", "CTZ6", 2026), ("CTDEC2", "2026-06-17", "CTZ7", 2027),
    ("CTMAR1", "2026-06-17", "CTH7", 2027), ("CTMAR2", "2026-06-17", "CTH8", 2028),
    ("CTMAY1", "2026-06-17", "CTK7", 2027), ("CTJUL1", "2026-06-17", "CTN6", 2026),
    ("CTJUL2", "2026-06-17", "CTN7", 2027), (" ctdec1 ", "2026-06-17", "CTZ6", 2026),
    # position 1 on the first of the month, rolled on the second
    ("CTDEC1", "2026-12-01", "CTZ6", 2026), ("CTDEC1", "2026-12-02", "CTZ7", 2027),
    ("KCSEP1", "2026-06-17", "KCU6", 2026),
])
def test_resolve_generic(spark, generic, as_of, ice, year):
    info = one(spark, i=S.resolve_generic(F.lit(generic), day(as_of))).i
    assert (info.ice_code, info.delivery_year) == (ice, year)


@pytest.mark.parametrize("bad", ["CTZ6", "DEC1", "CTXXX1", "", "CTDEC", "CTDEC0", "CTDEC99"])
def test_unresolvable_names_are_null(spark, bad):
    assert one(spark, i=S.resolve_generic(F.lit(bad), day("2026-06-17"))).i is None


@pytest.mark.parametrize("code,slot", [
    ("CTZ6", "CTDEC1"), ("CTZ7", "CTDEC2"), ("CTV6", None), ("CTQ6", None), ("CTZ8", None), ("KCZ6", None),
    ("ctz6 ", "CTDEC1"), ("CT", None), ("CTZX", None), ("CTAA", None)])
def test_generic_of_exchange(spark, code, slot):
    assert one(spark, s=S.generic_of_exchange(F.lit(code), day("2026-06-17"))).s == slot


@pytest.mark.parametrize("code,parent", [
    ("CTU6", "CTZ"), ("CTX6", "CTZ"), ("CTF7", "CTH"), ("CTZ6", "CTZ"), ("CTH7", "CTH"), ("CTK7", "CTK"),
    ("CTN7", "CTN"), ("CTG7", None), ("CT", None)])
def test_parent_prefix(spark, code, parent):
    assert one(spark, p=S.parent_prefix(F.lit(code))).p == parent


@pytest.mark.parametrize("code,slot", [
    ("CTU6", "CTDEC1"), ("CTX6", "CTDEC1"), ("CTF7", "CTMAR1"), ("CTV6", None), ("CTQ6", None), ("CTZ8", None),
    ("KCZ6", None), ("CTHZ6", "CTDEC1"), ("", None)])
def test_option_slot(spark, code, slot):
    assert one(spark, s=S.option_slot(F.lit(code), day("2026-06-17"))).s == slot


def test_parse_exchange_code(spark):
    row = one(spark, a=S.exchange_parts(F.lit("CTZ6"), day("2026-06-17")), b=S.exchange_parts(F.lit("CTH7"), day("2026-06-17")),
              c=S.exchange_parts(F.lit("CT1"), day("2026-06-17")))
    assert tuple(row.a) == ("CT", "Z", 12, 2026)
    assert row.b.delivery_year == 2027
    assert row.c is None


def test_universe_is_eight_slots_and_excludes_october_and_august(spark):
    days = spark.range(1).select(day("2026-06-17").alias("session_date"))
    rows = S.universe(days).collect()
    assert {r.generic_code for r in rows} == set(COTTON.slots) and len(rows) == 8
    assert all(r.delivery_year >= 2026 for r in rows)


def test_enrich(spark):
    df = spark.createDataFrame([("2026-06-17", g) for g in ("CTMAR1", "CTOCT1", "CTAUG1", "CTDEC3", " ctdec1")],
                               "d string, g string").selectExpr("cast(d as date) d", "g")
    rows = {r.g: r for r in S.enrich(df, "g", "d").collect()}
    assert set(rows) == {"CTMAR1", "CTDEC1"}
    r = rows["CTMAR1"]
    assert (r.ice_code, r.delivery_year, r.month_name, r.position) == ("CTH7", 2027, "Mar", 1)


def _nth_live_year(as_of, month, position):
    count, year = 0, as_of.year
    while True:
        if date(year, month, 1) >= as_of:
            count += 1
            if count == position:
                return year
        year += 1


def test_every_day_and_slot_against_counting(spark):
    """The closed form against counting live deliveries, all tracked months, 2004-2030."""
    start = date(2004, 1, 1)
    n = (date(2030, 12, 31) - start).days + 1
    days = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("session_date"))
    got = {(r.session_date, r.generic_code): r.delivery_year for r in S.universe(days).collect()}
    for i in range(n):
        d = start + timedelta(days=i)
        for w in COTTON.active_months:
            for p in COTTON.positions:
                assert got[d, f"CT{w}{p}"] == _nth_live_year(d, MONTH_WORDS.index(w) + 1, p)


def test_round_trip_of_every_slot(spark):
    """Slot -> exchange code -> slot is the identity on every day."""
    days = spark.range(4000).select(F.date_add(day("2019-01-01"), F.col("id").cast("int")).alias("session_date"))
    u = S.universe(days)
    back = u.filter(S.generic_of_exchange(F.col("ice_code"), F.col("session_date")).eqNullSafe(F.col("generic_code")) == F.lit(False))
    assert back.count() == 0


def test_year_digit_covers_last_year_to_eight_ahead(spark):
    df = spark.range(10).select(F.col("id").cast("int").alias("digit"))
    years = {r.digit: r.y for r in df.select("digit", S.year_of_digit(F.col("digit"), day("2026-06-17")).alias("y")).collect()}
    assert years == {5: 2025, 6: 2026, 7: 2027, 8: 2028, 9: 2029, 0: 2030, 1: 2031, 2: 2032, 3: 2033, 4: 2034}


def test_all_month_letters(spark):
    df = spark.createDataFrame([(c,) for c in MONTH_LETTERS + "AB"], "c string")
    got = {r.c: r.m for r in df.select("c", S.month_of_letter(F.col("c")).alias("m")).collect()}
    assert got == {**{c: i + 1 for i, c in enumerate(MONTH_LETTERS)}, "A": None, "B": None}


def test_other_prefix(spark):
    kc = Market(prefix="KC", excluded_prefixes=(), serial_parents=())
    assert one(spark, s=S.option_slot(F.lit("KCZ6"), day("2026-06-17"), kc)).s == "KCDEC1"


@pytest.mark.parametrize("kw,want", [
    (dict(hh_mm=(7, 0), inclusive=False), "2026-06-17 07:00:00"), (dict(hh_mm=(7, 0)), "2026-06-17 07:00:59"),
    (dict(hh_mm=(14, 20)), "2026-06-17 14:20:59"), (dict(hh_mm=(21, 0), prev_day=True), "2026-06-16 21:00:59")])
def test_window_cutoff(spark, kw, want):
    assert str(one(spark, t=window_cutoff(day("2026-06-17"), **kw)).t) == want


@pytest.mark.parametrize("text,value", [
    ("100", 100.0), ("", None), (None, None), ("n/a", None), (" 12 ", 12.0), ("1d", None), ("1_000", None),
    ("1e3", 1000.0), ("-2.5", -2.5), (".5", 0.5), ("1.", 1.0), ("0x1", None), ("1f", None)])
def test_number_parsing(spark, text, value):
    c = F.lit(text).cast("string")
    row = one(spark, a=number_or_null(c), b=number_or_zero(c))
    assert row.a == value and row.b == (0.0 if value is None else value)


def test_closed_days_and_next_business_day(spark):
    row = one(spark, a=is_closed(day("2026-12-25")), b=is_closed(day("2026-06-20")), c=is_closed(day("2026-06-17")),
              d=next_business_day(day("2026-06-18")), e=next_business_day(day("2026-07-02")), f=next_business_day(day("2026-06-16")))
    assert (row.a, row.b, row.c) == (True, True, False)
    assert [str(x) for x in (row.d, row.e, row.f)] == ["2026-06-22", "2026-07-06", "2026-06-17"]

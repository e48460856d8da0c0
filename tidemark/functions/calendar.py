"""CAL-1…4: the US equity trading calendar as pure Column arithmetic.

Every property of a day (holiday, trading day, early close, session boundaries) is computed
from the day itself, so the calendar needs no lookup table, no join and no UDF: it runs inside
whole-stage codegen on any number of rows, in batch and in streaming queries alike.

Holidays of a day are taken from the holiday set of the day's *own* year (quirk Q14: an
observed New Year that falls on 31 December is never a holiday of that 31 December), and
Juneteenth applies to every year (Q15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Exchange time zone and session clock (New York local time, minutes).
EXCHANGE_TZ = "America/New_York"
PREMARKET_OPEN_MIN = 4 * 60
REGULAR_OPEN_MIN = 9 * 60 + 30
REGULAR_CLOSE_MIN = 16 * 60
EARLY_REGULAR_CLOSE_MIN = 13 * 60
AFTER_HOURS_CLOSE_MIN = 20 * 60
EARLY_AFTER_HOURS_CLOSE_MIN = 17 * 60

# Weekday numbers as returned by F.weekday: Monday = 0 … Sunday = 6.
MON, THU = 0, 3

# Longest run of non-trading days is 4 (holiday next to a weekend); 7 is a safe search bound.
_SEARCH_DAYS = 7


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def good_friday(year: Column) -> Column:
    """Good Friday of a year column, any Gregorian year: two days before the first Sunday after the
    paschal full moon (21 March plus an offset from the golden number and the century's corrections)."""
    century, golden = _idiv(year, 100), F.pmod(year, F.lit(19))
    age = F.pmod(century - _idiv(century, 4) - _idiv(8 * century + 13, 25) + 19 * golden + 15, F.lit(30))
    # the moon is never later than 18 April, and late ones of a cycle's second half a day earlier
    late = (age == 29) | ((age == 28) & (golden > 10))
    moon = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), age - late.cast("int"))
    return F.date_sub(F.next_day(moon, "Sunday"), 2)


def _holiday_rule(day: Column, gf: Column) -> Column:
    """Membership of ``day`` in the holiday set of its own year, as per-day predicates.

    Fixed-date holidays on a weekend are observed on the adjacent Friday / Monday; a New
    Year's Day on a Saturday is observed in the previous year and so never matches (Q14).
    """
    m, dom, wd = F.month(day), F.dayofmonth(day), F.weekday(day)

    def fixed(month: int, dom0: int) -> Column:
        return (m == month) & (((dom == dom0) & (wd < 5)) | ((dom == dom0 - 1) & (wd == 4))
                               | ((dom == dom0 + 1) & (wd == MON)))

    new_year = (m == 1) & (((dom == 1) & (wd < 5)) | ((dom == 2) & (wd == MON)))
    monday_in = lambda month, lo, hi: (m == month) & (wd == MON) & dom.between(lo, hi)
    return (new_year
            | monday_in(1, 15, 21)                           # Martin Luther King Jr. Day
            | monday_in(2, 15, 21)                           # Presidents' Day
            | (m.isin(3, 4) & (day == gf))                   # Good Friday
            | monday_in(5, 25, 31)                           # Memorial Day
            | fixed(6, 19)                                   # Juneteenth (all years, Q15)
            | fixed(7, 4)                                    # Independence Day
            | monday_in(9, 1, 7)                             # Labor Day
            | ((m == 11) & (wd == THU) & dom.between(22, 28))  # Thanksgiving
            | fixed(12, 25))                                 # Christmas


def is_holiday(day: Column, gf: Column | None = None) -> Column:
    return _holiday_rule(day, good_friday(F.year(day)) if gf is None else gf)


def is_trading_day(day: Column, gf: Column | None = None) -> Column:
    return (F.weekday(day) < 5) & ~is_holiday(day, gf)


def is_early_close(day: Column) -> Column:
    """Day after Thanksgiving; 24 Dec and 3 Jul when a weekday that is not itself a holiday.

    24 Dec / 3 Jul are holidays exactly when they are a Friday (observed Christmas /
    Independence Day), so the early close falls on Monday–Thursday only.
    """
    m, dom, wd = F.month(day), F.dayofmonth(day), F.weekday(day)
    return (((m == 11) & (wd == 4) & dom.between(23, 29))
            | ((m == 12) & (dom == 24) & (wd < 4))
            | ((m == 7) & (dom == 3) & (wd < 4)))


def _nearest_trading_day(day: Column, step: int) -> Column:
    """First trading day among day ± 1…7 (a higher-order function: the rule is written once)."""
    # Good Friday never lies within a week of a year boundary: one Easter lookup per row suffices.
    gf = good_friday(F.year(day))
    cands = F.transform(F.sequence(F.lit(1), F.lit(_SEARCH_DAYS)), lambda k: F.date_add(day, k * step))
    return F.element_at(F.filter(cands, lambda c: is_trading_day(c, gf)), 1)


def previous_trading_day(day: Column) -> Column:
    return _nearest_trading_day(day, -1)


def next_trading_day(day: Column) -> Column:
    return _nearest_trading_day(day, 1)


def ny_local(ts: Column) -> Column:
    """Wall-clock New York time of a UTC instant (session time zone is UTC)."""
    return F.from_utc_timestamp(ts, EXCHANGE_TZ)


def ny_date(ts: Column) -> Column:
    return F.to_date(ny_local(ts))


def at_ny_clock(day: Column, minutes: Column | int) -> Column:
    """UTC instant of a New York wall-clock time on a day."""
    m = _c(minutes)
    local = F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day),
                             _idiv(m, 60), F.pmod(m, F.lit(60)), F.lit(0))
    return F.to_utc_timestamp(local, EXCHANGE_TZ)


def infer_session(ts: Column) -> Column:
    """CAL-4: premarket / regular / after_hours / closed for an event instant.

    Session bounds are half-open [04:00, 09:30), [09:30, close), [close, after-hours close)
    in New York time; closes are 13:00 / 17:00 on early-close days.
    """
    local = ny_local(ts)

    def session(at: Column) -> Column:
        day, mod = at["day"], at["minute"]
        early = is_early_close(day)
        reg_close = F.when(early, EARLY_REGULAR_CLOSE_MIN).otherwise(REGULAR_CLOSE_MIN)
        ah_close = F.when(early, EARLY_AFTER_HOURS_CLOSE_MIN).otherwise(AFTER_HOURS_CLOSE_MIN)
        return (F.when(~is_trading_day(day), "closed")
                .when(mod < PREMARKET_OPEN_MIN, "closed")
                .when(mod < REGULAR_OPEN_MIN, "premarket")
                .when(mod < reg_close, "regular")
                .when(mod < ah_close, "after_hours")
                .otherwise("closed"))

    # day and minute are worked out once and handed to the rule, which reads them some fifty times; the bounds are
    # whole minutes, so seconds decide nothing
    at = F.struct(F.to_date(local).alias("day"), (F.hour(local) * 60 + F.minute(local)).alias("minute"))
    return F.get(F.transform(F.array(at), session), F.lit(0))


def with_calendar(df: DataFrame, day_col: str = "day") -> DataFrame:
    """CAL-1: attach calendar columns to a frame of days.

    Computed in stages (flags, then boundaries and neighbours) so that each intermediate is a
    column evaluated once per row rather than an expression tree repeated in every consumer.
    """
    day = F.col(day_col)
    s1 = df.withColumns({
        "is_weekend": F.weekday(day) >= 5,
        "is_holiday": is_holiday(day),
        "is_early_close": is_early_close(day),
        "previous_trading_day": previous_trading_day(day),
        "next_trading_day": next_trading_day(day),
    }).withColumn("is_trading_day", ~F.col("is_weekend") & ~F.col("is_holiday"))
    early = F.col("is_early_close")
    reg_close = F.when(early, EARLY_REGULAR_CLOSE_MIN).otherwise(REGULAR_CLOSE_MIN)
    ah_close = F.when(early, EARLY_AFTER_HOURS_CLOSE_MIN).otherwise(AFTER_HOURS_CLOSE_MIN)
    out = s1.withColumns({
        "premarket_open_at": at_ny_clock(day, PREMARKET_OPEN_MIN),
        "regular_open_at": at_ny_clock(day, REGULAR_OPEN_MIN),
        "regular_close_at": at_ny_clock(day, reg_close),
        "after_hours_close_at": at_ny_clock(day, ah_close),
    })
    order = ["is_weekend", "is_holiday", "is_trading_day", "is_early_close", "premarket_open_at",
             "regular_open_at", "regular_close_at", "after_hours_close_at", "previous_trading_day",
             "next_trading_day"]
    return out.select(*[c for c in df.columns if c not in order], *order)


def trading_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """CAL-1: one row per calendar day in [start, end]."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                             F.expr("interval 1 day"))).alias("day"))
    return with_calendar(days, "day")


def market_context(df: DataFrame, ts_col: str, prefix: str = "") -> DataFrame:
    """CAL-3: session context for each row's instant.

    Adds session, is_trading_day, is_early_close, trading_date, is_market_open, next_open_at,
    session_end_at, last_session_close_at, regular_open_at, regular_close_at. Staged like
    ``with_calendar``: day facts → session bounds → session → derived instants.
    """
    p = prefix
    ts = F.col(ts_col)
    cols = df.columns
    s1 = df.withColumn("_day", F.to_date(ny_local(ts)))
    d = F.col("_day")
    s2 = s1.withColumns({"_trading": is_trading_day(d), "_early": is_early_close(d),
                         "_nxt": next_trading_day(d), "_prv": previous_trading_day(d)})
    early, trading = F.col("_early"), F.col("_trading")
    s3 = s2.withColumns({
        "_pre_open": at_ny_clock(d, PREMARKET_OPEN_MIN),
        "_reg_open": at_ny_clock(d, REGULAR_OPEN_MIN),
        "_reg_close": at_ny_clock(d, F.when(early, EARLY_REGULAR_CLOSE_MIN).otherwise(REGULAR_CLOSE_MIN)),
        "_ah_close": at_ny_clock(d, F.when(early, EARLY_AFTER_HOURS_CLOSE_MIN).otherwise(AFTER_HOURS_CLOSE_MIN)),
        "_next_pre_open": at_ny_clock(F.col("_nxt"), PREMARKET_OPEN_MIN),
        "_prev_close": at_ny_clock(F.col("_prv"), F.when(is_early_close(F.col("_prv")), EARLY_AFTER_HOURS_CLOSE_MIN)
                                   .otherwise(AFTER_HOURS_CLOSE_MIN)),
    })
    pre_open, reg_open, reg_close, ah_close = (F.col(c) for c in ("_pre_open", "_reg_open", "_reg_close", "_ah_close"))
    session = (F.when(~trading, "closed").when(ts < pre_open, "closed").when(ts < reg_open, "premarket")
               .when(ts < reg_close, "regular").when(ts < ah_close, "after_hours").otherwise("closed"))
    s4 = s3.withColumn("_session", session)
    sess = F.col("_session")
    nxt_open = F.col("_next_pre_open")
    return s4.select(
        *cols,
        sess.alias(f"{p}session"),
        trading.alias(f"{p}is_trading_day"),
        early.alias(f"{p}is_early_close"),
        d.alias(f"{p}trading_date"),
        (sess != "closed").alias(f"{p}is_market_open"),
        F.when(~trading, nxt_open).when(ts < pre_open, pre_open).when(ts >= ah_close, nxt_open).alias(f"{p}next_open_at"),
        F.when(sess == "premarket", reg_open).when(sess == "regular", reg_close)
        .when(sess == "after_hours", ah_close).alias(f"{p}session_end_at"),
        F.when(trading & (ts >= pre_open), ah_close).otherwise(F.col("_prev_close")).alias(f"{p}last_session_close_at"),
        F.when(trading, reg_open).alias(f"{p}regular_open_at"),
        F.when(trading, reg_close).alias(f"{p}regular_close_at"),
    )

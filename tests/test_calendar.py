"""Calendar: hand-listed days (incl. Q14/Q15) and a full comparison against a plain-Python
calendar built from the holiday definitions, over twelve years of days."""
import datetime as dt

from dateutil.easter import easter as dateutil_easter

from pyspark.sql import functions as F

from tidemark.functions import calendar as CAL


def _py_holidays(year: int) -> set[dt.date]:
    def observed(d):
        return d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d

    def nth(month, weekday, n):
        d = dt.date(year, month, 1)
        d += dt.timedelta((weekday - d.weekday()) % 7)
        return d + dt.timedelta(7 * (n - 1))

    def last(month, weekday):
        d = (dt.date(year + (month == 12), month % 12 + 1, 1) - dt.timedelta(1))
        return d - dt.timedelta((d.weekday() - weekday) % 7)

    easter = dateutil_easter(year)          # an independent implementation
    return {observed(dt.date(year, 1, 1)), nth(1, 0, 3), nth(2, 0, 3), easter - dt.timedelta(2), last(5, 0),
            observed(dt.date(year, 6, 19)), observed(dt.date(year, 7, 4)), nth(9, 0, 1), nth(11, 3, 4),
            observed(dt.date(year, 12, 25))}


def _py_trading(d: dt.date) -> bool:
    return d.weekday() < 5 and d not in _py_holidays(d.year)


def _py_early(d: dt.date) -> bool:
    hol = _py_holidays(d.year)
    thanks = [x for x in hol if x.month == 11][0]
    out = {thanks + dt.timedelta(1)}
    for x in (dt.date(d.year, 12, 24), dt.date(d.year, 7, 3)):
        if x.weekday() < 5 and x not in hol:
            out.add(x)
    return d in out


def test_hand_listed_days(spark):
    cal = CAL.trading_calendar(spark, "2021-12-30", "2026-07-06")
    rows = {r["day"]: r for r in cal.collect()}
    assert rows[dt.date(2021, 12, 31)]["is_trading_day"]          # Q14: New Year 2022 observed on a Friday
    assert not rows[dt.date(2022, 1, 1)]["is_trading_day"]        # Saturday
    assert not rows[dt.date(2024, 3, 29)]["is_trading_day"]       # Good Friday
    assert rows[dt.date(2024, 7, 3)]["is_early_close"]
    assert rows[dt.date(2024, 11, 29)]["is_early_close"]
    assert not rows[dt.date(2026, 7, 3)]["is_trading_day"]        # observed Independence Day
    assert not rows[dt.date(2026, 7, 3)]["is_early_close"]
    assert not rows[dt.date(2022, 6, 20)]["is_trading_day"]       # Q15: Juneteenth observed
    assert rows[dt.date(2024, 3, 28)]["next_trading_day"] == dt.date(2024, 4, 1)
    assert rows[dt.date(2024, 1, 16)]["previous_trading_day"] == dt.date(2024, 1, 12)


def test_calendar_matches_brute_force(spark):
    cal = CAL.trading_calendar(spark, "2019-01-01", "2030-12-31").select(
        "day", "is_holiday", "is_trading_day", "is_early_close", "previous_trading_day", "next_trading_day")
    for r in cal.collect():
        d = r["day"]
        assert r["is_trading_day"] == _py_trading(d), d
        assert r["is_early_close"] == _py_early(d), d
        nxt = d + dt.timedelta(1)
        while not _py_trading(nxt):
            nxt += dt.timedelta(1)
        prv = d - dt.timedelta(1)
        while not _py_trading(prv):
            prv -= dt.timedelta(1)
        assert r["next_trading_day"] == nxt and r["previous_trading_day"] == prv, d


def test_sessions_and_dst(spark):
    cases = [
        ("2024-01-10 08:59:59", "closed"), ("2024-01-10 09:00:00", "premarket"), ("2024-01-10 14:30:00", "regular"),
        ("2024-01-10 21:00:00", "after_hours"), ("2024-01-11 01:00:00", "closed"),
        ("2024-07-08 13:30:00", "regular"), ("2024-07-08 13:29:59", "premarket"),    # EDT: 09:30 = 13:30 UTC
        ("2024-03-11 08:00:00", "premarket"),                                          # first Monday after DST
        ("2024-11-29 18:00:00", "after_hours"),                                        # early close at 13:00 ET
        ("2024-11-29 22:00:00", "closed"), ("2024-01-15 15:00:00", "closed"),          # MLK day
        ("2024-01-13 15:00:00", "closed"),                                             # Saturday
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    got = [r[0] for r in df.select(CAL.infer_session(F.col("ts"))).collect()]
    assert got == [s for _, s in cases]
    ctx = CAL.market_context(df, "ts").collect()
    for r, (_, s) in zip(ctx, cases):
        assert r["session"] == s
        assert r["is_market_open"] == (s != "closed")


def test_years_outside_living_memory(spark):
    from dateutil.easter import easter
    import datetime as dt
    from pyspark.sql import functions as F
    from tidemark.functions.calendar import good_friday, is_trading_day
    years = [1584, 1700, 1850, 1899, 2200, 2300, 2999]
    rows = spark.createDataFrame([(y,) for y in years], "y int").select("y", good_friday(F.col("y")).alias("g")).collect()
    assert {r["y"]: r["g"] for r in rows} == {y: easter(y) - dt.timedelta(days=2) for y in years}
    days = spark.sql("SELECT explode(sequence(DATE'2200-01-01', DATE'2200-12-31')) AS d")
    assert days.where(is_trading_day(F.col("d")).isNull()).count() == 0

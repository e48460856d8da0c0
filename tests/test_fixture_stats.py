"""The fixture mapping and MART-1/2 reproduce the statistics FIXTURES.md reports (§2.1 table)."""
import pytest

from tidemark.plans.catalog import Ctx

# FIXTURES.md §2.1 — events, in open session, daily rows, tickers, dates, hourly rows,
# anomaly split (normal / price_move / price_and_volume / volume_spike), rows without benchmark change.
EXPECTED = {
    "0.001": (1000, 440, 395, 22, 20, 440, (297, 29, 7, 62), 78),
    "0.01": (10000, 4471, 440, 22, 20, 4455, (309, 77, 9, 45), 60),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_statistics(spark, sf):
    c = Ctx(spark, f"/root/testdata/sf{sf}")
    d, h = c.daily, c.hourly
    flags = {r[0]: r[1] for r in d.groupBy("anomaly_flag").count().collect()}
    got = (c.raw.count(), c.raw.filter("market_session <> 'closed'").count(), d.count(),
           d.select("ticker").distinct().count(), d.select("trade_date").distinct().count(), h.count(),
           tuple(flags.get(k, 0) for k in ("normal", "price_move", "price_and_volume", "volume_spike")),
           d.filter("benchmark_price_change_pct is null").count())
    assert got == EXPECTED[sf]

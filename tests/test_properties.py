"""Property checks (SURVEY §5 (3)): exact rounding against Python decimals, drawdown ≤ 0,
price bounds, severity ≥ ratio, risk observed days in 1…7."""
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_ratio_half_up
from tidemark.plans import marts as M
from tidemark.plans.catalog import Ctx


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), st.integers(1, 10**9)), min_size=1, max_size=200),
       st.integers(0, 4))
def test_rounding_matches_decimal(spark, pairs, digits):
    df = spark.createDataFrame(pairs, "p long, q long")
    got = [r[0] for r in df.select(round_ratio_half_up(F.col("p"), F.col("q"), digits)).collect()]
    quant = Decimal(1).scaleb(-digits)
    # half away from zero on the exact rational value
    want = [(abs(Decimal(p)) / Decimal(q)).quantize(quant, rounding=ROUND_HALF_UP) * (1 if p >= 0 else -1)
            for p, q in pairs]
    assert got == want


def test_mart_invariants(spark):
    c = Ctx(spark, "/root/testdata/sf0.01")
    daily = c.daily
    assert M.stock_drawdown_recovery(daily).filter(F.col("drawdown_pct") > 0).count() == 0
    assert daily.filter((F.col("avg_price") < F.col("min_price")) | (F.col("avg_price") > F.col("max_price"))
                        | (F.col("open_price") < F.col("min_price")) | (F.col("close_price") > F.col("max_price"))
                        ).count() == 0
    anom = M.stock_anomaly_history(daily)
    assert anom.filter(F.col("anomaly_severity_score") < F.col("volume_vs_avg_ratio")).count() == 0
    risk = M.stock_risk_indicators(daily)
    assert risk.filter((F.col("observed_days") < 1) | (F.col("observed_days") > 7)).count() == 0
    assert daily.groupBy("ticker", "trade_date").count().filter("count > 1").count() == 0

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.correlation import best_partners
from tidemark.plans.queries import ticker_correlation


def exact(rows, k):
    """All pairs, one by one."""
    days = {}
    for t, d, v in rows:
        if v is not None:
            days.setdefault(t, {})[d] = round(v * 100)
    out = set()
    for a in days:
        found = []
        for b in days:
            common = days[a].keys() & days[b].keys()
            if a == b or len(common) < 2:
                continue
            x, y = [days[a][d] for d in common], [days[b][d] for d in common]
            n, sx, sy = len(common), sum(x), sum(y)
            below = (n * sum(i * i for i in x) - sx * sx) ** .5 * (n * sum(i * i for i in y) - sy * sy) ** .5
            top = n * sum(i * j for i, j in zip(x, y)) - sx * sy
            c = None if below == 0 else int(abs(top / below) * 10000 + .5) * (1 if top >= 0 else -1)
            found.append((c is None, -abs(c or 0), b, c, n))
        out |= {(a, b, c, n, i + 1) for i, (_, _, b, c, n) in enumerate(sorted(found)[:k])}
    return out


def test_blocks_equal_all_pairs(spark):
    r = random.Random(2)
    names = [f"T{i:02d}" for i in range(23)]
    days = [dt.date(2022, 11, 1) + dt.timedelta(days=i) for i in range(120)]  # over a year's end
    rows = []
    for j, t in enumerate(names):
        for d in days:
            if r.random() < (0.02 if j == 3 else 0.6):  # gaps; one ticker with hardly a day
                v = 1.5 if j == 5 else round(r.gauss(0, 2) + (d.day % 5) * (j % 3), 2)  # one without variance
                rows.append((t, d, None if r.random() < .03 else v))
    rows += [("LATE", dt.date(2024, 1, 2), 1.0), ("LATE", dt.date(2024, 1, 3), 2.0)]  # no common day with anyone
    df = spark.createDataFrame(rows, "ticker string, trade_date date, price_change_pct double") \
        .withColumn("price_change_pct", F.col("price_change_pct").cast("decimal(24,2)"))
    for k, block in ((4, 6), (30, 256), (1, 1)):
        got = {(x["ticker"], x["partner"], None if x["correlation"] is None else int(x["correlation"] * 10000), x["overlapping_days"], x["rank"])
               for x in best_partners(df, k, block).collect()}
        assert got == exact(rows, k), (k, block)
    one = {x["ticker"]: x["overlapping_days"] for x in ticker_correlation(df.where("price_change_pct IS NOT NULL"), "T00", 8).collect()}
    mine = {x["partner"]: x["overlapping_days"] for x in best_partners(df, 8).where("ticker = 'T00'").collect()}
    assert mine == one
    assert best_partners(df.limit(0)).collect() == []

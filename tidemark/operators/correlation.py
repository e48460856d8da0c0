"""SRV-7 for all tickers: each ticker's best partners by the correlation of their daily changes.

The correlation of two tickers is over the days that both have. With X the changes (tickers by days, 0
where a day is missing) and M the mask of days present, all it takes are the products X X^T, X M^T,
X² M^T and M M^T. They are computed for blocks of tickers and summed over years:

* a year of a block of tickers is one row; every pair of blocks gets the rows of both, by one shuffle;
* a task goes through a pair of blocks year by year and holds the sums of that pair alone;
* of a pair of blocks only the ``k`` best partners per ticker leave the task, then the best over all blocks.

Pairs of tickers are never rows. Changes are integers of a hundredth, so the sums are exact.

Missing days, null changes: not counted. Fewer than two common days: no partner. No variance on one
side over the common days: a null correlation, ranked last. Equal correlations: by the partner's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tickers in a block, about.
BLOCK = 256
DAYS = 367

_BEST = "ticker string, partner string, scaled long, overlapping_days long"


def _blocks(daily: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(tb, year, tickers, i, d, v): the changes of a block of tickers in a year, as parallel arrays."""
    rows = daily.where(F.col("price_change_pct").isNotNull()).select(
        "ticker", F.year("trade_date").alias("year"), F.dayofyear("trade_date").alias("d"),
        (F.col("price_change_pct") * 100).cast("long").alias("v"))
    n = rows.select("ticker").distinct().count()
    count = max(1, -(-n // block))
    rows = rows.withColumn("tb", F.pmod(F.xxhash64("ticker"), F.lit(count)).cast("int"))
    # a ticker's row within its block is by name, so it must be known over all years
    place = rows.select("ticker", "tb").distinct().withColumn("i", F.row_number().over(Window.partitionBy("tb").orderBy("ticker")) - 1)
    grouped = rows.join(place, ["ticker", "tb"]).groupBy("tb", "year").agg(F.collect_list(F.struct("i", "d", "v", "ticker")).alias("c"))
    return grouped, count


def best_partners(daily: DataFrame, k: int = 8, block: int = BLOCK) -> DataFrame:
    """(ticker, partner, correlation, overlapping_days, rank): the ``k`` partners with the largest |correlation|.

    ``daily``: (ticker, trade_date, price_change_pct), one row per ticker and day.
    """
    blocks, count = _blocks(daily, block)
    # every block goes to the pairs it belongs to: (a, b) with a <= b
    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("o")
    dealt = blocks.select("*", other).select(
        F.least("tb", "o").alias("a"), F.greatest("tb", "o").alias("b"), "year", "tb",
        F.col("c.i").alias("i"), F.col("c.d").alias("d"), F.col("c.v").alias("v"), F.col("c.ticker").alias("t"))
    found = dealt.repartition("a", "b").sortWithinPartitions("a", "b", "year", "tb").mapInArrow(_products(k), _BEST)
    order = Window.partitionBy("ticker").orderBy(F.abs("scaled").desc_nulls_last(), "partner")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "ticker", "partner", (F.col("scaled").cast("decimal(10,0)") / F.lit(10000)).cast("decimal(26,4)").alias("correlation"),
        "overlapping_days", "rank")


def _products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pair, names, sums, year = None, [{}, {}], None, []
        size = [0, 0]

        def dense(cells, side):
            i, d, v, t = cells
            names[side].update(zip(i, t))
            size[side] = max(size[side], max(i) + 1)
            x, m = (np.zeros((max(i) + 1, DAYS), dtype=np.int64) for _ in range(2))
            x[i, d], m[i, d] = v, 1
            return x, m

        def product(x, y):
            # exact in doubles while every sum stays below 2^53
            if abs(x).max(initial=0) * abs(y).max(initial=0) * DAYS < 1 << 53:
                return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64).astype(object)
            return x.astype(object) @ y.astype(object).T

        def square(x):
            return x * x if abs(x).max(initial=0) < 1 << 31 else x.astype(object) ** 2

        def add_year():
            """Six products of one year of both blocks."""
            nonlocal sums
            if len(year) == (1 if pair[0] == pair[1] else 2):
                (x, m), (y, n) = year[0], year[-1]
                parts = [product(m, n), product(x, n), product(m, y), product(square(x), n), product(m, square(y)), product(x, y)]
                shape = (max(size[0], len(x)), max(size[-1] if pair[0] != pair[1] else size[0], len(y)))
                total = np.zeros((6, *shape), dtype=object)
                if sums is not None:
                    total[:, :sums.shape[1], :sums.shape[2]] += sums
                for s, p in zip(total, parts):
                    s[:p.shape[0], :p.shape[1]] += p
                sums = total
            year.clear()

        def best():
            if sums is None:
                return None
            n, sx, sy, sxx, syy, sxy = sums
            top = (n * sxy - sx * sy).astype(np.float64)
            below = np.sqrt((n * sxx - sx * sx).astype(np.float64)) * np.sqrt((n * syy - sy * sy).astype(np.float64))
            with np.errstate(divide="ignore", invalid="ignore"):
                c = top / below
            scaled = np.sign(c) * np.floor(np.abs(c) * 10000 + 0.5)
            scaled[below == 0] = np.nan
            n = n.astype(np.int64)
            rows = []
            left, right = names[0], names[0] if pair[0] == pair[1] else names[1]
            sides = [(left, right, scaled, n)] + ([(right, left, scaled.T, n.T)] if pair[0] != pair[1] else [])
            for mine, others, value, days in sides:
                by_name = sorted((j for j in others if j < value.shape[1]), key=others.get)
                for i, name in mine.items():
                    if i >= len(value):
                        continue
                    some = [j for j in by_name if days[i, j] >= 2 and others[j] != name]
                    some.sort(key=lambda j: -abs(value[i, j]) if value[i, j] == value[i, j] else 1)  # stable: equal ones by name
                    rows += [(name, others[j], None if value[i, j] != value[i, j] else int(value[i, j]), int(days[i, j])) for j in some[:k]]
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                              names=["ticker", "partner", "scaled", "overlapping_days"])

        at = None
        for batch in batches:
            for a, b, when, tb, i, d, v, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "year", "tb", "i", "d", "v", "t"))):
                if (a, b, when) != at:
                    if at is not None:
                        add_year()
                    if pair is not None and (a, b) != pair:
                        if (out := best()) is not None:
                            yield out
                        names[0].clear(), names[1].clear()
                        sums, size[:] = None, [0, 0]
                    pair, at = (a, b), (a, b, when)
                year.append(dense((i, d, v, t), 0 if tb == a else 1))
        if at is not None:
            add_year()
            if (out := best()) is not None:
                yield out

    return run


"""Exact rounding helpers.

PostgreSQL rounds NUMERIC half away from zero. Means and ratios are therefore computed in
integer arithmetic (cents, volumes) and rounded with ``(2·p + q) div (2·q)``, which gives the
same digits as the exact rational value. No DOUBLE mean of prices is ever rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIG = "decimal(38,0)"


def cents(price: Column) -> Column:
    """DECIMAL(10,2) price → BIGINT cents (exact)."""
    return (price * 100).cast("bigint")


def round_ratio_half_up(p: Column, q: Column, digits: int) -> Column:
    """round(p / q, digits), half away from zero, for integer p and q > 0; returns DECIMAL.

    Computed as sign(p) · ((2·|p|·10^d + q) div (2·q)) · 10^-d on DECIMAL(38,0).
    """
    scale = 10 ** digits
    pa = F.abs(p).cast(_BIG)
    qa = q.cast(_BIG)
    n = exact_div(pa * F.lit(2 * scale) + qa, qa * 2)
    signed = F.when(p < 0, -n).otherwise(n)
    return (signed.cast(f"decimal(38,{digits})") / F.lit(scale)).cast(f"decimal(38,{digits})")


def exact_div(a: Column, b: Column) -> Column:
    """Integer floor division of non-negative DECIMAL(38,0) values, exact (no rounding)."""
    a = a.cast(_BIG)
    b = b.cast(_BIG)
    return ((a - F.pmod(a, b)) / b).cast(_BIG)


def pct_change_2(close: Column, prev: Column) -> Column:
    """ROUND((close − prev) / prev · 100, 2) on DECIMAL(10,2) inputs, exact; prev > 0."""
    return round_ratio_half_up((cents(close) - cents(prev)) * 100, cents(prev), 2)


def pct_change_4(close: Column, prev: Column) -> Column:
    """ROUND((close − prev) / prev · 100, 4), exact; prev > 0."""
    return round_ratio_half_up((cents(close) - cents(prev)) * 100, cents(prev), 4)


def event_order_key(ts: str = "event_time", ident: str = "id") -> Column:
    """Total order of events (time in µs, then id) as one DECIMAL(38,0) value.

    A single fixed-width key keeps ``min_by``/``max_by`` inside a hash aggregate (a struct key
    would force a sort-based aggregate). Ids take a whole signed 64-bit range within a microsecond."""
    time = F.unix_micros(F.col(ts)).cast("decimal(17,0)") * F.lit(str(2 ** 64)).cast("decimal(20,0)")
    return (time + F.col(ident).cast("decimal(20,0)")).cast(_BIG)

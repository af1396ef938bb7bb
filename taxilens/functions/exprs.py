"""Column expressions shared by the silver layer and the marts.

Every function returns a native Catalyst expression, so the work stays in
whole-stage codegen; nothing here is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Time-of-day buckets (inclusive hour ranges, checked in this order):
#   morning_rush 7-9, evening_rush 17-19, late_night 0-5, everything else off_peak
# Policy start: 2025-01-05 00:00:00 (congestion-era flag).
# Licence decode: HV0003 -> Uber, HV0005 -> Lyft, anything else -> Other.
# Wait-time action: avg > 10 -> incentive, avg > 7 -> monitor, else ok.
# ---------------------------------------------------------------------------
BUCKETS = (
    ("morning_rush", 7, 9),
    ("evening_rush", 17, 19),
    ("late_night", 0, 5),
)
OFF_PEAK = "off_peak"
POLICY_START = "2025-01-05 00:00:00"
LICENCE_PLATFORM = (("HV0003", "Uber"), ("HV0005", "Lyft"))
OTHER_PLATFORM = "Other"
WAIT_ACTIONS = ((10.0, "incentive"), (7.0, "monitor"))
WAIT_OK = "ok"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(literal: str) -> Column:
    """A TIMESTAMP_NTZ literal; trip timestamps carry no zone."""
    return F.lit(literal).cast("timestamp_ntz")


def time_bucket(hour: str | Column) -> Column:
    """Searched CASE over the hour of day."""
    h = col(hour)
    expr = None
    for name, lo, hi in BUCKETS:
        cond = h.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(OFF_PEAK))


def era_flag(ts: str | Column, start: str = POLICY_START) -> Column:
    """1 from the policy start on, else 0."""
    return F.when(col(ts) >= ts_ntz(start), F.lit(1)).otherwise(F.lit(0))


def iso_day_of_week(ts: str | Column) -> Column:
    """ISO day of week, Monday = 1 (P6).  Spark's dayofweek has Sunday = 1."""
    return (F.weekday(col(ts)) + F.lit(1)).cast("int")


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / NULLIF(den, 0) (P9); ANSI Spark raises on a zero divisor."""
    d = col(den)
    return col(num) / F.when(d == 0, F.lit(None)).otherwise(d)


def whole_minutes(start: str | Column, end: str | Column) -> Column:
    """Complete minutes from start to end, truncated toward zero."""
    return F.timestamp_diff("MINUTE", col(start), col(end))


def platform(licence: str | Column) -> Column:
    """Simple CASE on the licence code."""
    c = col(licence)
    expr = None
    for code, name in LICENCE_PLATFORM:
        expr = F.when(c == code, F.lit(name)) if expr is None else expr.when(c == code, F.lit(name))
    return expr.otherwise(F.lit(OTHER_PLATFORM))


def bucket_floor(x: str | Column, width: float) -> Column:
    """FLOOR(x / w) * w as a double."""
    return (F.floor(col(x) / F.lit(float(width))) * F.lit(float(width))).cast("double")


def round_half_away(x: str | Column, digits: int = 0) -> Column:
    """Round a double the way the reference's engine does.

    ``round(x, d)`` there multiplies by 10^d in binary floating point and
    rounds half away from zero (so 1.005 -> 1.0, 2.675 -> 2.68).  Spark's
    ``F.round`` rounds the decimal representation instead and would turn
    1.005 into 1.01, so the marts use this expression.
    """
    c = col(x).cast("double")
    f = float(10 ** digits)
    return (F.signum(c) * F.floor(F.abs(c) * F.lit(f) + F.lit(0.5)) / F.lit(f)).cast("double")


def pct_change(new: str | Column, base: str | Column) -> Column:
    """(new - base) * 100 / NULLIF(base, 0) over doubles."""
    b = col(base).cast("double")
    return (col(new).cast("double") - b) * F.lit(100.0) / F.when(b == 0, F.lit(None)).otherwise(b)


def div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0.  Under ANSI mode Spark raises on any
    division by zero (doubles included), so every divisor that can be 0 on
    some group goes through this."""
    d = col(den)
    return col(num) / F.when(d == 0, F.lit(None)).otherwise(d)


def growth_ratio_pct(new: str | Column, base: str | Column) -> Column:
    """(new - base) / base * 100, the order pandas ``pct_change() * 100`` uses."""
    b = col(base).cast("double")
    return div(col(new).cast("double") - b, b) * F.lit(100.0)


def clamp(x: str | Column, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]."""
    return F.greatest(F.least(col(x), F.lit(float(hi))), F.lit(float(lo)))


def wait_action(avg_wait: str | Column) -> Column:
    """Threshold label over an average wait."""
    a = col(avg_wait)
    (t1, l1), (t2, l2) = WAIT_ACTIONS
    return F.when(a > t1, F.lit(l1)).when(a > t2, F.lit(l2)).otherwise(F.lit(WAIT_OK))


def change_label(pct: str | Column, strong: float, labels: tuple[str, str, str]) -> Column:
    """Three-way label: pct < strong, pct < 0, otherwise."""
    p = col(pct)
    return (F.when(p < F.lit(float(strong)), F.lit(labels[0]))
            .when(p < F.lit(0.0), F.lit(labels[1]))
            .otherwise(F.lit(labels[2])))


def month_start(year: str | Column, month: str | Column) -> Column:
    """First day of the month as a DATE."""
    return F.make_date(col(year), col(month), F.lit(1))


def count_if(cond: Column) -> Column:
    """COUNT of rows where cond holds, as a bigint."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def avg_if(cond: Column, x: str | Column) -> Column:
    return F.avg(F.when(cond, col(x)))


def sum_if(cond: Column, x: str | Column) -> Column:
    return F.sum(F.when(cond, col(x)))


def round_half_even(x: str | Column, digits: int = 0) -> Column:
    """Round like pandas/numpy ``.round(d)``: scale in binary, then to the
    nearest integer with ties to even (``rint``).  Used where the reference
    rounds in pandas rather than in SQL."""
    c = col(x).cast("double")
    f = float(10 ** digits)
    return (F.rint(c * F.lit(f)) / F.lit(f)).cast("double")


HASH_BITS = 52


def hash_key(*parts: str | Column | int) -> Column:
    """52 bits of md5 over integers joined by ``|``: the one pseudo-random key
    of every shuffle, assignment and sample.  Text of integers has one form
    in every engine, so a SQL oracle gives the same key."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else col(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def hundredths(x: str | Column) -> Column:
    """A double as whole hundredths, for :func:`hash_key`."""
    return F.floor(col(x) * F.lit(100.0) + F.lit(0.5)).cast("long")

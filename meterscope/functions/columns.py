"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import COMMODITIES, SCM_MODULUS, WIDE_MODULUS


def round_half_away(v: Column, places: int) -> Column:
    """Rounding of the binary value, halves away from zero."""
    p = float(10**places)
    return F.signum(v) * F.floor(F.abs(v) * p + 0.5) / p


def clamp01(v: Column) -> Column:
    """v within 0 and 1; 0 for null, which greatest and least pass over."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def modulus(msg_type: Column) -> Column:
    return F.when(msg_type == "SCM", SCM_MODULUS).otherwise(WIDE_MODULUS)


def step(raw: Column, mod: Column) -> Column:
    """Counter step: as it is if not negative, wrapped if that goes less than half the range, else null."""
    return F.when(raw >= 0, raw).when((raw + mod >= 0) & (raw + mod < mod * 0.5), raw + mod)


def commodity(endpoint_type: Column) -> Column:
    out = F.when(endpoint_type.isNull(), "unknown")
    for name, codes in COMMODITIES.items():
        out = out.when(endpoint_type.isin(*codes), name)
    return out.otherwise("other")


def time_bucket(ts: Column, minutes: int) -> Column:
    """Start of the bucket; the origin is that of 2000-01-03, which only shows for odd widths."""
    return F.window(ts, f"{minutes} minutes", f"{minutes} minutes", f"{15780960 % minutes} minutes")["start"]


def bucket_of(ts: Column, minutes: Column) -> Column:
    """Start of the bucket, of a width in a column; widths that divide a day."""
    width = 60 * minutes
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / width) * width)


def local(ts: Column, tz: str) -> Column:
    """Wall-clock time in tz of a UTC instant."""
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(local(ts, tz))


def unit_factor(unit: Column, table: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, factor in table.items():
        out = F.when(F.upper(unit) == name, factor).otherwise(out)
    return out


def correlation() -> Column:
    """Pearson r of y on x from regression sums; null where one side is constant."""
    xx, yy, xy = F.regr_sxx("y", "x"), F.regr_syy("y", "x"), F.regr_sxy("y", "x")
    return F.try_divide(xy, F.nullif(F.sqrt(xx * yy), F.lit(0.0)))

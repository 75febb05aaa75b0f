"""Joins that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast, counted before each use.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 4 << 20
#: Spans up to which each point is held against every span.
FEW_SPANS = 64
#: Widths of the bins that spans are put in: each level's bins are FACTOR times as wide as those of the one before.
FIRST_BIN_S, FACTOR, LEVELS = 60, 4, 18


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has no more than `rows` rows and about `size` bytes. It is counted: it should be small or stored."""
    wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    bytes_ = sum(wide, F.lit(16 * len(df.columns))).cast("long")
    got = df.select(bytes_.alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= size


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it fits, else as it is."""
    return F.broadcast(df) if fits(df, most) else df


def _width(level: Column) -> Column:
    """Microseconds of a level's bins."""
    return F.element_at(F.array(*[F.lit(1_000_000 * FIRST_BIN_S * FACTOR**k) for k in range(LEVELS)]), level + 1)


def _binned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans once for each bin that they reach, one or two: the level is the first whose bins are as wide as the span."""
    length = F.unix_micros(end) - F.unix_micros(start)
    level = F.coalesce(*[F.when(length <= 1_000_000 * FIRST_BIN_S * FACTOR**k, F.lit(k)) for k in range(LEVELS)], F.lit(LEVELS - 1))
    rows = spans.where(F.col(start) < F.col(end)).withColumn("__level", level)
    first, last = (F.floor(at / _width(F.col("__level"))) for at in (F.unix_micros(start), F.unix_micros(end) - 1))
    return rows.withColumn("__bin", F.explode(F.sequence(first, last)))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str = "start", end: str = "end", most: int = FEW_SPANS) -> DataFrame:
    """Rows of points whose time `at` lies in [start, end) of a row of spans. A few dozen spans (counted) are
    held against each point. More are put in bins by their own length, a span of years as one of minutes in two at
    most, and a point meets the bin that it lies in on each level that has spans; the span side is broadcast
    only if it is counted to be small."""
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    if fits(spans, most):
        return points.join(F.broadcast(spans), inside)
    bins = _binned(spans, start, end)
    levels = sorted(r[0] for r in bins.select("__level").distinct().collect())  # LEVELS at most
    asked = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    asked = asked.withColumn("__bin", F.floor(F.unix_micros(at) / _width(F.col("__level"))))
    return asked.join(broadcast_checked(bins), ["__level", "__bin"]).where(inside).drop("__level", "__bin")

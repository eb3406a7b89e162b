"""Daily metric summaries of a timestamped Parquet table (trips by default).

One ``groupBy`` over calendar parts: Spark runs partial aggregates in the
map tasks (the percentile keeps a bounded sketch per group), so the shuffle
carries one row per day and map task. The year filter is written as a range
on the raw time stamp, so both bounds reach the Parquet scan as pushed
filters (``year(ts) = y`` would not be pushed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.operators.quantiles import quantiles_of_counts, value_counts

# The trip summary of the reference (output name, measure, column).
TRIP_SPEC = (
    ("num_trips", "count", None),
    ("mean_trip_distance", "avg", "trip_distance"),
    ("max_mta_tax", "max", "mta_tax"),
    ("q95_fare_amount", "q95", "fare_amount"),
    ("min_tip_amount", "min", "tip_amount"),
    ("mean_passenger_count", "ceil_avg", "passenger_count"),
)
TRIP_TS = "tpep_pickup_datetime"
GRAINS = {"year": ("dt_year",), "month": ("dt_year", "dt_month"), "day": ("dt_year", "dt_month", "dt_day")}


def with_date_parts(df: DataFrame, ts: str = TRIP_TS) -> DataFrame:
    """Adds ``dt_year, dt_month, dt_day`` (INT) of column ``ts``."""
    c = F.col(ts)
    return df.withColumns({"dt_year": F.year(c), "dt_month": F.month(c), "dt_day": F.dayofmonth(c)})


def year_range(df: DataFrame, ts: str, year: int) -> Column:
    """``ts`` in calendar year ``year`` as a range predicate that Parquet can push down."""
    dtype = df.schema[ts].dataType.simpleString()
    lo = F.lit(f"{year:04d}-01-01 00:00:00").cast(dtype)
    hi = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast(dtype)
    return (F.col(ts) >= lo) & (F.col(ts) < hi)


def _share(kind: str) -> float | None:
    """0.95 for ``q95``, None for other measures."""
    return int(kind[1:]) / 100.0 if kind[:1] == "q" and kind[1:].isdigit() else None


def _measure(name: str, kind: str, col: str | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1)).alias(name)
    c = F.col(col)
    if kind == "avg":
        return F.avg(c).alias(name)
    if kind == "max":
        return F.max(c).alias(name)
    if kind == "min":
        return F.min(c).alias(name)
    if kind == "sum":
        return F.sum(c).alias(name)
    if kind == "ceil_avg":
        return F.ceil(F.avg(c)).alias(name)
    if _share(kind) is not None:
        return F.percentile_approx(c, _share(kind)).alias(name)
    raise ValueError(f"unknown measure {kind!r}")


def daily_summary(
    df: DataFrame,
    ts: str = TRIP_TS,
    year: int | None = None,
    spec=TRIP_SPEC,
    quantile: str = "approx",
    grain: str = "day",
) -> DataFrame:
    """One row per day (or month / year): the date parts and the ``spec`` measures.

    ``spec`` is a sequence of ``(name, measure, column)`` with measure one of
    ``count, avg, sum, max, min, ceil_avg, qNN`` (NN-th percentile).
    ``quantile="approx"`` uses ``percentile_approx`` (default accuracy);
    ``"exact"`` counts values and ranks them (see ``quantiles``; no group's
    values are held in memory). Newest first.
    """
    if quantile not in ("approx", "exact"):
        raise ValueError(f"quantile must be 'approx' or 'exact', not {quantile!r}")
    keys = GRAINS[grain]
    if year is not None:
        df = df.filter(year_range(df, ts, year))
    parts = with_date_parts(df, ts)
    ranked = [m for m in spec if quantile == "exact" and _share(m[1]) is not None]
    out = parts.groupBy(*keys).agg(*[_measure(n, k, c) for n, k, c in spec if (n, k, c) not in ranked])
    for col in dict.fromkeys(c for _, _, c in ranked):
        shares = {n: _share(k) for n, k, c in ranked if c == col}
        found = quantiles_of_counts(value_counts(parts, list(keys), col), list(keys), col, shares)
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *shares)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(found, same, "left")
    return out.select(*keys, *[n for n, _, _ in spec]).orderBy(*[F.desc(k) for k in keys])


def daily_overview(daily: DataFrame, count_col: str = "num_trips") -> DataFrame:
    """One row: ``days, total_trips, mean_trips_per_day, first_date, last_date``."""
    d = F.make_date("dt_year", "dt_month", "dt_day")
    return daily.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(count_col).alias("total_trips"),
        F.avg(count_col).alias("mean_trips_per_day"),
        F.min(d).alias("first_date"),
        F.max(d).alias("last_date"),
    )

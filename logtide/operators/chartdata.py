"""Data behind the two charts of the usage analysis (drawing is left to the caller).

* bar chart: applications per cluster;
* histogram of application durations in the most used cluster, 50 equal
  bins, with a Gaussian density curve over it.

The choice of cluster, its bounds and bandwidth come from one aggregate per
cluster; nothing is collected to the driver. The density is evaluated per *distinct*
duration with its multiplicity and summed per grid point, so map tasks ship
at most ``grid`` partial sums each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.operators.ranking import place_by_count


def bar_data(summary: DataFrame) -> DataFrame:
    """``cluster_id, num_applications, bar``: bar 1 is the most used cluster (ties by id); rows are not sorted."""
    return place_by_count(summary.select("cluster_id", "num_applications"), "num_applications", "cluster_id", "bar")


def _chart_values(timeline: DataFrame, cluster: str | None, scale: str) -> tuple[DataFrame, DataFrame]:
    """Values of one cluster with their bounds attached, and the bounds row.

    One aggregate over the timeline gives, per cluster, the application count
    (to pick the most used cluster) and ``n, lo, hi, sd`` of the values; the
    chosen cluster's single row (``limit(1)`` or one id) is broadcast -- a
    proven bound -- onto the timeline rows, which both selects the cluster's
    applications and attaches the bounds. ``scale="log"`` uses ``ln`` of
    positive durations.
    """
    d = F.col("duration_seconds")
    if scale == "linear":
        xv = d
    elif scale == "log":
        xv = F.when(d > 0, F.ln(d))
    else:
        raise ValueError(f"scale must be 'linear' or 'log', not {scale!r}")
    per = timeline.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("apps"),
        F.count(xv).alias("n"),
        F.min(xv).alias("lo"),
        F.max(xv).alias("hi"),
        F.stddev_samp(xv).alias("sd"),
    )
    if cluster is None:
        chosen = per.orderBy(F.desc("apps"), "cluster_id").limit(1)
    else:
        chosen = per.filter(F.col("cluster_id") == cluster)
    chosen = chosen.select(
        "cluster_id", "n", "lo", "hi", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw")
    )
    values = (
        timeline.select("cluster_id", xv.alias("x"))
        .filter(F.col("x").isNotNull())
        .join(F.broadcast(chosen), "cluster_id")
    )
    return values, chosen


def duration_histogram(
    timeline: DataFrame, bins: int = 50, scale: str = "linear", cluster: str | None = None
) -> DataFrame:
    """``bin, bin_lo, bin_hi, count`` for ``bins`` equal-width bins (empty bins = 0).

    Bins span [min, max]; the maximum falls in the last bin. ``scale="log"``
    bins ``ln(duration)`` of positive durations (edges are then in ln
    seconds). ``cluster=None`` takes the most used cluster (ties: smallest
    id). Edges are rounded to 9 decimals. Counts per bin are partial
    aggregates, so map tasks ship at most ``bins`` rows. Rows are not sorted
    (a sort of ``bins`` rows would cost two more jobs); order by ``bin``
    when drawing or writing.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    values, chosen = _chart_values(timeline, cluster, scale)
    lo, hi = F.col("lo"), F.col("hi")
    binned = F.when(hi > lo, F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins) + 1, F.lit(bins))).otherwise(1)
    counts = values.groupBy(binned.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = chosen.filter(lo.isNotNull()).select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    # ``counts`` has at most ``bins`` rows: a proven bound for the broadcast.
    return (
        edges.join(F.broadcast(counts), "bin", "left")
        .select(
            "bin",
            F.round(lo + (hi - lo) * (F.col("bin") - 1) / bins, 9).alias("bin_lo"),
            F.round(lo + (hi - lo) * F.col("bin") / bins, 9).alias("bin_hi"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        )
    )


def duration_density(
    timeline: DataFrame, grid: int = 200, bins: int = 50, cluster: str | None = None
) -> DataFrame:
    """``point, x, density, count_scale`` on ``grid`` points from min to max duration.

    Gaussian kernel, bandwidth by Scott's rule ``sd * n^(-1/5)``.
    ``count_scale`` is the density in counts per bin of a ``bins``-bin
    histogram, for drawing it over that histogram. Density is reported as
    ``round(density * 1e6, 6)`` (per million); null when there are fewer than
    two distinct durations.

    Each distinct duration is expanded to the ``grid`` points with its
    multiplicity as weight; sums per point are partial aggregates. Rows are
    not sorted; order by ``point`` when drawing or writing.
    """
    if grid < 2 or bins < 1:
        raise ValueError("grid must be at least 2 and bins at least 1")
    values, _ = _chart_values(timeline, cluster, "linear")
    n, lo, hi, bw = (F.col(c) for c in ("n", "lo", "hi", "bw"))
    g = lo + (hi - lo) * F.col("point") / (grid - 1)
    kernel = F.col("w") * F.exp(-0.5 * F.pow((g - F.col("x")) / bw, 2))
    sums = (
        values.groupBy("x", "n", "lo", "hi", "bw")
        .agg(F.count(F.lit(1)).alias("w"))
        .select("x", "w", "n", "lo", "hi", "bw", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
        .groupBy("point", "n", "lo", "hi", "bw")
        .agg(F.sum(kernel).alias("k"))
    )
    dens = F.when(bw > 0, F.col("k") / (n * bw * math.sqrt(2 * math.pi)))
    return sums.select(
        F.col("point").cast("int").alias("point"),
        F.round(g, 6).alias("x"),
        F.round(dens * 1e6, 6).alias("density"),
        F.round(dens * n * (hi - lo) / bins, 6).alias("count_scale"),
    )

"""Text reports as DataFrames of numbered lines (``line_no INT, line STRING``).

Rows come unsorted (``write_text`` writes them in ``line_no`` order; sorting
here would only add jobs). The reports are built from small aggregates (the one-row level totals,
the cluster summary) with ``format_string``, so they come out of the same
plan as the numbers they print; ``sinks.write_text`` writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.functions import parse as P
from logtide.operators import levels as L
from logtide.operators import usage as U
from logtide.operators.ranking import place_by_count

# Report texts and number formats.
LEVEL_LINE = {"cluster": "  %-5s: %,10d (%5.2f%%)", "local": "  %-6s: %,10d (%6.2f%%)"}
USAGE_HEADER = (
    "Total unique clusters: %d",
    "Total applications: %d",
    "Average applications per cluster: %.2f",
    "",
    "Most heavily used clusters:",
)
USAGE_LINE = "  Cluster %s: %d applications"


def level_report(
    logs: DataFrame | None = None,
    style: str = "cluster",
    mode: str = "substring",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Summary text of the level distribution.

    ``style="cluster"``: plain totals, the four levels in fixed order with
    zero rows. ``style="local"``: totals with thousands separators, seen
    levels by count (ties by name), wider columns.

    Every line is built from the one row of ``level_totals`` in a single
    projection (pass ``totals`` to reuse a computed one), so the report costs
    one scan and one tiny shuffle.
    """
    if style not in LEVEL_LINE:
        raise ValueError(f"style must be one of {sorted(LEVEL_LINE)}")
    total_fmt = "%,d" if style == "local" else "%d"
    t = totals if totals is not None else L.level_totals(logs, mode)
    counts = [F.col(f"n_{name}") for name in P.LEVELS]
    valid = sum(counts, F.lit(0))
    unique = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    # Sort key first: ascending order of (rank key, name) gives the report order.
    levels = F.array(
        *[
            F.struct(
                (F.lit(i) if style == "cluster" else -c).alias("key"),
                F.lit(name).alias("name"),
                c.alias("n"),
            )
            for i, (name, c) in enumerate(zip(P.LEVELS, counts), start=1)
        ]
    )
    if style == "local":
        levels = F.filter(levels, lambda x: x["n"] > 0)
    levels = F.sort_array(levels)

    def line(no, text):
        return F.struct(no.cast("int").alias("line_no"), text.alias("line"))

    header = F.array(
        line(F.lit(1), F.format_string("Total log lines processed: " + total_fmt, "total_lines")),
        line(F.lit(2), F.format_string("Total lines with log levels: " + total_fmt, valid)),
        line(F.lit(3), F.format_string("Unique log levels found: %d", unique)),
        line(F.lit(4), F.lit("")),
        line(F.lit(5), F.lit("Log level distribution:")),
    )
    body = F.transform(
        levels,
        lambda x, i: line(
            i + 6, F.format_string(LEVEL_LINE[style], x["name"], x["n"], L._share(x["n"], F.col("valid")))
        ),
    )
    return (
        t.select("total_lines", valid.alias("valid"), *counts)
        .select(F.inline(F.concat(header, body)))
    )


def usage_report(summary: DataFrame) -> DataFrame:
    """Statistics text of the cluster summary (clusters, applications, most used)."""
    stats = U.usage_stats(summary)
    header = stats.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("line_no"), F.format_string(USAGE_HEADER[0], "num_clusters").alias("line")),
                F.struct(F.lit(2).alias("line_no"), F.format_string(USAGE_HEADER[1], "num_applications").alias("line")),
                F.struct(F.lit(3).alias("line_no"), F.format_string(USAGE_HEADER[2], "avg_apps_per_cluster").alias("line")),
                F.struct(F.lit(4).alias("line_no"), F.lit(USAGE_HEADER[3]).alias("line")),
                F.struct(F.lit(5).alias("line_no"), F.lit(USAGE_HEADER[4]).alias("line")),
            )
        )
    )
    places = place_by_count(summary.select("cluster_id", "num_applications"), "num_applications", "cluster_id", "place")
    body = places.select(
        (F.col("place") + 5).cast("int").alias("line_no"),
        F.format_string(USAGE_LINE, "cluster_id", "num_applications").alias("line"),
    )
    return header.unionByName(body)

"""Level distribution: counts, summary, report goldens, sample properties."""

from logtide.operators import levels as L
from logtide.plans import reports as R
from logtide.sources.logs import read_logs
from logtree import all_lines, write_tree

# Golden texts: the committed reports of the original runs, rebuilt here from
# their own counts (cluster run and local run).
CLUSTER_REPORT = """Total log lines processed: 33236604
Total lines with log levels: 27410336
Unique log levels found: 3

Log level distribution:
  INFO : 27,389,482 (99.92%)
  WARN :      9,595 ( 0.04%)
  ERROR:     11,259 ( 0.04%)
  DEBUG:          0 ( 0.00%)"""
LOCAL_REPORT = """Total log lines processed: 1,911
Total lines with log levels: 1,601
Unique log levels found: 3

Log level distribution:
  INFO  :      1,573 ( 98.25%)
  ERROR :         14 (  0.87%)
  WARN  :         14 (  0.87%)"""


def totals(spark, total, info, warn, error, debug=0):
    return spark.createDataFrame([(total, info, warn, error, debug)],
                                 "total_lines bigint, n_INFO bigint, n_WARN bigint, n_ERROR bigint, n_DEBUG bigint")


def text(df):
    return "\n".join(r.line for r in df.orderBy("line_no").collect())


def test_report_goldens(spark):
    t = totals(spark, 33236604, 27389482, 9595, 11259)
    assert text(R.level_report(totals=t, style="cluster")) == CLUSTER_REPORT
    t = totals(spark, 1911, 1573, 14, 14)
    assert text(R.level_report(totals=t, style="local")) == LOCAL_REPORT


def test_counts_zero_fill_and_order(spark, tmp):
    logs = read_logs(spark, write_tree(tmp))
    got = [(r.log_level, r["count"], r.rank) for r in L.level_counts(logs).collect()]
    # substring mode: INFORMATION counts as INFO; "WARN ... ERROR" counts as WARN
    assert got == [("INFO", 11, 1), ("WARN", 1, 2), ("ERROR", 1, 3), ("DEBUG", 1, 4)]
    local = [(r.log_level, r["count"]) for r in L.level_counts(logs, mode="word", zero_fill=False, order="count").collect()]
    assert local == [("INFO", 10), ("DEBUG", 1), ("ERROR", 1), ("WARN", 1)]
    pct = {r.log_level: r.pct for r in L.level_counts(logs).collect()}
    assert abs(sum(pct.values()) - 100.0) < 1e-9


def test_summary_counts_blank_lines(spark, tmp):
    logs = read_logs(spark, write_tree(tmp))
    r = L.level_summary(logs).collect()[0]
    assert (r.total_lines, r.valid_lines, r.unique_levels) == (len(all_lines()), 14, 4)
    empty = spark.createDataFrame([], "value string")
    r = L.level_summary(empty).collect()[0]
    assert (r.total_lines, r.valid_lines, r.unique_levels) == (0, 0, 0)
    assert [x["count"] for x in L.level_counts(empty).collect()] == [0, 0, 0, 0]
    assert [x.pct for x in L.level_counts(empty).collect()] == [0.0] * 4


def test_sample_properties(spark, tmp):
    logs = read_logs(spark, write_tree(tmp))
    level_lines = {v for _, v in all_lines() if L.P.LEVELS and any(x in v for x in L.P.LEVELS)}
    for method in ("hash", "rand"):
        s = L.level_sample(logs, n=5, seed=42, method=method).collect()
        assert len(s) == 5
        assert all(r.log_entry in level_lines and r.log_level in L.P.LEVELS for r in s)
        assert all(r.log_entry[:2].isdigit() for r in s)  # lines with a time stamp preferred
    a = [r.log_entry for r in L.level_sample(logs, n=5, method="hash").collect()]
    b = [r.log_entry for r in L.level_sample(logs.repartition(3), n=5, method="hash").collect()]
    assert a == b  # hash sample does not depend on partitioning
    # fewer stamped lines than n: only stamped lines come back
    few = spark.createDataFrame([("17/01/01 00:00:00 INFO a: b", "p"), ("INFO no stamp", "p"), ("WARN no stamp", "p")],
                                "value string, file_path string")
    assert [r.log_entry for r in L.level_sample(few, n=10).collect()] == ["17/01/01 00:00:00 INFO a: b"]
    # no stamped line at all: all level lines are candidates
    none = spark.createDataFrame([("INFO no stamp", "p"), ("WARN no stamp", "p")], "value string, file_path string")
    assert len(L.level_sample(none, n=10).collect()) == 2


def test_occurrences_components_quality(spark, tmp):
    logs = read_logs(spark, write_tree(tmp))
    occ = {r.log_level: r.occurrences for r in L.level_occurrences(logs).collect()}
    assert occ["ERROR"] == 2 and occ["WARN"] == 1
    comps = {r.component: r.entries for r in L.component_counts(logs, top=None).collect()}
    assert comps["ApplicationMaster"] == 6 and comps["executor.Executor"] == 3
    q = L.parse_quality(logs).collect()[0]
    assert (q.total_lines, q.no_timestamp, q.blank_lines) == (len(all_lines()), 4, 1)
    assert L.lines_containing(logs, "ERROR").count() == 2

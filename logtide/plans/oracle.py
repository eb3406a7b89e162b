"""DuckDB twins of the registered queries (the correctness oracle).

``FEED`` rebuilds the log feed of ``logtide.sources.feeds.event_log_lines``
from ``events`` with plain string formatting and also carries, for every
line, the values the Spark side must *parse* (time, level, component). Most
oracles use those known values and no regex, so they check the parsers
independently.
"""

from __future__ import annotations

FEED = r"""
ev AS (
  SELECT event_id AS e, user_id AS u, CAST(floor(value) AS BIGINT) AS v, event_type AS kind, ts,
         strftime(ts, '%y/%m/%d %H:%M:%S') AS tt,
         strftime(ts + to_seconds(CAST(floor(value) AS BIGINT)), '%y/%m/%d %H:%M:%S') AS tt_fin,
         date_trunc('second', ts) AS t0,
         date_trunc('second', ts + to_seconds(CAST(floor(value) AS BIGINT))) AS t_fin,
         CAST(1704067200000 + CASE WHEN user_id % 10 < 6 THEN 0 ELSE user_id % 6 END AS BIGINT) AS c,
         printf('%04d', user_id) AS a,
         event_id % (1 + user_id % 8) + 1 AS k, CASE WHEN user_id % 9 = 4 THEN 2 ELSE 1 END AS p,
         CAST(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS again,
         CAST(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sagain,
         printf('%d.%d in stage %d.%d (TID %d)', event_id % 13, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END,
                event_id % 7, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, event_id) AS task,
         1408 + 1024 * (user_id % 8) AS mem, 1 + event_id % 5 AS cores,
         printf('rdd_%d_%d', user_id % 30, event_id % 20) AS rdd,
         printf('%d.%d', CAST(floor(value) AS BIGINT), event_id % 10) AS size
  FROM (SELECT * REPLACE (ts + to_days(CAST(31 * (user_id % 3) AS INTEGER)) AS ts) FROM events)),
evp AS (
  SELECT *, CASE WHEN e % 50 = 49 THEN printf('/logs/misc/daemon-%d.log', u % 4)
                 ELSE printf('/logs/application_%d_%s/container_%d_%s_%02d_%06d.log', c, a, c, a, p, k) END AS file_path,
         CASE WHEN e % 50 = 49 THEN '' ELSE printf('application_%d_%s', c, a) END AS app_id,
         CASE WHEN e % 50 = 49 THEN '' ELSE printf('container_%d_%s_%02d_%06d', c, a, p, k) END AS cont
  FROM ev),
feed AS (
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 0 AS seq, t0 AS lts, 'INFO' AS lvl, 'INFO' AS wlvl,
         'executor.CoarseGrainedExecutorBackend' AS comp,
         printf('%s INFO executor.CoarseGrainedExecutorBackend: Got assigned task %d', tt, e) AS value
  FROM evp WHERE kind = 'click'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 1, t0, 'INFO', 'INFO', 'executor.Executor',
         printf('%s INFO executor.Executor: Running task %s', tt, task)
  FROM evp WHERE kind = 'click'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 2, t0, 'INFO', 'INFO', 'rdd.HadoopRDD',
         printf('%s INFO rdd.HadoopRDD: Input split: hdfs://storage-1:8020/data/part-%d.txt:%d+%d',
                tt, e % 5, v * 1000, 1000 + e % 997)
  FROM evp WHERE kind = 'click'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 3, t_fin, 'INFO', 'INFO', 'executor.Executor',
         printf('%s INFO executor.Executor: Finished task %s. %d bytes result sent to driver',
                tt_fin, task, 1000 + v * 13)
  FROM evp WHERE kind = 'click' AND e % 10 <> 0
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 0, CASE WHEN e % 97 = 0 THEN NULL ELSE t0 END,
         'INFO', 'INFO', 'python.PythonRunner',
         printf('%s INFO python.PythonRunner: Times: total = %d, boot = %d, init = %d, finish = %d',
                CASE WHEN e % 97 = 0 THEN '24/13/40 25:61:61' ELSE tt END, v + 50, e % 40 - 20, e % 30, v)
  FROM evp WHERE kind = 'purchase'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 1, t0, 'INFO', 'INFO', printf('module%02d.Stage', e % 25),
         printf('%s INFO module%02d.Stage: step %d done', tt, e % 25, e)
  FROM evp WHERE kind = 'purchase'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 4, t0, 'INFO', 'INFO', 'executor.Executor',
         printf('%s INFO executor.Executor: Starting executor ID %d on host host-%d', tt, k, (u + k) % 9)
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 0, t0, 'INFO', 'INFO', 'yarn.YarnAllocator',
         printf('%s INFO yarn.YarnAllocator: Will request %d executor containers, each with %d cores and %d MB memory including 384 MB overhead',
                tt, 1 + e % 16, cores, mem)
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 1, t0, 'INFO', 'INFO', 'yarn.YarnAllocator',
         printf('%s INFO yarn.YarnAllocator: Submitted container request (host: Any, capability: <memory:%d, vCores:%d>)',
                tt, mem, cores)
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 2, t0, 'INFO', 'INFO', 'storage.MemoryStore',
         printf('%s INFO storage.MemoryStore: MemoryStore started with capacity %d.%d MB', tt, v + 100, e % 10)
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 3, t0, 'WARN', 'WARN', 'scheduler.TaskSetManager',
         printf('%s WARN scheduler.TaskSetManager: Lost task %d.0 in stage %d.0 (TID %d, host-%d): ExecutorLostFailure%s',
                tt, e % 13, e % 7, e, u % 9, CASE WHEN e % 4 = 0 THEN ' (ERROR exit code 143)' ELSE '' END)
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 0, t0, 'INFO', 'INFO', 'storage.MemoryStore',
         printf('%s INFO storage.MemoryStore: Block broadcast_%d stored as values in memory (estimated size %s KB, free %d.%d MB)',
                tt, e % 50, size, 100 + u % 400, e % 7)
  FROM evp WHERE kind = 'view'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 1, t0, 'INFO', 'INFO', 'storage.BlockManagerInfo',
         printf('%s INFO storage.BlockManagerInfo: Added broadcast_%d_piece0 in memory on host-%d:%d (size: %s KB, free: %d.%d GB)',
                tt, e % 50, u % 9, 40000 + e % 1000, size, u % 20, e % 10)
  FROM evp WHERE kind = 'view'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 2, t0, 'INFO', 'INFO',
         CASE WHEN e % 3 = 0 THEN 'spark.CacheManager' ELSE 'storage.BlockManager' END,
         CASE WHEN e % 3 = 0 THEN printf('%s INFO spark.CacheManager: Partition %s not found, computing it', tt, rdd)
              ELSE printf('%s INFO storage.BlockManager: Found block %s locally', tt, rdd) END
  FROM evp WHERE kind = 'view'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 3, t0, 'INFO', 'INFO', 'broadcast.TorrentBroadcast',
         printf('%s INFO broadcast.TorrentBroadcast: Started reading broadcast variable %d', tt, e % 50)
  FROM evp WHERE kind = 'view'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 4, t0, 'INFO', '', '',
         printf('%s storage.BlockManager: INFORMATIONAL usage report for %s', tt, rdd)
  FROM evp WHERE kind = 'view'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 0, t0, 'ERROR', 'ERROR', 'executor.Executor',
         printf('%s ERROR executor.Executor: Exception in task %s', tt, task)
  FROM evp WHERE kind = 'error'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 1, NULL, '', '', '',
         printf('java.io.IOException: Disk %d unavailable', e % 4)
  FROM evp WHERE kind = 'error'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 2, NULL, '', '', '',
         printf(chr(9) || 'at org.apache.spark.storage.DiskStore.put(DiskStore.scala:%d)', 40 + e % 60)
  FROM evp WHERE kind = 'error'
  UNION ALL
  SELECT file_path, app_id, cont, c, a, k, e, u, v, kind, ts, 3, NULL, '', '', '', ''
  FROM evp WHERE kind = 'error' AND e % 3 = 0
)"""

TIMELINE = r"""
timeline AS (
  SELECT CAST(c AS VARCHAR) AS cluster_id, app_id AS application_id, a AS app_number,
         min(lts) AS start_time, max(lts) AS end_time,
         CAST(greatest(date_diff('second', min(lts), max(lts)), 0) AS DOUBLE) AS duration_seconds
  FROM feed WHERE lts IS NOT NULL AND app_id <> ''
  GROUP BY ALL),
summary AS (
  SELECT cluster_id, count(*) AS num_applications, min(start_time) AS cluster_first_app,
         max(end_time) AS cluster_last_app
  FROM timeline GROUP BY cluster_id),
top AS (
  SELECT cluster_id FROM summary ORDER BY num_applications DESC, cluster_id LIMIT 1),
top_apps AS (
  SELECT * FROM timeline WHERE cluster_id IN (SELECT cluster_id FROM top))"""


def with_feed(body: str, timeline: bool = False) -> str:
    ctes = FEED + ("," + TIMELINE if timeline else "")
    return "WITH " + ctes.strip() + "\n" + body


LEVELS_DIM = "(VALUES ('INFO', 1), ('WARN', 2), ('ERROR', 3), ('DEBUG', 4)) AS d(log_level, fixed_rank)"


def level_queries() -> dict[str, str]:
    hist = "hist AS (SELECT lvl AS log_level, count(*) AS n FROM feed WHERE lvl <> '' GROUP BY lvl)"
    return {
        "level_counts": with_feed(
            f""", {hist}
SELECT d.log_level, CAST(coalesce(h.n, 0) AS BIGINT) AS count,
       CASE WHEN sum(coalesce(h.n, 0)) OVER () > 0
            THEN coalesce(h.n, 0) / sum(coalesce(h.n, 0)) OVER () * 100.0 ELSE 0.0 END AS pct,
       CAST(d.fixed_rank AS INTEGER) AS rank
FROM {LEVELS_DIM} LEFT JOIN hist h ON h.log_level = d.log_level"""
        ),
        "level_counts_word": with_feed(
            """, hist AS (SELECT wlvl AS log_level, count(*) AS n FROM feed WHERE wlvl <> '' GROUP BY wlvl)
SELECT log_level, n AS count, n / sum(n) OVER () * 100.0 AS pct,
       CAST(row_number() OVER (ORDER BY n DESC, log_level) AS INTEGER) AS rank
FROM hist"""
        ),
        "level_histogram": with_feed("SELECT lvl AS log_level, count(*) AS n FROM feed GROUP BY lvl"),
        "level_report_local": with_feed(
            """, s AS (SELECT count(*) AS total, count_if(lvl <> '') AS valid, count(DISTINCT nullif(lvl, '')) AS uniq FROM feed),
lv AS (SELECT lvl AS log_level, count(*) AS n FROM feed WHERE lvl <> '' GROUP BY lvl)
SELECT 1 AS line_no, printf('Total log lines processed: %,d', total) AS line FROM s
UNION ALL SELECT 2, printf('Total lines with log levels: %,d', valid) FROM s
UNION ALL SELECT 3, printf('Unique log levels found: %d', uniq) FROM s
UNION ALL SELECT 4, ''
UNION ALL SELECT 5, 'Log level distribution:'
UNION ALL
SELECT CAST(5 + row_number() OVER (ORDER BY n DESC, log_level) AS INTEGER),
       printf('  %-6s: %,10d (%6.2f%%)', log_level, n, CASE WHEN valid > 0 THEN n / valid * 100.0 ELSE 0.0 END)
FROM lv, s"""
        ),
        "sql_view_count": with_feed("SELECT count(*) AS total FROM feed"),
        "level_summary": with_feed(
            """
SELECT count(*) AS total_lines, CAST(count_if(lvl <> '') AS BIGINT) AS valid_lines,
       CAST(count(DISTINCT nullif(lvl, '')) AS BIGINT) AS unique_levels
FROM feed"""
        ),
        "level_report": with_feed(
            f""", {hist},
s AS (SELECT count(*) AS total, count_if(lvl <> '') AS valid, count(DISTINCT nullif(lvl, '')) AS uniq FROM feed),
lv AS (SELECT d.log_level, d.fixed_rank, coalesce(h.n, 0) AS n FROM {LEVELS_DIM} LEFT JOIN hist h USING (log_level))
SELECT 1 AS line_no, printf('Total log lines processed: %d', total) AS line FROM s
UNION ALL SELECT 2, printf('Total lines with log levels: %d', valid) FROM s
UNION ALL SELECT 3, printf('Unique log levels found: %d', uniq) FROM s
UNION ALL SELECT 4, ''
UNION ALL SELECT 5, 'Log level distribution:'
UNION ALL
SELECT 5 + fixed_rank, printf('  %-5s: %,10d (%5.2f%%)', log_level, n,
       CASE WHEN valid > 0 THEN n / valid * 100.0 ELSE 0.0 END)
FROM lv, s"""
        ),
        "level_sample": with_feed(
            """, src AS (
  SELECT value AS log_entry, lvl AS log_level, lts IS NOT NULL OR (value LIKE '24/13/40 %') AS has_ts,
         md5('42:' || file_path || ':' || value) AS k
  FROM feed WHERE lvl <> ''),
top AS (SELECT * FROM src ORDER BY has_ts DESC, k LIMIT 10)
SELECT log_entry, log_level FROM top
WHERE CAST(has_ts AS INTEGER) = (SELECT max(CAST(has_ts AS INTEGER)) FROM top)"""
        ),
        "level_occurrences": with_feed(
            """
SELECT log_level, count(*) AS occurrences
FROM (SELECT unnest(regexp_extract_all(value, '(INFO|WARN|ERROR|DEBUG)', 1)) AS log_level FROM feed)
GROUP BY log_level"""
        ),
        "component_counts": with_feed(
            """
SELECT comp AS component, count(*) AS entries FROM feed WHERE comp <> ''
GROUP BY comp ORDER BY entries DESC, component LIMIT 20"""
        ),
        "parse_quality": with_feed(
            """
SELECT count(*) AS total_lines,
       CAST(count_if(lts IS NULL AND value NOT LIKE '24/13/40 %') AS BIGINT) AS no_timestamp,
       CAST(count_if(lvl = '') AS BIGINT) AS no_level,
       CAST(count_if(comp = '') AS BIGINT) AS no_component,
       CAST(count_if(trim(value) = '') AS BIGINT) AS blank_lines
FROM feed"""
        ),
        "error_lines": with_feed(
            """
SELECT file_path, value FROM feed WHERE contains(value, 'ERROR')"""
        ),
    }


def usage_queries() -> dict[str, str]:
    return {
        "app_timeline": with_feed("SELECT * FROM timeline", timeline=True),
        "file_spans": with_feed(
            """
SELECT file_path, min(lts) AS first_ts, max(lts) AS last_ts, count(*) AS lines
FROM feed WHERE lts IS NOT NULL GROUP BY file_path"""
        ),
        "cluster_summary": with_feed("SELECT * FROM summary", timeline=True),
        "usage_stats": with_feed(
            """
SELECT count(*) AS num_clusters, CAST(coalesce(sum(num_applications), 0) AS BIGINT) AS num_applications,
       CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(num_applications), 0) AS BIGINT) / count(*) ELSE 0.0 END
         AS avg_apps_per_cluster
FROM summary""",
            timeline=True,
        ),
        "usage_report": with_feed(
            """, st AS (SELECT count(*) AS n, CAST(sum(num_applications) AS BIGINT) AS apps FROM summary)
SELECT 1 AS line_no, printf('Total unique clusters: %d', n) AS line FROM st
UNION ALL SELECT 2, printf('Total applications: %d', apps) FROM st
UNION ALL SELECT 3, printf('Average applications per cluster: %.2f', CASE WHEN n > 0 THEN apps / n ELSE 0.0 END) FROM st
UNION ALL SELECT 4, ''
UNION ALL SELECT 5, 'Most heavily used clusters:'
UNION ALL
SELECT CAST(5 + row_number() OVER (ORDER BY num_applications DESC, cluster_id) AS INTEGER),
       printf('  Cluster %s: %d applications', cluster_id, num_applications)
FROM summary""",
            timeline=True,
        ),
        "top_cluster": with_feed(
            "SELECT cluster_id, num_applications FROM summary ORDER BY num_applications DESC, cluster_id LIMIT 1",
            timeline=True,
        ),
        "top_cluster_apps": with_feed("SELECT * FROM top_apps", timeline=True),
        "longest_application": with_feed(
            "SELECT * FROM timeline ORDER BY duration_seconds DESC, application_id LIMIT 1", timeline=True
        ),
        "cluster_activity": with_feed(
            """
SELECT cluster_id, num_applications, cluster_first_app, cluster_last_app,
       CAST(greatest(date_diff('second', cluster_first_app, cluster_last_app), 0) AS DOUBLE) AS active_seconds
FROM summary""",
            timeline=True,
        ),
        "cluster_share": with_feed(
            """
SELECT cluster_id, num_applications,
       num_applications / (SELECT sum(num_applications) FROM summary) * 100.0 AS share_pct
FROM summary""",
            timeline=True,
        ),
        "cluster_work": with_feed(
            """
SELECT cluster_id, count(*) AS num_applications, sum(duration_seconds) AS total_seconds,
       avg(duration_seconds) AS mean_seconds
FROM timeline GROUP BY cluster_id""",
            timeline=True,
        ),
        "monthly_starts": with_feed(
            "SELECT strftime(start_time, '%Y-%m') AS month, count(*) AS applications FROM timeline GROUP BY 1",
            timeline=True,
        ),
        "duration_profile": with_feed(
            """, st AS (
  SELECT cluster_id, count(*) AS n, quantile_disc(duration_seconds, 0.5) AS median_seconds,
         quantile_disc(duration_seconds, 0.95) AS p95_seconds, max(duration_seconds) AS max_seconds,
         sum(duration_seconds) AS total_seconds
  FROM timeline GROUP BY cluster_id)
SELECT st.cluster_id, n, median_seconds, p95_seconds, max_seconds,
       CASE WHEN total_seconds > 0
            THEN sum(CASE WHEN t.duration_seconds >= p95_seconds THEN t.duration_seconds ELSE 0.0 END) / total_seconds
       END AS top_share
FROM st JOIN timeline t USING (cluster_id)
GROUP BY st.cluster_id, n, median_seconds, p95_seconds, max_seconds, total_seconds""",
            timeline=True,
        ),
        "cluster_distribution": with_feed(
            """
SELECT cluster_id, CAST(make_timestamp(CAST(cluster_id AS BIGINT) * 1000) AS TIMESTAMP) AS cluster_started,
       num_applications, cluster_first_app, cluster_last_app
FROM summary""",
            timeline=True,
        ),
        "concurrency": with_feed(
            """, tev AS (
  SELECT cluster_id, start_time AS t, 1 AS d FROM timeline
  UNION ALL SELECT cluster_id, end_time, -1 FROM timeline),
net AS (SELECT cluster_id, t, sum(d) AS net FROM tev GROUP BY ALL),
run AS (SELECT cluster_id, t, sum(net) OVER (PARTITION BY cluster_id ORDER BY t) AS active FROM net)
SELECT cluster_id, CAST(max(active) AS BIGINT) AS peak_concurrent, arg_min(t, (-active, t)) AS peak_time
FROM run GROUP BY cluster_id""",
            timeline=True,
        ),
        "start_gaps": with_feed(
            """
SELECT cluster_id, application_id, start_time,
       lag(application_id) OVER w AS prev_application_id,
       CAST(date_diff('second', lag(start_time) OVER w, start_time) AS DOUBLE) AS gap_seconds
FROM timeline
WINDOW w AS (PARTITION BY cluster_id ORDER BY start_time, application_id)""",
            timeline=True,
        ),
    }


def _daily(src: str, ts: str, measures: str, where: str = "", parts: int = 3) -> str:
    cols = [f"CAST(year({ts}) AS INTEGER) AS dt_year", f"CAST(month({ts}) AS INTEGER) AS dt_month",
            f"CAST(day({ts}) AS INTEGER) AS dt_day"][:parts]
    return f"SELECT {', '.join(cols)}, {measures} FROM {src} {where} GROUP BY ALL"


TRIP_MEASURES = """count(*) AS num_trips, avg(l_quantity) AS mean_trip_distance, max(l_tax) AS max_mta_tax,
  quantile_disc(l_extendedprice, 0.95) AS q95_fare_amount, min(l_discount) AS min_tip_amount,
  CAST(ceil(avg(l_linenumber)) AS BIGINT) AS mean_passenger_count"""
Y1997 = "WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"


def daily_queries() -> dict[str, str]:
    daily = _daily("lineitem", "l_shipdate", TRIP_MEASURES, Y1997)
    return {
        "daily_summary": daily,
        "daily_overview": f"""
SELECT count(*) AS days, CAST(sum(num_trips) AS BIGINT) AS total_trips, avg(num_trips) AS mean_trips_per_day,
       min(make_date(dt_year, dt_month, dt_day)) AS first_date, max(make_date(dt_year, dt_month, dt_day)) AS last_date
FROM ({daily})""",
        "monthly_summary_exact": _daily("lineitem", "l_shipdate", TRIP_MEASURES, parts=2),
        "orders_daily_summary": _daily(
            "orders",
            "o_orderdate",
            """count(*) AS num_orders, round(avg(o_totalprice), 6) AS mean_totalprice,
  max(o_totalprice) AS max_totalprice, quantile_disc(o_totalprice, 0.95) AS q95_totalprice,
  min(o_totalprice) AS min_totalprice""",
        ),
    }


def chart_queries() -> dict[str, str]:
    hist = """, x AS ({x}),
st AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
c AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS bin,
             count(*) AS n FROM x, st GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) * (b - 1) / 50, 9) AS bin_lo,
       round(lo + (hi - lo) * b / 50, 9) AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM range(1, 51) r(b) CROSS JOIN st LEFT JOIN c ON c.bin = b
WHERE lo IS NOT NULL"""
    return {
        "bar_data": with_feed(
            """
SELECT cluster_id, num_applications,
       CAST(row_number() OVER (ORDER BY num_applications DESC, cluster_id) AS INTEGER) AS bar
FROM summary""",
            timeline=True,
        ),
        "duration_histogram": with_feed(hist.format(x="SELECT duration_seconds AS x FROM top_apps"), timeline=True),
        "duration_histogram_log": with_feed(
            hist.format(x="SELECT ln(duration_seconds) AS x FROM top_apps WHERE duration_seconds > 0"), timeline=True
        ),
        "duration_density": with_feed(
            """, x AS (SELECT duration_seconds AS x FROM top_apps),
st AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM x),
b AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
w AS (SELECT x, count(*) AS w FROM x GROUP BY x),
pts AS (SELECT CAST(p AS INTEGER) AS point FROM range(0, 200) r(p)),
k AS (SELECT point, sum(w * exp(-0.5 * pow(((lo + (hi - lo) * point / 199) - x) / bw, 2))) AS k
      FROM pts, w, b GROUP BY point),
d AS (SELECT point, lo + (hi - lo) * point / 199 AS g,
             CASE WHEN bw > 0 THEN k / (n * bw * sqrt(2 * pi())) END AS dens, n, lo, hi FROM k, b)
SELECT point, round(g, 6) AS x, round(dens * 1e6, 6) AS density, round(dens * n * (hi - lo) / 50, 6) AS count_scale
FROM d""",
            timeline=True,
        ),
    }


BASE = "app_id AS application_id, cont AS container_id"
TASKS = r"""
tasks AS (
  SELECT app_id AS application_id, cont AS container_id, e % 7 AS stage, sagain AS stage_attempt, e % 13 AS task,
         again AS attempt, e AS tid,
         t0 AS started, CASE WHEN e % 10 <> 0 THEN t_fin END AS finished,
         CASE WHEN e % 10 <> 0 THEN 1000 + v * 13 END AS result_bytes,
         CASE WHEN e % 10 <> 0 THEN CAST(date_diff('second', t0, t_fin) AS DOUBLE) END AS duration_seconds
  FROM evp WHERE kind = 'click'),
conts AS (
  SELECT DISTINCT app_id AS application_id, cont AS container_id,
         CASE WHEN k = 1 THEN 'master' ELSE 'executor' END AS role, CAST(p AS INTEGER) AS app_attempt,
         CAST(k AS INTEGER) AS container_no
  FROM evp WHERE app_id <> '')"""


def message_queries() -> dict[str, str]:
    def q(body: str) -> str:
        return with_feed(body)

    tables = {
        "executor_requests": q(f"""
SELECT {BASE}, t0 AS ts, 1 + e % 16 AS executors, 1 + e % 5 AS cores, mem AS memory_mb,
       CAST(384 AS BIGINT) AS overhead_mb
FROM evp WHERE kind = 'signup'"""),
        "container_requests": q(f"""
SELECT {BASE}, t0 AS ts, mem AS memory_mb, 1 + e % 5 AS vcores FROM evp WHERE kind = 'signup'"""),
        "task_events": q(f"""
SELECT {BASE}, t0 AS ts, 'Running' AS event, e % 13 AS task, again AS attempt, e % 7 AS stage,
       sagain AS stage_attempt, e AS tid, CAST(NULL AS BIGINT) AS result_bytes
FROM evp WHERE kind = 'click'
UNION ALL
SELECT {BASE}, t_fin, 'Finished', e % 13, again, e % 7, sagain, e, 1000 + v * 13
FROM evp WHERE kind = 'click' AND e % 10 <> 0"""),
        "task_assigned": q(f"SELECT {BASE}, t0 AS ts, e AS tid FROM evp WHERE kind = 'click'"),
        "input_splits": q(f"""
SELECT {BASE}, t0 AS ts, printf('hdfs://storage-1:8020/data/part-%d.txt', e % 5) AS input_file,
       v * 1000 AS offset, 1000 + e % 997 AS length
FROM evp WHERE kind = 'click'"""),
        "python_times": q(f"""
SELECT {BASE}, CASE WHEN e % 97 = 0 THEN NULL ELSE t0 END AS ts, v + 50 AS total_ms, e % 40 - 20 AS boot_ms,
       e % 30 AS init_ms, v AS finish_ms
FROM evp WHERE kind = 'purchase'"""),
        "memory_capacity": q(f"""
SELECT {BASE}, t0 AS ts, CAST(printf('%d.%d', v + 100, e % 10) AS DOUBLE) * 1048576.0 AS capacity_bytes
FROM evp WHERE kind = 'signup'"""),
        "block_stored": q(f"""
SELECT {BASE}, t0 AS ts, printf('broadcast_%d', e % 50) AS block, 'values' AS stored_as,
       CAST(size AS DOUBLE) * 1024.0 AS size_bytes,
       CAST(printf('%d.%d', 100 + u % 400, e % 7) AS DOUBLE) * 1048576.0 AS free_bytes
FROM evp WHERE kind = 'view'"""),
        "block_added": q(f"""
SELECT {BASE}, t0 AS ts, printf('broadcast_%d_piece0', e % 50) AS block, printf('host-%d', u % 9) AS host,
       40000 + e % 1000 AS port, CAST(size AS DOUBLE) * 1024.0 AS size_bytes,
       CAST(printf('%d.%d', u % 20, e % 10) AS DOUBLE) * 1073741824.0 AS free_bytes
FROM evp WHERE kind = 'view'"""),
        "cache_lookups": q(f"""
SELECT {BASE}, t0 AS ts, rdd AS block, e % 3 <> 0 AS hit FROM evp WHERE kind = 'view'"""),
        "executor_starts": q(f"""
SELECT {BASE}, t0 AS ts, k AS executor, printf('host-%d', (u + k) % 9) AS host FROM evp WHERE kind = 'signup'"""),
        "broadcast_reads": q(f"SELECT {BASE}, t0 AS ts, e % 50 AS broadcast_id FROM evp WHERE kind = 'view'"),
    }
    counts = "SELECT '{0}' AS message, count(*) AS lines, count(ts) AS stamped, min(ts) AS first_ts, max(ts) AS last_ts FROM ({1}) HAVING count(*) > 0"
    return tables | {"message_counts": " UNION ALL ".join(counts.format(name, sql) for name, sql in tables.items())}


def task_queries() -> dict[str, str]:
    def q(body: str) -> str:
        return "WITH " + (FEED + "," + TASKS).strip() + "\n" + body

    return {
        "tasks": q("SELECT * FROM tasks"),
        "unfinished_tasks": q("SELECT * FROM tasks WHERE finished IS NULL"),
        "idle_containers": q("""
SELECT application_id, container_id, role FROM conts c WHERE role = 'executor' AND NOT EXISTS (
  SELECT 1 FROM tasks t WHERE t.application_id = c.application_id AND t.container_id = c.container_id)"""),
        "resource_requests": q("""
SELECT app_id AS application_id, count(*) AS requests, CAST(sum(1 + e % 16) AS BIGINT) AS executors,
       CAST(sum((1 + e % 16) * (1 + e % 5)) AS BIGINT) AS cores, CAST(sum((1 + e % 16) * mem) AS BIGINT) AS memory_mb
FROM evp WHERE kind = 'signup' GROUP BY app_id"""),
        "request_shapes": q("""
SELECT 1 + e % 5 AS cores, mem AS memory_mb, count(*) AS requests, CAST(sum(1 + e % 16) AS BIGINT) AS executors
FROM evp WHERE kind = 'signup' GROUP BY ALL"""),
        "request_vs_seen": q("""
, req AS (SELECT app_id AS application_id, CAST(sum(1 + e % 16) AS BIGINT) AS requested
          FROM evp WHERE kind = 'signup' AND app_id <> '' GROUP BY app_id),
seen AS (SELECT application_id, count(*) AS seen FROM conts WHERE role = 'executor' GROUP BY application_id)
SELECT application_id, requested, CAST(coalesce(seen, 0) AS BIGINT) AS seen FROM req LEFT JOIN seen USING (application_id)"""),
        "task_time_by_app": q("""
SELECT application_id, count(*) AS tasks, count(finished) AS finished_tasks, avg(duration_seconds) AS mean_seconds
FROM tasks GROUP BY application_id"""),
        "stage_skew": q("""
SELECT application_id, stage, stage_attempt, count(*) AS tasks, quantile_disc(duration_seconds, 0.5) AS median_seconds,
       max(duration_seconds) AS max_seconds,
       CASE WHEN quantile_disc(duration_seconds, 0.5) > 0
            THEN max(duration_seconds) / quantile_disc(duration_seconds, 0.5) END AS skew
FROM tasks WHERE duration_seconds IS NOT NULL GROUP BY ALL"""),
        "stage_timeline": q("""
SELECT application_id, stage, stage_attempt, count(*) AS tasks, CAST(count_if(attempt > 0) AS BIGINT) AS retried_tasks,
       min(started) AS first_start, max(finished) AS last_finish
FROM tasks GROUP BY ALL"""),
        "host_load": q("""
, h AS (
  SELECT printf('host-%d', (u + k) % 9) AS host, nullif(cont, '') AS container, NULL AS block, NULL AS port, NULL AS bytes
  FROM evp WHERE kind = 'signup'
  UNION ALL
  SELECT printf('host-%d', u % 9), NULL, e % 50, 40000 + e % 1000, CAST(size AS DOUBLE) * 1024.0 FROM evp WHERE kind = 'view')
SELECT host, count(DISTINCT container) AS containers, count(DISTINCT block) AS blocks, count(DISTINCT port) AS block_managers,
       count(block) AS added, round(sum(bytes), 3) AS added_bytes
FROM h GROUP BY host"""),
        "memory_profile": q("""
, cap AS (SELECT app_id, CAST(printf('%d.%d', v + 100, e % 10) AS DOUBLE) * 1048576.0 AS capacity_bytes,
                 NULL::DOUBLE AS size_bytes, NULL::DOUBLE AS free_bytes FROM evp WHERE kind = 'signup'
          UNION ALL
          SELECT app_id, NULL, CAST(size AS DOUBLE) * 1024.0,
                 CAST(printf('%d.%d', 100 + u % 400, e % 7) AS DOUBLE) * 1048576.0 FROM evp WHERE kind = 'view')
SELECT app_id AS application_id, max(capacity_bytes) AS capacity_bytes, count(size_bytes) AS blocks_stored,
       max(size_bytes) AS peak_block_bytes, min(free_bytes) AS min_free_bytes
FROM cap GROUP BY app_id"""),
        "cache_ratio": q("""
SELECT app_id AS application_id, count(*) AS lookups, CAST(count_if(e % 3 <> 0) AS BIGINT) AS hits,
       avg(CASE WHEN e % 3 <> 0 THEN 1.0 ELSE 0.0 END) AS hit_ratio
FROM evp WHERE kind = 'view' GROUP BY app_id"""),
        "python_times_by_app": q("""
SELECT app_id AS application_id, count(*) AS runs, CAST(sum(v + 50) AS BIGINT) AS total_ms,
       CAST(sum(e % 40 - 20) AS BIGINT) AS boot_ms, CAST(sum(e % 30) AS BIGINT) AS init_ms,
       CAST(sum(v) AS BIGINT) AS finish_ms, avg(v + 50) AS mean_total_ms
FROM evp WHERE kind = 'purchase' GROUP BY app_id"""),
        "input_bytes": q("""
SELECT printf('hdfs://storage-1:8020/data/part-%d.txt', e % 5) AS input_file, count(*) AS splits,
       CAST(sum(1000 + e % 997) AS BIGINT) AS bytes
FROM evp WHERE kind = 'click' GROUP BY 1"""),
        "containers": q("SELECT * FROM conts"),
    }


def inventory_queries() -> dict[str, str]:
    return {
        "inventory": with_feed("""
SELECT count(*) AS entries, count(DISTINCT file_path) AS files, count(DISTINCT nullif(cont, '')) AS containers,
       count(DISTINCT nullif(app_id, '')) AS applications FROM feed"""),
        "app_file_stats": with_feed("""
SELECT app_id AS application_id, count(DISTINCT file_path) AS files, count(*) AS lines,
       CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes
FROM feed WHERE app_id <> '' GROUP BY app_id"""),
        "top_apps_by_files": with_feed("""
SELECT app_id AS application_id, count(DISTINCT file_path) AS files, count(*) AS lines,
       CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes
FROM feed WHERE app_id <> '' GROUP BY app_id ORDER BY files DESC, application_id LIMIT 5"""),
    }


RECORDS = r"""
, o AS (
  SELECT file_path, value, e, seq, lts, lvl,
         CASE WHEN kind = 'click' AND seq = 3 THEN ts + to_seconds(v) ELSE ts END AS ot,
         CASE WHEN lts IS NOT NULL OR value LIKE '24/13/40 %' THEN 1 ELSE 0 END AS is_head
  FROM feed),
n AS (
  SELECT *, sum(is_head) OVER (PARTITION BY file_path ORDER BY ot, e, seq ROWS UNBOUNDED PRECEDING) AS record_no
  FROM o),
r AS (
  SELECT file_path, CAST(record_no AS BIGINT) AS record_no, CAST(0 AS BIGINT) AS part, list(lts ORDER BY ot, e, seq)[1] AS ts,
         list(lvl ORDER BY ot, e, seq)[1] AS log_level, count(*) AS lines,
         string_agg(value, chr(10) ORDER BY ot, e, seq) AS text
  FROM n GROUP BY file_path, record_no)"""


def record_queries() -> dict[str, str]:
    return {
        "records": with_feed(RECORDS + "\nSELECT * FROM r"),
        "multiline_records": with_feed(RECORDS + "\nSELECT * FROM r WHERE lines > 1"),
    }


def variant_queries() -> dict[str, str]:
    """Parameter variants whose result must equal the base query's."""
    u = usage_queries()
    return {
        "concurrency_hourly": u["concurrency"],
        "start_gaps_hourly": u["start_gaps"],
        "component_counts_all": with_feed(
            """
SELECT comp AS component, count(*) AS entries FROM feed WHERE comp <> '' GROUP BY comp"""
        ),
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(variant_queries())
    out.update(record_queries())
    out.update(message_queries())
    out.update(task_queries())
    out.update(inventory_queries())
    out.update(level_queries())
    out.update(usage_queries())
    out.update(daily_queries())
    out.update(chart_queries())
    return out

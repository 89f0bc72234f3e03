"""The same answers as SQL text over the given tables, for checking with another engine."""

from __future__ import annotations

from spindlewatch.functions import rules
from spindlewatch.operators import profile, quality, questions, summary
from spindlewatch.operators.marts import (
    HEALTH_COLUMNS, PROJECTION_COLUMNS, RUN_SUMMARY_DIGITS, TIMELINE_COLUMNS,
)
from spindlewatch.operators.facts import SERIES_COLUMNS
from spindlewatch.plans.catalog import (
    BASELINE_METRICS, CSV_DROPPED, DIGITS, EVENT_WINDOW, HINT_DETECTORS, HINT_METRICS, LOG_TIME, MIXED_DROPPED,
    PUBLISHED, QUEUE_METRICS,
)
from spindlewatch.schema import (
    COMBINED_METRICS, CURATED_SCHEMA, EVENT_CONTEXT, EVIDENCE_SCHEMA, LOG_METRICS, NO_ANOMALIES, RAW_METRICS, RAW_SCHEMA,
    WORKLOAD_PATTERNS,
)
from spindlewatch.sources.feed import BAD_LABEL, BAD_LABEL_MINUTE, SILENT_DEVICE

RAW_NAMES = ", ".join(RAW_SCHEMA.fieldNames())
CURATED_NAMES = ", ".join(CURATED_SCHEMA.fieldNames())


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def long_form(source: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{m}' AS metric_name, {m} AS metric_value FROM {source}" for m in metrics)


RAW = """
    SELECT
        CASE user_id % 5 WHEN 0 THEN 'nvme0n1' WHEN 1 THEN 'nvme1n1' WHEN 2 THEN 'sda'
            WHEN 3 THEN 'sdb' ELSE 'dm-0' END AS device,
        ts AS timestamp,
        CASE WHEN idle THEN 0.0::DOUBLE ELSE value * 4 END AS r_s,
        CASE WHEN idle THEN 0.0::DOUBLE ELSE k * 3 END AS w_s,
        CASE WHEN event_type = 'click' THEN value / 40 ELSE value / 10 END AS rmb_s,
        k / 20 AS wmb_s, value / 50 * f AS r_await, k / 25 * f AS w_await, value / 60 AS aqu_sz,
        least(100.0::DOUBLE, k * 0.6::DOUBLE + value / 5) AS util_pct,
        k * 0.5::DOUBLE AS rrqm_s, value * 0.25::DOUBLE AS wrqm_s,
        k + 4 AS rareq_sz, value / 2 + 4 AS wareq_sz, value / 100 * f AS svctm, k / 4 AS iowait_pct,
        'events.parquet' AS source_file,
        CASE WHEN day(ts) <= 5 THEN 'run-00' WHEN day(ts) <= 10 THEN 'run-01'
            WHEN day(ts) <= 15 THEN 'run-02' WHEN day(ts) <= 20 THEN 'run-03'
            WHEN day(ts) <= 25 THEN 'run-04' ELSE 'run-05' END AS ingest_run_id
    FROM (
        SELECT *, event_type = 'error' AND k < 5 AS idle FROM (
            SELECT *, CAST(props ->> '$.k' AS DOUBLE) AS k,
                CASE user_id % 5 WHEN 2 THEN 2.0::DOUBLE WHEN 3 THEN 10.0::DOUBLE
                    WHEN 4 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS f
            FROM events))
"""

CLOCK = """CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
        CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week"""

CURATED = f"""
    SELECT {CURATED_NAMES} FROM (
    SELECT *, total_iops AS iops_total, total_throughput_mb_s AS throughput_mb_s,
        avg_latency_ms AS weighted_avg_latency,
        total_iops * avg_request_size_kb AS io_intensity,
        avg_latency_ms * aqu_sz AS latency_pressure,
        CASE WHEN avg_latency_ms > 0 THEN svctm / avg_latency_ms ELSE 1.0 END AS svctm_await_ratio,
        CASE WHEN util_pct > 80 OR aqu_sz > 5 THEN 'saturated' WHEN total_iops > 1200 THEN 'burst_io'
            WHEN avg_request_size_kb < 16 THEN 'small_io_pressure'
            WHEN avg_latency_ms > 5 THEN 'latency_sensitive' ELSE 'balanced' END AS workload_pattern
    FROM (
        SELECT *,
            CASE WHEN total_iops > 0 THEN (r_await * r_s + w_await * w_s) / total_iops
                ELSE 0.0 END AS avg_latency_ms,
            CASE WHEN total_iops > 0 THEN r_s / total_iops ELSE 0.5 END AS read_ratio,
            CASE WHEN total_iops > 0 THEN w_s / total_iops ELSE 0.5 END AS write_ratio,
            CASE WHEN total_iops > 0 THEN total_throughput_mb_s * 1024 / total_iops
                ELSE 0.0 END AS avg_request_size_kb,
            util_pct * aqu_sz AS saturation_score,
            CASE WHEN total_iops + merge_rate_total > 0
                THEN merge_rate_total / (total_iops + merge_rate_total) ELSE 0.0 END AS merge_efficiency,
            CASE WHEN r_await > 0 THEN w_await / r_await ELSE 1.0 END AS await_ratio,
            CASE WHEN aqu_sz > 0 THEN total_iops / aqu_sz ELSE 0.0 END AS queue_efficiency,
            CASE WHEN r_s > 0 THEN w_s / r_s ELSE 1.0 END AS write_amplification,
            iowait_pct * util_pct / 100 AS iowait_pressure,
            {CLOCK}
        FROM (SELECT *, r_s + w_s AS total_iops, rmb_s + wmb_s AS total_throughput_mb_s,
                rrqm_s + wrqm_s AS merge_rate_total FROM raw)))
"""

DIRTY = """
    SELECT CASE m WHEN 1 THEN NULL ELSE device END AS device,
        CASE m WHEN 2 THEN NULL ELSE timestamp END AS timestamp,
        CASE m WHEN 5 THEN NULL WHEN 6 THEN -1 - r_s ELSE r_s END AS r_s,
        CASE m WHEN 7 THEN NULL WHEN 8 THEN -2 ELSE w_s END AS w_s,
        CASE m WHEN 9 THEN -0.5::DOUBLE ELSE rmb_s END AS rmb_s,
        CASE m WHEN 10 THEN -0.25::DOUBLE ELSE wmb_s END AS wmb_s, r_await, w_await,
        CASE m WHEN 11 THEN -3 ELSE aqu_sz END AS aqu_sz,
        CASE m WHEN 3 THEN util_pct + 100 WHEN 4 THEN -1 ELSE util_pct END AS util_pct,
        rrqm_s, wrqm_s, rareq_sz, wareq_sz,
        CASE m WHEN 12 THEN NULL ELSE svctm END AS svctm, iowait_pct,
        CASE m WHEN 12 THEN NULL ELSE source_file END AS source_file, ingest_run_id
    FROM (SELECT *, minute(timestamp) AS m FROM raw)
"""

DIRTY_CURATED = f"""
    SELECT * REPLACE (CASE WHEN minute(timestamp) = {BAD_LABEL_MINUTE} THEN {text(BAD_LABEL)}
        ELSE workload_pattern END AS workload_pattern)
    FROM ({CURATED.replace('FROM raw)', 'FROM dirty)')})
"""

ADDITIVE = f"""
    SELECT *, util_pct * 0.5::DOUBLE + aqu_sz * 30 + avg_latency_ms * 2 AS saturation_score,
        avg_latency_ms * (aqu_sz + 1) AS latency_pressure
    FROM (
        SELECT *,
            CASE WHEN total_iops > 0 THEN (r_await * r_s + w_await * w_s) / total_iops
                ELSE 0.0 END AS avg_latency_ms,
            CASE WHEN total_iops > 0 THEN r_s / total_iops ELSE 0.0 END AS read_ratio,
            CASE WHEN total_iops > 0 THEN w_s / total_iops ELSE 0.0 END AS write_ratio,
            CASE WHEN total_iops > 0 THEN total_throughput_mb_s * 1024 / total_iops
                ELSE 0.0 END AS avg_request_size_kb,
            total_iops * total_throughput_mb_s AS io_intensity,
            {CLOCK}
        FROM (SELECT *, r_s + w_s AS total_iops, rmb_s + wmb_s AS total_throughput_mb_s FROM raw))
"""

CLIPPED = f"""
    SELECT *, total_iops AS iops_total, total_throughput_mb_s AS throughput_mb_s,
        avg_latency_ms AS weighted_avg_latency,
        total_iops * avg_request_size_kb AS io_intensity,
        avg_latency_ms * aqu_sz AS latency_pressure,
        greatest(0.0::DOUBLE, least(10.0::DOUBLE,
            coalesce(svctm / nullif(avg_latency_ms, 0), 1.0))) AS svctm_await_ratio
    FROM (
        SELECT *,
            coalesce((r_await * r_s + w_await * w_s) / nullif(total_iops, 0), 0.0) AS avg_latency_ms,
            r_s / coalesce(nullif(total_iops, 0), 0.5) AS read_ratio,
            w_s / coalesce(nullif(total_iops, 0), 0.5) AS write_ratio,
            coalesce((rmb_s * 1024 + wmb_s * 1024) / nullif(total_iops, 0), 0.0) AS avg_request_size_kb,
            util_pct * aqu_sz AS saturation_score,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(
                merge_rate_total / nullif(total_iops + merge_rate_total, 0), 0.0))) AS merge_efficiency,
            coalesce(w_await / nullif(r_await, 0), 1.0) AS await_ratio,
            coalesce(total_iops / nullif(aqu_sz, 0), 0.0) AS queue_efficiency,
            coalesce(w_s / nullif(r_s, 0), 1.0) AS write_amplification,
            iowait_pct * util_pct / 100 AS iowait_pressure,
            {CLOCK}
        FROM (SELECT *, r_s + w_s AS total_iops, rmb_s + wmb_s AS total_throughput_mb_s,
                rrqm_s + wrqm_s AS merge_rate_total FROM raw))
"""

EIGHT_CLASSES = """CASE WHEN util_pct >= 85 OR aqu_sz >= 3 THEN 'saturated'
        WHEN avg_latency_ms >= 10 AND aqu_sz >= 1 THEN 'latency_sensitive'
        WHEN write_ratio >= 0.7 THEN 'write_heavy' WHEN read_ratio >= 0.7 THEN 'read_heavy'
        WHEN avg_request_size_kb <= 16 AND total_iops > 0 THEN 'small_io_pressure'
        WHEN total_throughput_mb_s >= 50 AND avg_latency_ms < 5 THEN 'high_throughput'
        WHEN total_iops >= 500 THEN 'burst_io' ELSE 'balanced' END"""

HINT = f"""CASE
        WHEN metric_name = 'avg_latency_ms' THEN CASE
            WHEN aqu_sz >= 2 AND util_pct >= 80 THEN {text(rules.SATURATION_LATENCY)}
            WHEN write_ratio >= 0.7 THEN {text(rules.WRITE_LATENCY)}
            WHEN read_ratio >= 0.7 THEN {text(rules.READ_LATENCY)}
            ELSE {text(rules.PLAIN_LATENCY)} END
        WHEN metric_name = 'saturation_score' THEN {text(rules.SATURATION)}
        WHEN metric_name = 'total_iops' THEN CASE
            WHEN avg_request_size_kb <= 16 THEN {text(rules.SMALL_IOPS)}
            ELSE {text(rules.PLAIN_IOPS)} END
        ELSE {text(rules.UNEXPLAINED)} END"""

# The arms that the combined detector's metrics never reach come first.
FULL_HINT = HINT.replace("CASE", f"""CASE
        WHEN metric_name = 'util_pct' THEN CASE WHEN util_pct >= 90 THEN {text(rules.FULL_UTILIZATION)}
            ELSE {text(rules.PLAIN_UTILIZATION)} END
        WHEN metric_name = 'aqu_sz' THEN CASE WHEN avg_latency_ms >= 10 THEN {text(rules.QUEUE_LATENCY)}
            ELSE {text(rules.PLAIN_QUEUE)} END
        WHEN metric_name = 'latency_pressure' THEN {text(rules.LATENCY_PRESSURE)}
        WHEN metric_name = 'multivariate' THEN CASE workload_pattern
            WHEN 'saturated' THEN {text(rules.JOINT_SATURATED)} WHEN 'write_heavy' THEN {text(rules.JOINT_WRITE)}
            WHEN 'read_heavy' THEN {text(rules.JOINT_READ)} ELSE {text(rules.PLAIN_JOINT)} END""", 1)

Z_SEVERITY = """CASE WHEN anomaly_score >= 5 THEN 'critical' WHEN anomaly_score >= 4 THEN 'high'
        ELSE 'medium' END"""
IQR_SEVERITY = """CASE WHEN anomaly_score >= 5 THEN 'critical' WHEN anomaly_score >= 3 THEN 'high'
        WHEN anomaly_score >= 1.5 THEN 'medium' ELSE 'low' END"""

FOREST_SEVERITY = """CASE WHEN anomaly_score >= 0.3 THEN 'critical' WHEN anomaly_score >= 0.15 THEN 'high'
        WHEN anomaly_score >= 0.05 THEN 'medium' ELSE 'low' END"""


def statistics(source: str, metrics: list[str]) -> str:
    return f"""
    SELECT device, metric_name, count(metric_value) AS n, avg(metric_value) AS mean,
        stddev_pop(metric_value) AS std, quantile_cont(metric_value, 0.25) AS q1,
        quantile_cont(metric_value, 0.75) AS q3
    FROM ({long_form(source, metrics)}) GROUP BY device, metric_name"""


def combined(source: str) -> str:
    coerced = ", ".join(
        f"CASE WHEN {c} = 0 THEN 0.5 ELSE {c} END AS {c}" if absent else c
        for c, absent in EVENT_CONTEXT.items())
    return f"""
    SELECT device, timestamp, metric_name, metric_value,
        CASE WHEN by_z AND by_iqr THEN 'zscore+iqr' WHEN by_z THEN 'zscore' ELSE 'iqr' END AS detector_type,
        anomaly_score, {Z_SEVERITY} AS severity, CAST(1 AS INTEGER) AS is_anomaly,
        source_file, ingest_run_id, workload_pattern, {HINT} AS root_cause_hint,
        mean, std, q1, q3, q3 - q1 AS iqr, lower_bound, upper_bound, z_score,
        {coerced}
    FROM (
        SELECT *, abs(z_score) AS anomaly_score, abs(z_score) >= 3 AS by_z,
            metric_value < lower_bound OR metric_value > upper_bound AS by_iqr
        FROM (
            SELECT l.*, s.n, s.mean, s.std, s.q1, s.q3,
                s.q1 - 1.5 * (s.q3 - s.q1) AS lower_bound, s.q3 + 1.5 * (s.q3 - s.q1) AS upper_bound,
                CASE WHEN s.std = 0 THEN 0.0 ELSE (l.metric_value - s.mean) / s.std END AS z_score
            FROM ({long_form(source, COMBINED_METRICS)}) l
            JOIN ({statistics(source, COMBINED_METRICS)}) s USING (device, metric_name))
        WHERE n >= 5)
    WHERE by_z OR by_iqr"""


EVENT_NAMES = ", ".join([
    "device", "timestamp", "metric_name", "metric_value", "detector_type", "anomaly_score",
    "severity", "is_anomaly", "source_file", "ingest_run_id", "workload_pattern",
    "root_cause_hint", *EVENT_CONTEXT])


def rolling(metrics: list[str], window: int) -> str:
    parts = []
    for m in metrics:
        parts.append(f"CASE WHEN count({m}) OVER w >= 2 THEN avg({m}) OVER w END AS {m}_rolling_mean")
        parts.append(f"CASE WHEN count({m}) OVER w >= 2 THEN stddev_samp({m}) OVER w END AS {m}_rolling_std")
    return f"""SELECT *, {', '.join(parts)} FROM curated WINDOW w AS (
        PARTITION BY device ORDER BY timestamp ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"""


def rolling_events() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT device, timestamp, '{m}' AS metric_name, {m} AS metric_value,
            ({m} - {m}_rolling_mean) / {m}_rolling_std AS anomaly_score, source_file, ingest_run_id
        FROM rolled WHERE {m}_rolling_std <> 0
            AND abs(({m} - {m}_rolling_mean) / {m}_rolling_std) >= 3""" for m in BASELINE_METRICS)
    return f"""SELECT *, 'rolling_zscore' AS detector_type, CAST(NULL AS VARCHAR) AS severity,
        CAST(1 AS INTEGER) AS is_anomaly, printf('zscore=%.2f', anomaly_score) AS details FROM ({parts})"""


def iqr_events(metrics: list[str]) -> str:
    return f"""
    SELECT device, timestamp, metric_name, metric_value, 'iqr' AS detector_type,
        CASE WHEN q3 = q1 THEN 0.0 WHEN metric_value > upper THEN (metric_value - upper) / (q3 - q1)
            ELSE (lower - metric_value) / (q3 - q1) END AS anomaly_score,
        CAST(NULL AS VARCHAR) AS severity, CAST(1 AS INTEGER) AS is_anomaly,
        printf('lower=%.2f, upper=%.2f', lower, upper) AS details, source_file, ingest_run_id
    FROM (
        SELECT l.device, l.timestamp, l.metric_name, l.metric_value, l.source_file, l.ingest_run_id,
            s.q1, s.q3, s.q1 - 1.5 * (s.q3 - s.q1) AS lower, s.q3 + 1.5 * (s.q3 - s.q1) AS upper
        FROM ({long_form('curated', metrics)}) l
        JOIN ({statistics('curated', metrics)}) s USING (device, metric_name))
    WHERE metric_value < lower OR metric_value > upper"""


def enriched(source: str) -> str:
    context = ", ".join(f"c.{c}" for c in EVENT_CONTEXT)
    return f"""
    SELECT *, {HINT} AS root_cause_hint FROM (
        SELECT e.*, c.workload_pattern, {context}
        FROM ({source}) e LEFT JOIN curated c USING (device, timestamp, ingest_run_id))"""


def graded(source: str, severity: str) -> str:
    return (f"SELECT {EVENT_NAMES} FROM (SELECT * EXCLUDE (severity), {severity} AS severity "
            f"FROM ({enriched(source)}))")


ABSOLUTE_Z = Z_SEVERITY.replace("anomaly_score", "abs(anomaly_score)")


def dominant(keys: str) -> str:
    """Most frequent workload per key, the smallest on a tie."""
    return f"""
    SELECT {keys}, workload_pattern AS dominant_workload_pattern FROM (
        SELECT {keys}, workload_pattern, row_number() OVER (
            PARTITION BY {keys} ORDER BY count(*) DESC, workload_pattern) AS rn
        FROM curated GROUP BY {keys}, workload_pattern) WHERE rn = 1"""


OVERVIEW = f"""
    SELECT c.*, d.dominant_workload_pattern,
        CAST(coalesce(e.anomaly_count, 0) AS BIGINT) AS anomaly_count,
        CAST(coalesce(e.critical_anomaly_count, 0) AS BIGINT) AS critical_anomaly_count,
        CAST(coalesce(e.high_anomaly_count, 0) AS BIGINT) AS high_anomaly_count
    FROM (
        SELECT device, count(*) AS sample_count, avg(total_iops) AS avg_total_iops,
            avg(total_throughput_mb_s) AS avg_throughput_mb_s, avg(avg_latency_ms) AS avg_latency_ms,
            quantile_cont(avg_latency_ms, 0.95) AS p95_latency_ms,
            quantile_cont(avg_latency_ms, 0.99) AS p99_latency_ms,
            avg(util_pct) AS avg_util_pct, avg(aqu_sz) AS avg_queue_depth
        FROM curated GROUP BY device) c
    LEFT JOIN ({dominant('device')}) d USING (device)
    LEFT JOIN (
        SELECT device, count(*) AS anomaly_count,
            count(*) FILTER (severity = 'critical') AS critical_anomaly_count,
            count(*) FILTER (severity = 'high') AS high_anomaly_count
        FROM found GROUP BY device) e USING (device)
"""

CAUSES = """
    SELECT ingest_run_id, root_cause_hint, workload_pattern, count(*) AS anomaly_count,
        count(*) FILTER (severity = 'critical') AS critical_count,
        count(*) FILTER (severity = 'high') AS high_count,
        count(DISTINCT device) AS affected_devices, avg(anomaly_score) AS avg_anomaly_score
    FROM found GROUP BY ingest_run_id, root_cause_hint, workload_pattern
"""

RUNS = f"""
    SELECT p.*, d.dominant_workload_pattern,
        CAST(coalesce(e.total_anomalies, 0) AS BIGINT) AS total_anomalies,
        CAST(coalesce(e.critical_count, 0) AS BIGINT) AS critical_count,
        CAST(coalesce(e.high_count, 0) AS BIGINT) AS high_count,
        coalesce(t.root_cause_hint, {text(NO_ANOMALIES)}) AS top_root_cause
    FROM (
        SELECT device, ingest_run_id, min(timestamp) AS run_time,
            avg(avg_latency_ms) AS avg_latency_ms, max(avg_latency_ms) AS max_latency_ms,
            avg(util_pct) AS avg_util_pct, max(util_pct) AS max_util_pct,
            avg(total_iops) AS avg_iops, avg(total_throughput_mb_s) AS avg_throughput_mb_s,
            avg(saturation_score) AS avg_saturation_score, avg(aqu_sz) AS avg_aqu_sz
        FROM curated GROUP BY device, ingest_run_id) p
    LEFT JOIN ({dominant('device, ingest_run_id')}) d USING (device, ingest_run_id)
    LEFT JOIN (
        SELECT device, ingest_run_id, count(*) AS total_anomalies,
            count(*) FILTER (severity = 'critical') AS critical_count,
            count(*) FILTER (severity = 'high') AS high_count
        FROM found GROUP BY device, ingest_run_id) e USING (device, ingest_run_id)
    LEFT JOIN (
        SELECT device, ingest_run_id, root_cause_hint FROM (
            SELECT device, ingest_run_id, root_cause_hint, row_number() OVER (
                PARTITION BY device, ingest_run_id ORDER BY count(*) DESC, root_cause_hint) AS rn
            FROM found GROUP BY device, ingest_run_id, root_cause_hint)
        WHERE rn = 1) t USING (device, ingest_run_id)
"""

HEALTH = f"""
    SELECT {', '.join('c.' + c for c in HEALTH_COLUMNS)},
        CAST(coalesce(f.anomaly_flag, 0) AS INTEGER) AS anomaly_flag,
        CAST(coalesce(f.critical_flag, 0) AS INTEGER) AS critical_flag,
        CAST(coalesce(f.high_flag, 0) AS INTEGER) AS high_flag
    FROM curated c LEFT JOIN (
        SELECT device, timestamp, max(is_anomaly) AS anomaly_flag,
            max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS critical_flag,
            max(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS high_flag
        FROM found GROUP BY device, timestamp) f USING (device, timestamp)
"""


def newest(table: str) -> str:
    return (f"(SELECT ingest_run_id FROM {table} WHERE ingest_run_id IS NOT NULL "
            "ORDER BY timestamp DESC, ingest_run_id DESC LIMIT 1)")


# Each named part with the parts it reads.
PARTS: dict[str, tuple[str, list[str]]] = {
    "raw": (RAW, []),
    "curated": (CURATED, ["raw"]),
    "dirty": (DIRTY, ["raw"]),
    "dirty_curated": (DIRTY_CURATED, ["dirty"]),
    "additive": (ADDITIVE, ["raw"]),
    "clipped": (CLIPPED, ["raw"]),
    "found": (combined("curated"), ["curated"]),
    "rolled": (rolling(BASELINE_METRICS, EVENT_WINDOW), ["curated"]),
    "all_events": (
        f"{graded(rolling_events(), ABSOLUTE_Z)} UNION ALL "
        f"{graded(iqr_events(BASELINE_METRICS), IQR_SEVERITY)} UNION ALL "
        f"SELECT {EVENT_NAMES} FROM found", ["rolled", "found"]),
    "queue_events": (
        graded(iqr_events(QUEUE_METRICS), IQR_SEVERITY).replace(HINT, FULL_HINT), ["curated"]),
    "overview": (OVERVIEW, ["curated", "found"]),
    "causes": (CAUSES, ["found"]),
    "runs": (RUNS, ["curated", "found"]),
    "health": (HEALTH, ["curated", "found"]),
    "run_summary": ("""
        SELECT ingest_run_id, CAST(coalesce(raw_rows, 0) AS BIGINT) AS raw_rows, curated_rows,
            anomaly_rows, affected_devices, critical_anomalies, high_anomalies, max_anomaly_score
        FROM (SELECT ingest_run_id, count(*) AS curated_rows FROM curated GROUP BY 1)
        JOIN (SELECT ingest_run_id, count(*) AS anomaly_rows, count(DISTINCT device) AS affected_devices,
                count(*) FILTER (severity = 'critical') AS critical_anomalies,
                count(*) FILTER (severity = 'high') AS high_anomalies,
                max(anomaly_score) AS max_anomaly_score FROM found GROUP BY 1) USING (ingest_run_id)
        LEFT JOIN (SELECT ingest_run_id, count(*) AS raw_rows FROM raw GROUP BY 1) USING (ingest_run_id)
    """, ["raw", "curated", "found"]),
    "run_counts": ("""SELECT ingest_run_id, min(timestamp) AS run_time, count(*) AS anomaly_count
        FROM found GROUP BY ingest_run_id""", ["found"]),
    "kpis": ("""SELECT d.total_devices, e.*, d.avg_latency_ms, d.avg_util_pct FROM (
            SELECT count(DISTINCT device) AS total_devices, CAST(round(CAST(avg(avg_latency_ms) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_latency_ms,
                CAST(round(CAST(avg(avg_util_pct) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_util_pct FROM overview) d,
            (SELECT count(*) AS total_anomalies,
                count(*) FILTER (severity = 'critical') AS critical_anomalies,
                count(*) FILTER (severity = 'high') AS high_anomalies FROM found) e
    """, ["overview", "found"]),
    "top_causes": ("""SELECT root_cause_hint, workload_pattern, anomaly_count, critical_count FROM causes
        ORDER BY critical_count DESC, anomaly_count DESC, ingest_run_id, root_cause_hint, workload_pattern
        LIMIT 5""", ["causes"]),
}


def sql(body: str, *reads: str) -> str:
    """`body` preceded by the parts it reads, directly or through other parts."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in PARTS[name][1]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in reads:
        visit(name)
    parts = ",\n".join(f"{name} AS ({PARTS[name][0]})" for name in order)
    return f"WITH {parts}\n{body}"


def settled(body: str, columns: list[str]) -> str:
    replaced = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38, 9)), {DIGITS}) AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({body})"


OVERVIEW_DOUBLES = ["avg_total_iops", "avg_throughput_mb_s", "avg_latency_ms", "p95_latency_ms",
                    "p99_latency_ms", "avg_util_pct", "avg_queue_depth"]
RUN_DOUBLES = list(RUN_SUMMARY_DIGITS)
CAUSE_ORDER = "critical_count DESC, anomaly_count DESC, root_cause_hint, workload_pattern"


def _means(key: str, columns: list[str], digits: int) -> str:
    means = ", ".join(f"CAST(round(CAST(avg({c}) AS DECIMAL(38, 9)), {digits}) AS DOUBLE) AS {c}" for c in columns)
    return sql(f"SELECT {key}, {means} FROM curated GROUP BY {key}", "curated")


def _describe(source: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(f"""SELECT '{c}' AS metric_name, count({c}) AS count, avg({c}) AS mean,
        stddev_samp({c}) AS std, min({c}) AS min,
        {', '.join(f"quantile_cont({c}, {p}) AS p{int(p * 100)}" for p in profile.QUANTILES)},
        max({c}) AS max FROM {source}""" for c in columns)
    return sql(settled(rows, ["mean", "std", "min", "p50", "p90", "p95", "p99", "max"]), source)


def _nulls(source: str, columns: list[str]) -> str:
    return sql(" UNION ALL ".join(
        f"""SELECT '{c}' AS column_name,
            CAST(round(CAST(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS null_pct,
            count(DISTINCT {c}) AS n_distinct FROM {source}""" for c in columns), source)


def _quantiles() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS quantile, " + ", ".join(
            f"quantile_cont({c}, {p}) AS {c}" for c in profile.QUANTILE_METRICS) + " FROM curated"
        for p in profile.QUANTILES)
    return sql(settled(rows, ["quantile", *profile.QUANTILE_METRICS]), "curated")


def _correlations() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, corr({a}, {b}) AS correlation FROM curated"
        for a in profile.CORRELATED for b in profile.CORRELATED)
    return sql(settled(rows, ["correlation"]), "curated")


def _histogram() -> str:
    bins = profile.HISTOGRAM_BINS
    body = f"""
    SELECT CAST(b.bin AS INTEGER) AS bin, e.low + b.bin * ((e.high - e.low) / {bins}) AS lower_edge,
        e.low + (b.bin + 1) * ((e.high - e.low) / {bins}) AS upper_edge, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM (SELECT unnest(range({bins})) AS bin) b
    CROSS JOIN (SELECT min(avg_latency_ms) AS low, max(avg_latency_ms) AS high FROM curated) e
    LEFT JOIN (
        SELECT least(floor((avg_latency_ms - low) / (high - low) * {bins}), {bins - 1}) AS bin, count(*) AS n
        FROM curated, (SELECT min(avg_latency_ms) AS low, max(avg_latency_ms) AS high FROM curated)
        GROUP BY 1) c ON b.bin = c.bin"""
    return sql(settled(body, ["lower_edge", "upper_edge"]), "curated")


def _frequencies() -> str:
    columns = ["detector_type", "severity", "metric_name", "device", "root_cause_hint", "workload_pattern"]
    return sql(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM found GROUP BY {c}" for c in columns), "found")


def _coverage() -> str:
    tables = {"device_overview": "overview", "anomaly_timeline": "found", "device_health": "health"}
    return sql(" UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, (SELECT count(DISTINCT device) FROM {t}) AS n_devices,
            (SELECT count(*) FROM (SELECT DISTINCT device FROM overview
                WHERE device NOT IN (SELECT device FROM {t}))) AS n_missing""" for name, t in tables.items()),
        "overview", "found", "health")


def _quality() -> str:
    rows = []

    def add(dataset: str, check: str, violations: str = "0::BIGINT") -> None:
        rows.append(f"SELECT {text(dataset)} AS dataset, {text(check)} AS check_name, {violations} AS violations")

    def count(table: str, condition: str) -> str:
        return f"(SELECT count(*) FROM {table} WHERE {condition})"

    def required(dataset: str, columns: list[str]) -> None:
        for c in columns:
            add(dataset, f"column {c}")

    required("raw", quality.REQUIRED["raw"])
    required("parsed", quality.REQUIRED["raw"])
    for c in ("device", "timestamp"):
        add("parsed", f"{c} not null", count("raw", f"{c} IS NULL"))
    add("parsed", "util_pct in range", count("raw", "util_pct < 0 OR util_pct > 100"))
    for c in quality.NON_NEGATIVE:
        add("parsed", f"{c} not negative", count("raw", f"{c} < 0"))
    required("curated", quality.REQUIRED["curated"])
    known = ", ".join(text(p) for p in WORKLOAD_PATTERNS)
    add("curated", "total_iops not null", count("curated", "total_iops IS NULL"))
    add("curated", "util_pct in range", count("curated", "util_pct < 0 OR util_pct > 100"))
    add("curated", "workload_pattern known", count("curated", f"workload_pattern NOT IN ({known})"))
    required("events", quality.REQUIRED["events"])
    add("events", "root_cause_hint not null", count("found", "root_cause_hint IS NULL"))
    for name in ("device_overview", "anomaly_timeline", "device_health", "root_cause_summary", "device_run_summary"):
        required(name, quality.REQUIRED[name])
    for name, columns in quality.REPORT_INPUTS.items():
        required(f"report {name}", columns)
    empty = "(SELECT CAST(count(*) = 0 AS BIGINT) FROM {})"
    add("report device_overview", "has rows", empty.format("overview"))
    published = {"device_overview": "overview", "anomaly_timeline": "found", "device_health": "health",
                 "root_cause_summary": "causes", "device_run_summary": "runs",
                 "run_summary": "run_summary", "latest_run": "found"}
    for name, table in published.items():
        add(name, "has rows", empty.format(table))
    return sql(" UNION ALL ".join(rows), "raw", "curated", "found", "overview", "health", "causes", "runs",
               "run_summary")


def _dirty_quality() -> str:
    rows = []

    def add(dataset: str, columns: list[str], checks: dict[str, str], table: str) -> None:
        for c in columns:
            rows.append(f"SELECT '{dataset}' AS dataset, 'column {c}' AS check_name, "
                        f"{int(dataset == 'raw' and c == 'w_s')}::BIGINT AS violations")
        for check, condition in checks.items():
            rows.append(f"SELECT '{dataset}', '{check}', (SELECT count(*) FROM {table} WHERE {condition})")

    range_check = {"util_pct in range": "util_pct < 0 OR util_pct > 100"}
    known = ", ".join(text(p) for p in WORKLOAD_PATTERNS)
    add("raw", quality.REQUIRED["raw"], {}, "dirty")
    add("parsed", quality.REQUIRED["raw"], {
        **{f"{c} not null": f"{c} IS NULL" for c in ("device", "timestamp")}, **range_check,
        **{f"{c} not negative": f"{c} < 0" for c in quality.NON_NEGATIVE}}, "dirty")
    add("curated", quality.REQUIRED["curated"], {
        "total_iops not null": "total_iops IS NULL", **range_check,
        "workload_pattern known": f"workload_pattern NOT IN ({known})"}, "dirty_curated")
    add("events", quality.REQUIRED["events"], {
        "root_cause_hint not null": f"device = {text(SILENT_DEVICE)}"}, "found")
    rows.append("""SELECT 'idle at full speed', 'has rows',
        (SELECT CAST(count(*) = 0 AS BIGINT) FROM curated WHERE total_iops = 0 AND r_s > 0)""")
    return sql(" UNION ALL ".join(rows), "curated", "dirty", "dirty_curated", "found")


def _dealt(names: list[str], part: str) -> str:
    return f"[{', '.join(text(n) for n in names)}][{part}(timestamp) % {len(names)} + 1]"


def _graded_hints() -> str:
    return sql(f"""
    SELECT metric_name, detector_type, CASE detector_type WHEN 'rolling_zscore' THEN {Z_SEVERITY}
            WHEN 'iqr' THEN {IQR_SEVERITY} WHEN 'isolation_forest' THEN {FOREST_SEVERITY} ELSE 'low' END AS severity,
        {FULL_HINT} AS root_cause_hint, count(*) AS n
    FROM (SELECT * REPLACE ({EIGHT_CLASSES} AS workload_pattern),
            util_pct / CASE detector_type WHEN 'isolation_forest' THEN 200 ELSE 12 END AS anomaly_score
        FROM (SELECT *, {_dealt(HINT_METRICS, 'hour')} AS metric_name,
            {_dealt(HINT_DETECTORS, 'second')} AS detector_type FROM dirty_curated))
    GROUP BY 1, 2, 3, 4""", "dirty_curated")


def _gaps() -> str:
    tables = {"device_overview": "overview",
              "anomaly_timeline": f"(SELECT device FROM found WHERE device <> {text(SILENT_DEVICE)})",
              "device_health": "(SELECT device FROM dirty_curated WHERE device NOT LIKE 'nvme%')"}
    return sql(" UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, (SELECT count(DISTINCT device) FROM {t}) AS n_devices,
            (SELECT count(*) FROM (SELECT DISTINCT device FROM overview
                WHERE device NOT IN (SELECT device FROM {t}))) AS n_missing""" for name, t in tables.items()),
        "overview", "found", "dirty_curated")


def _changes() -> str:
    measures = ["avg_latency_ms", "avg_util_pct", "avg_throughput_mb_s", "avg_saturation_score", "top_root_cause"]

    def end(prefix: str, rn: str) -> str:
        return ", ".join(f"max(CASE WHEN {rn} = 1 THEN {m} END) AS {prefix}_{m}" for m in measures)

    def direction(measure: str, up: str, down: str, level: str) -> str:
        return (f"CASE WHEN last_{measure} > first_{measure} THEN '{up}' "
                f"WHEN last_{measure} < first_{measure} THEN '{down}' ELSE '{level}' END")

    body = f"""
    SELECT *, {direction('avg_latency_ms', questions.INCREASED, questions.DECREASED, questions.UNCHANGED)}
            AS latency_direction,
        {direction('avg_util_pct', questions.INCREASED, questions.DECREASED, questions.DECREASED)} AS util_direction,
        {direction('avg_throughput_mb_s', questions.UP, questions.DOWN, questions.DOWN)} AS throughput_direction,
        {direction('avg_saturation_score', questions.UP, questions.DOWN, questions.DOWN)} AS saturation_direction,
        first_top_root_cause <> last_top_root_cause AS cause_shifted
    FROM (
        SELECT device, count(*) AS run_count, {end('first', 'f')}, {end('last', 'l')}
        FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY run_time, ingest_run_id) AS f,
                row_number() OVER (PARTITION BY device ORDER BY run_time DESC, ingest_run_id DESC) AS l
            FROM runs) GROUP BY device)"""
    return sql(settled(body, [f"{p}_{m}" for p in ("first", "last") for m in measures[:-1]]), "runs")


def _run_change() -> str:
    by_time = "ORDER BY run_time, ingest_run_id"
    return sql(f"""
    SELECT *, last_count - first_count AS change,
        CASE WHEN last_count > first_count THEN '{questions.INCREASED}'
            WHEN last_count < first_count THEN '{questions.DECREASED}' ELSE '{questions.FLAT}' END AS direction,
        CASE WHEN last_count > first_count THEN '{questions.WORSE}'
            WHEN last_count < first_count THEN '{questions.NOT_WORSE}' ELSE '{questions.NO_TREND}' END AS verdict
    FROM (SELECT count(*) AS run_count,
        (SELECT anomaly_count FROM run_counts {by_time} LIMIT 1) AS first_count,
        (SELECT anomaly_count FROM run_counts ORDER BY run_time DESC, ingest_run_id DESC LIMIT 1) AS last_count,
        (SELECT ingest_run_id FROM run_counts ORDER BY anomaly_count, run_time LIMIT 1) AS best_run,
        min(anomaly_count) AS best_count,
        (SELECT ingest_run_id FROM run_counts ORDER BY anomaly_count DESC, run_time LIMIT 1) AS worst_run,
        max(anomaly_count) AS worst_count FROM run_counts)""", "run_counts")


def _with_cause(per_run: bool) -> str:
    keys = "device, ingest_run_id" if per_run else "device"
    where_c = where_e = ""
    if not per_run:
        where_c = f"WHERE ingest_run_id = {newest('curated')} AND device IN ('sda', 'sdb')"
        where_e = f"WHERE ingest_run_id = {newest('found')} AND device IN ('sda', 'sdb')"
    return sql(f"""
    SELECT p.*, c.root_cause_hint AS top_root_cause, c.workload_pattern AS root_cause_workload,
        c.n AS root_cause_events
    FROM (SELECT {keys}, min(timestamp) AS run_time, CAST(round(CAST(avg(avg_latency_ms) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_latency_ms,
            CAST(round(CAST(avg(util_pct) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_util_pct, CAST(round(CAST(avg(total_iops) AS DECIMAL(38, 9)), 0) AS DOUBLE) AS avg_iops,
            CAST(round(CAST(avg(total_throughput_mb_s) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_throughput_mb_s,
            CAST(round(CAST(avg(saturation_score) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_saturation
        FROM curated {where_c} GROUP BY {keys}) p
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {keys}
            ORDER BY n DESC, critical DESC, root_cause_hint, workload_pattern) AS rn
        FROM (SELECT {keys}, root_cause_hint, workload_pattern, count(*) AS n,
                count(*) FILTER (severity = 'critical') AS critical
            FROM found {where_e} GROUP BY {keys}, root_cause_hint, workload_pattern)) c
    ON {' AND '.join(f'p.{k} = c.{k}' for k in keys.split(', '))} AND c.rn = 1""", "curated", "found")


def _pivot() -> str:
    cells = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
    chosen = ", ".join(text(m) for m in profile.FOCUS_METRICS)
    return sql(f"SELECT metric_name, {cells} FROM found WHERE metric_name IN ({chosen}) GROUP BY metric_name", "found")


def _event_context() -> str:
    both = [c for c in profile.CONTEXT_COLUMNS if c in (*EVENT_CONTEXT, "workload_pattern")]
    extra = ", ".join(f"c.{c} AS {c}_sample" if c in both else f"c.{c}" for c in profile.CONTEXT_COLUMNS)
    body = f"""SELECT {', '.join('e.' + c.strip() for c in EVENT_NAMES.split(','))}, {extra}
        FROM found e LEFT JOIN curated c USING (device, timestamp)"""
    return sql(settled(body, ["anomaly_score"]), "found", "curated")


def _recommendations() -> str:
    def cause(words: str) -> str:
        return f"EXISTS (SELECT 1 FROM top_causes WHERE lower(root_cause_hint) LIKE '%{words}%')"

    conditions = [
        ("(SELECT critical_anomalies > 0 FROM kpis)", summary.REVIEW_CRITICAL),
        ("(SELECT avg_util_pct >= 80 FROM kpis)", summary.INVESTIGATE_UTILIZATION),
        (cause("saturation"), summary.CORRELATE_SATURATION),
        (cause("write-heavy"), summary.INSPECT_WRITES),
    ]
    hits = " UNION ALL ".join(
        f"SELECT {i} AS place, {text(s)} AS recommendation WHERE {c}" for i, (c, s) in enumerate(conditions))
    return sql(f"""
    SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position, recommendation FROM (
        WITH hits AS ({hits})
        SELECT * FROM hits UNION ALL SELECT 9, {text(summary.REVIEW_DISTRIBUTION)}
        WHERE NOT EXISTS (SELECT 1 FROM hits))""", "kpis", "top_causes")


def _published() -> str:
    """Row counts when all samples are loaded as one run."""
    counts = {
        "device_overview": "(SELECT count(*) FROM overview)",
        "anomaly_timeline": "(SELECT count(*) FROM found)",
        "root_cause_summary": "(SELECT count(*) FROM (SELECT DISTINCT root_cause_hint, workload_pattern FROM found))",
        "device_run_summary": "(SELECT count(*) FROM overview)",
        "run_summary": "1::BIGINT",
        "device_health": "(SELECT count(*) FROM health)",
        "latest_run": "1::BIGINT",
    }
    return sql(" UNION ALL ".join(
        f"SELECT '{name}' AS dataset, {n} AS n" for name, n in counts.items()), "overview", "found", "health")


def _published_content() -> str:
    sources = {"device_overview": "overview", "root_cause_summary": "causes", "device_run_summary": "runs",
               "run_summary": "run_summary"}
    parts = " UNION ALL ".join(f"SELECT '{name}' AS dataset, {', '.join(chosen)} FROM {sources[name]}"
                               for name, chosen in PUBLISHED.items())
    return sql(settled(f"SELECT * FROM ({parts})", [f"v{i}" for i in range(1, 7)]), *sources.values())


def oracle_sql() -> dict[str, str]:
    found_rows = f"SELECT {EVENT_NAMES} FROM found"
    timeline = ", ".join(TIMELINE_COLUMNS)
    rounded_runs = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38, 9)), {d}) AS DOUBLE) AS {c}" for c, d in RUN_SUMMARY_DIGITS.items())
    latest_c, latest_e = newest("curated"), newest("found")
    evidence = EVIDENCE_SCHEMA.fieldNames()
    rolled = [f"{m}_rolling_{s}" for m in BASELINE_METRICS for s in ("mean", "std")]
    return {
        "raw_view": sql(f"SELECT {RAW_NAMES} FROM raw", "raw"),
        "curated_features": sql("SELECT * FROM curated", "curated"),
        "features_additive": sql("SELECT * FROM additive", "additive"),
        "features_clipped": sql("SELECT * FROM clipped", "clipped"),
        "workload_rules": sql(
            f"SELECT device, timestamp, {EIGHT_CLASSES} AS workload_pattern FROM curated", "curated"),
        "workload_adaptive": sql("""
            SELECT device, timestamp, CASE WHEN util_pct > 80 OR aqu_sz > 5 THEN 'saturated'
                WHEN r_s > r90 OR w_s > w90 THEN 'burst_io'
                WHEN avg_request_size_kb < 16 THEN 'small_io_pressure'
                WHEN avg_latency_ms > l90 THEN 'latency_sensitive' ELSE 'balanced' END AS workload_pattern
            FROM clipped, (SELECT quantile_cont(r_s, 0.9) AS r90, quantile_cont(w_s, 0.9) AS w90,
                quantile_cont(avg_latency_ms, 0.9) AS l90 FROM clipped)""", "clipped"),
        "source_iostat_logs": sql(f"""
            SELECT device, TIMESTAMP '{LOG_TIME}' AS timestamp, {', '.join(LOG_METRICS)} FROM raw
            WHERE NOT (r_s = 0 AND w_s = 0)""", "raw"),
        "source_csv": sql(f"""
            SELECT {RAW_NAMES} FROM (SELECT * REPLACE ({', '.join(f'0.0::DOUBLE AS {c}' for c in CSV_DROPPED)},
                'samples.csv' AS source_file, 'loaded' AS ingest_run_id) FROM raw)""", "raw"),
        "source_csv_mixed": sql(f"""
            SELECT {', '.join(n for n in RAW_SCHEMA.fieldNames() if n != 'source_file')} FROM (
                SELECT * REPLACE ('loaded' AS ingest_run_id, {', '.join(
                    f"CASE WHEN minute(timestamp) % {len(MIXED_DROPPED)} = {kind} THEN 0 ELSE {c} END AS {c}"
                    for kind, dropped in MIXED_DROPPED.items() for c in dropped)}) FROM raw)""", "raw"),
        "stored_runs": sql("""SELECT ingest_run_id, count(*) AS n, min(timestamp) AS first,
            max(timestamp) AS last FROM raw GROUP BY ingest_run_id""", "raw"),
        "replaced_table": sql(settled(
            "SELECT * REPLACE (CAST(NULL AS DOUBLE) AS avg_queue_depth) FROM overview", OVERVIEW_DOUBLES),
            "overview"),
        "exported_csv": sql(
            "SELECT * REPLACE (CAST(round(CAST(avg_anomaly_score AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_anomaly_score) FROM causes", "causes"),
        "published_row_counts": _published(),
        "rolling_baseline": sql(settled(
            f"SELECT device, timestamp, {', '.join(rolled)} FROM ({rolling(BASELINE_METRICS, 5)})", rolled),
            "curated"),
        "rolling_zscore_events": sql(settled(rolling_events(), ["anomaly_score"]), "rolled"),
        "iqr_events": sql(settled(iqr_events(COMBINED_METRICS), ["anomaly_score"]), "curated"),
        "combined_events": sql(settled(found_rows, ["anomaly_score"]), "found"),
        "event_details": sql(settled(
            f"SELECT device, timestamp, metric_name, {', '.join(evidence)} FROM found", evidence), "found"),
        "severity_union": sql(settled("SELECT * FROM all_events", ["anomaly_score"]), "all_events"),
        "enriched_events": sql(settled(enriched(iqr_events(COMBINED_METRICS)), ["anomaly_score"]), "curated"),
        "device_overview": sql(settled("SELECT * FROM overview", OVERVIEW_DOUBLES), "overview"),
        "device_overview_basic": sql(settled(
            "SELECT * EXCLUDE (p95_latency_ms, p99_latency_ms) FROM overview",
            [c for c in OVERVIEW_DOUBLES if not c.startswith("p9")]), "overview"),
        "anomaly_timeline": sql(settled(f"SELECT {timeline} FROM found", ["anomaly_score"]), "found"),
        "root_cause_summary": sql(settled("SELECT * FROM causes", ["avg_anomaly_score"]), "causes"),
        "root_cause_summary_rounded": sql(
            "SELECT * REPLACE (CAST(round(CAST(avg_anomaly_score AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_anomaly_score) FROM causes", "causes"),
        "device_run_summary": sql(settled("SELECT * FROM runs", RUN_DOUBLES), "runs"),
        "device_run_summary_rounded": sql(f"SELECT * REPLACE ({rounded_runs}) FROM runs", "runs"),
        "device_health": sql("SELECT * FROM health", "health"),
        "run_summary": sql(settled("SELECT * FROM run_summary", ["max_anomaly_score"]), "run_summary"),
        "curated_projection": sql(f"SELECT {', '.join(PROJECTION_COLUMNS)} FROM curated", "curated"),
        "fact_timeseries": sql(settled(f"""
            SELECT {', '.join(SERIES_COLUMNS)}, avg(avg_latency_ms) OVER w AS latency_rolling_mean,
                stddev_samp(avg_latency_ms) OVER w AS latency_rolling_std
            FROM curated WINDOW w AS (PARTITION BY device ORDER BY timestamp
                ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
            ["latency_rolling_mean", "latency_rolling_std"]), "curated"),
        "fact_hourly": sql(settled("""
            SELECT device, CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS hour,
                avg(avg_latency_ms) AS latency_mean,
                max(avg_latency_ms) AS latency_max, avg(total_iops) AS iops_mean,
                avg(util_pct) AS util_pct_mean, avg(aqu_sz) AS aqu_sz_mean
            FROM curated GROUP BY 1, 2""",
            ["latency_mean", "latency_max", "iops_mean", "util_pct_mean", "aqu_sz_mean"]), "curated"),
        "fact_percentiles": sql(settled("""
            SELECT device, quantile_cont(avg_latency_ms, 0.5) AS p50,
                quantile_cont(avg_latency_ms, 0.95) AS p95, quantile_cont(avg_latency_ms, 0.99) AS p99
            FROM curated GROUP BY device""", ["p50", "p95", "p99"]), "curated"),
        "published_tables": _published_content(),
        "latest_run": sql(f"SELECT {latest_e} AS anomaly_run_id, {latest_c} AS curated_run_id", "curated", "found"),
        "q01_critical_devices": sql(f"""SELECT DISTINCT device FROM found
            WHERE ingest_run_id = {latest_e} AND severity ILIKE 'critical'""", "found"),
        "q02_utilization_ranking": sql(settled(
            f"SELECT device, avg_util_pct FROM runs WHERE ingest_run_id = {latest_c}", ["avg_util_pct"]), "runs"),
        "q03_device_history": sql(settled("""
            SELECT device, ingest_run_id, run_time, avg_latency_ms, avg_util_pct, avg_iops,
                avg_throughput_mb_s, avg_saturation_score, top_root_cause
            FROM runs WHERE device ILIKE 'sda'""",
            ["avg_latency_ms", "avg_util_pct", "avg_iops", "avg_throughput_mb_s", "avg_saturation_score"]), "runs"),
        "q04_compare_devices": sql(settled("""
            SELECT device, ingest_run_id, run_time, avg_latency_ms, avg_util_pct FROM runs
            WHERE device ILIKE 'sda' OR device ILIKE 'sdb'""", ["avg_latency_ms", "avg_util_pct"]), "runs"),
        "q05_best_devices": sql("""
            SELECT device, CAST(sum(total_anomalies) AS BIGINT) AS total_anomalies,
                CAST(round(CAST(avg(avg_latency_ms) AS DECIMAL(38, 9)), 2) AS DOUBLE) AS avg_latency
            FROM runs GROUP BY device ORDER BY total_anomalies, device LIMIT 5""", "runs"),
        "q06_device_trend": sql(settled("""
            SELECT ingest_run_id, run_time, total_anomalies, critical_count, avg_latency_ms,
                avg_saturation_score FROM runs WHERE device ILIKE 'sda'""",
            ["avg_latency_ms", "avg_saturation_score"]), "runs"),
        "q07_explain_device": sql(settled(f"""
            SELECT device, avg_latency_ms, avg_util_pct, avg_iops, avg_saturation_score, avg_aqu_sz,
                top_root_cause, dominant_workload_pattern
            FROM runs WHERE ingest_run_id = {latest_c} AND device ILIKE 'sdb'""",
            ["avg_latency_ms", "avg_util_pct", "avg_iops", "avg_saturation_score", "avg_aqu_sz"]), "runs"),
        "q08_top_causes": sql(f"""
            SELECT root_cause_hint, workload_pattern, anomaly_count, critical_count, affected_devices
            FROM causes WHERE ingest_run_id = {latest_e} ORDER BY {CAUSE_ORDER} LIMIT 10""", "causes"),
        "q09_cause_trend": sql("""SELECT ingest_run_id, root_cause_hint, workload_pattern, anomaly_count,
            critical_count FROM causes""", "causes"),
        "q10_slow_and_queued": sql(f"""
            SELECT device, timestamp, avg_latency_ms, aqu_sz FROM curated
            WHERE ingest_run_id = {latest_c} AND avg_latency_ms > 10 AND aqu_sz > 2""", "curated"),
        "q11_multi_detector_devices": sql(f"""
            SELECT device, count(DISTINCT detector_type) AS detector_count FROM all_events
            WHERE ingest_run_id = {newest('all_events')}
            GROUP BY device HAVING count(DISTINCT detector_type) >= 3""", "all_events"),
        "q12_business_hours": sql("""
            SELECT CASE WHEN hour(timestamp) BETWEEN 9 AND 17 THEN 'business_hours' ELSE 'off_hours' END AS period,
                count(*) AS anomaly_count FROM found WHERE device ILIKE 'sdb' GROUP BY 1""", "found"),
        "q13_critical_share": sql(f"""
            , relabelled AS (SELECT * REPLACE ({EIGHT_CLASSES} AS workload_pattern) FROM curated)
            SELECT workload_pattern, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical_count,
                CAST(round(CAST(100.0::DOUBLE * count(*) FILTER (severity = 'critical') / count(*) AS DECIMAL(38, 9)), 1) AS DOUBLE) AS critical_pct
            FROM ({combined('relabelled')}) WHERE workload_pattern IN ('write_heavy', 'read_heavy')
            GROUP BY workload_pattern""", "curated"),
        "q14_score_p95": sql("""SELECT device, CAST(round(CAST(quantile_cont(anomaly_score, 0.95) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS p95_score
            FROM found GROUP BY device""", "found"),
        "q15_last_two_runs": sql("""
            SELECT ingest_run_id, min(run_time) AS run_time, CAST(sum(critical_count) AS BIGINT) AS critical_count
            FROM runs GROUP BY ingest_run_id ORDER BY run_time DESC, ingest_run_id LIMIT 2""", "runs"),
        "q16_worst_sample": sql("""
            SELECT device, timestamp, avg_latency_ms, aqu_sz, util_pct,
                CAST(round(CAST(avg_latency_ms * 0.4::DOUBLE + aqu_sz * 30 + util_pct * 0.3::DOUBLE AS DECIMAL(38, 9)), 2) AS DOUBLE) AS composite_stress
            FROM curated ORDER BY composite_stress DESC, timestamp, device LIMIT 1""", "curated"),
        "q17_worst_events": sql(settled(f"""
            SELECT device, timestamp, metric_name, severity, anomaly_score, root_cause_hint FROM found
            WHERE ingest_run_id = {latest_e}
            ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
                anomaly_score DESC, device, timestamp, metric_name LIMIT 25""", ["anomaly_score"]), "found"),
        "q18_severity_breakdown": sql(f"""SELECT device, severity, count(*) AS count FROM found
            WHERE ingest_run_id = {latest_e} GROUP BY device, severity""", "found"),
        "q19_causes_matching": sql(f"""
            SELECT ingest_run_id, workload_pattern, root_cause_hint, anomaly_count, critical_count FROM causes
            WHERE ingest_run_id = {latest_e} AND root_cause_hint ILIKE '%queue%'
            ORDER BY anomaly_count DESC, critical_count DESC, root_cause_hint, workload_pattern LIMIT 10""", "causes"),
        "q20_saturation_slope": sql("""
            SELECT device, CAST(round(CAST(regr_slope(avg_saturation, run_num) AS DECIMAL(38, 9)), 4) AS DOUBLE) AS saturation_slope FROM (
                SELECT *, row_number() OVER (PARTITION BY device ORDER BY run_time, ingest_run_id) AS run_num
                FROM (SELECT device, ingest_run_id, min(timestamp) AS run_time,
                    avg(saturation_score) AS avg_saturation FROM curated GROUP BY device, ingest_run_id))
            GROUP BY device""", "curated"),
        "q21_queued_but_not_busy": sql(f"""
            SELECT device, timestamp, metric_name, severity, util_pct, root_cause_hint FROM found
            WHERE ingest_run_id = {latest_e} AND root_cause_hint ILIKE '%queue%' AND util_pct < 70""", "found"),
        "q21_queue_metrics": sql(f"""
            SELECT device, timestamp, metric_name, severity, util_pct, root_cause_hint FROM queue_events
            WHERE ingest_run_id = {newest("queue_events")} AND root_cause_hint ILIKE '%queue%'
                AND util_pct < 70""", "queue_events"),
        "q22_saturation_hours": sql("""
            SELECT CAST(hour(timestamp) AS INTEGER) AS hour_of_day, count(*) AS event_count FROM found
            WHERE metric_name ILIKE '%saturation%' GROUP BY 1 ORDER BY event_count DESC, hour_of_day LIMIT 5""",
            "found"),
        "q23_top_causes_per_run": sql(f"""
            SELECT ingest_run_id, root_cause_hint, workload_pattern, anomaly_count, critical_count,
                affected_devices, CAST(round(CAST(avg_anomaly_score AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_anomaly_score,
                CAST(rank_in_run AS INTEGER) AS rank_in_run
            FROM (SELECT *, row_number() OVER (PARTITION BY ingest_run_id ORDER BY {CAUSE_ORDER}) AS rank_in_run
                FROM causes) WHERE rank_in_run <= 3""", "causes"),
        "q24_performance_with_cause": _with_cause(True),
        "q24_latest_run_with_cause": _with_cause(False),
        "q25_causes_this_month": sql("""
            SELECT root_cause_hint, count(*) AS occurrences FROM found
            WHERE timestamp >= date_trunc('month', TIMESTAMP '2024-01-31 00:00:00')
            GROUP BY root_cause_hint ORDER BY occurrences DESC, root_cause_hint LIMIT 10""", "found"),
        "q26_events_per_run": sql("SELECT * FROM run_counts", "run_counts"),
        "q27_read_write_ratios": sql(f"""
            SELECT device, CAST(round(CAST(avg(read_ratio) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_read_ratio, CAST(round(CAST(avg(write_ratio) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_write_ratio
            FROM curated WHERE ingest_run_id = {latest_c} GROUP BY device""", "curated"),
        "q28_saturation_by_device": sql(f"""
            SELECT device, CAST(round(CAST(avg(saturation_score) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS avg_saturation,
                CAST(round(CAST(max(saturation_score) AS DECIMAL(38, 9)), 3) AS DOUBLE) AS max_saturation
            FROM curated WHERE ingest_run_id = {latest_c} GROUP BY device""", "curated"),
        "q29_device_change": _changes(),
        "q29_run_change": _run_change(),
        "profile_describe": _describe("curated", profile.DESCRIBED),
        "profile_describe_ten": _describe("curated", profile.EXPLORED),
        "profile_describe_raw": _describe("raw", RAW_METRICS),
        "profile_nulls": _nulls("curated", CURATED_SCHEMA.fieldNames()),
        "profile_nulls_dirty": _nulls("dirty_curated", CURATED_SCHEMA.fieldNames()),
        "profile_nulls_raw": _nulls("raw", RAW_SCHEMA.fieldNames()),
        "profile_quantiles": _quantiles(),
        "profile_means_by_device": _means("device", profile.DEVICE_MEANS, 4),
        "profile_means_by_hour": _means("hour_of_day", profile.HOUR_MEANS, 3),
        "profile_means_by_workload": _means("workload_pattern", profile.WORKLOAD_MEANS, 4),
        "profile_corr": _correlations(),
        "profile_histogram": _histogram(),
        "profile_above_p99": sql(f"""
            SELECT {', '.join(profile.SLOWEST_COLUMNS)} FROM curated
            WHERE avg_latency_ms > (SELECT quantile_cont(avg_latency_ms, 0.99) FROM curated)""", "curated"),
        "profile_top_saturation": sql(
            "SELECT * FROM curated ORDER BY saturation_score DESC, device, timestamp LIMIT 10", "curated"),
        "profile_top_health": sql("""
            SELECT device, timestamp, avg_latency_ms, util_pct, aqu_sz, saturation_score, anomaly_flag
            FROM health ORDER BY saturation_score DESC, device, timestamp LIMIT 25""", "health"),
        "profile_frequencies": _frequencies(),
        "profile_cause_pairs": sql(
            "SELECT device, root_cause_hint, count(*) AS n FROM found GROUP BY device, root_cause_hint", "found"),
        "profile_pivot": _pivot(),
        "profile_coverage": _coverage(),
        "profile_coverage_with_gaps": _gaps(),
        "profile_event_context": _event_context(),
        "profile_critical_events": sql("""
            SELECT device, timestamp, metric_name, severity, workload_pattern, root_cause_hint
            FROM found WHERE severity = 'critical'""", "found"),
        "profile_event_series": sql("""
            SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS period, count(*) AS events,
                count(*) FILTER (severity = 'critical') AS critical_events, count(DISTINCT device) AS devices
            FROM found GROUP BY 1""", "found"),
        "profile_latest_events": sql(settled(
            f"{found_rows} ORDER BY timestamp DESC, device, metric_name LIMIT 50", ["anomaly_score"]), "found"),
        "summary_kpis": sql("SELECT * FROM kpis", "kpis"),
        "summary_affected": sql(settled("""
            SELECT device, anomaly_count, critical_anomaly_count, dominant_workload_pattern, avg_latency_ms
            FROM overview ORDER BY critical_anomaly_count DESC, anomaly_count DESC, device LIMIT 5""",
            ["avg_latency_ms"]), "overview"),
        "summary_causes": sql("SELECT * FROM top_causes", "top_causes"),
        "summary_workloads": sql("""
            SELECT dominant_workload_pattern, count(*) AS devices FROM overview
            GROUP BY 1 ORDER BY devices DESC, dominant_workload_pattern LIMIT 5""", "overview"),
        "summary_recommendations": _recommendations(),
        "quality_checks": _quality(),
        "quality_of_dirty_rows": _dirty_quality(),
        "hints_all_metrics": _graded_hints(),
    }

"""The driver's `events` table read as raw device samples.

The given tables hold no disk metrics; this fixed mapping turns each event row into one
sample, so every operator can run over a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values of the mapping ---
DEVICES = ["nvme0n1", "nvme1n1", "sda", "sdb", "dm-0"]
SLOWNESS = [1.0, 1.0, 2.0, 10.0, 3.0]
RUN_DAYS = 5
LAST_RUN = 5
# --- End of fixed values ---


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Raw samples from `<folder>/events.parquet`; reads five of its six columns."""
    def slot(values: list) -> str:
        return f"element_at(array({', '.join(map(repr, values))}), CAST(pmod(user_id, {len(values)}) AS INT) + 1)"

    def unless_idle(rate: str) -> str:
        return f"CASE WHEN event_type = 'error' AND k < 5 THEN 0D ELSE {rate} END"

    columns = {
        "device": "device",
        "timestamp": "CAST(ts AS TIMESTAMP)",
        "r_s": unless_idle("value * 4"),
        "w_s": unless_idle("k * 3"),
        "rmb_s": "CASE WHEN event_type = 'click' THEN value / 40 ELSE value / 10 END",
        "wmb_s": "k / 20",
        "r_await": "value / 50 * f",
        "w_await": "k / 25 * f",
        "aqu_sz": "value / 60",
        "util_pct": "least(100D, k * 0.6D + value / 5)",
        "rrqm_s": "k * 0.5D",
        "wrqm_s": "value * 0.25D",
        "rareq_sz": "k + 4",
        "wareq_sz": "value / 2 + 4",
        "svctm": "value / 100 * f",
        "iowait_pct": "k / 4",
        "source_file": "'events.parquet'",
        "ingest_run_id": f"concat('run-0', least({LAST_RUN}, (dayofmonth(ts) - 1) DIV {RUN_DAYS}))",
    }
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "ts", "value", "event_type", "props", "user_id")
    return (
        events.selectExpr("ts", "value", "event_type", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS k",
                    f"{slot(DEVICES)} AS device", f"CAST({slot(SLOWNESS)} AS DOUBLE) AS f")
        .selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])
    )


# --- Fixed values of the faults: minute of the sample -> what is wrong with it ---
FAULTS = {
    1: {"device": "CAST(NULL AS STRING)"},
    2: {"timestamp": "CAST(NULL AS TIMESTAMP)"},
    3: {"util_pct": "util_pct + 100"},
    4: {"util_pct": "-1D"},
    5: {"r_s": "double('NaN')"},
    6: {"r_s": "-1D - r_s"},
    7: {"w_s": "CAST(NULL AS DOUBLE)"},
    8: {"w_s": "-2D"},
    9: {"rmb_s": "-0.5D"},
    10: {"wmb_s": "-0.25D"},
    11: {"aqu_sz": "-3D"},
    12: {"svctm": "double('NaN')", "source_file": "CAST(NULL AS STRING)"},
}
BAD_LABEL_MINUTE = 13
BAD_LABEL = "mystery"
SILENT_DEVICE = "sda"
# --- End of fixed values ---


def read_dirty_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of `read_feed` with faults planted by the minute of their timestamp."""
    raw = read_feed(spark, folder)

    def faulty(column: str) -> str:
        arms = " ".join(f"WHEN {minute} THEN {fault[column]}" for minute, fault in FAULTS.items() if column in fault)
        return f"CASE minute(timestamp) {arms} ELSE {column} END AS {column}" if arms else column

    return raw.selectExpr(*map(faulty, raw.columns))

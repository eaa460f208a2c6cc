"""Headline queries, timed: the published log and point workloads rebuilt by rule, and queries over $BENCH_SF_DIR.

Prints one JSON line. Each figure is the median of warm runs, in seconds; ``*_cold`` is the first.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.queries import SELECTS
from quern.session import Engine

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

#: 192,000 log rows, 100 ms apart; and 1,000,000 rows (id, v, g = id % 100).
LOGS = {
    "logs_count": "SELECT COUNT(*) AS c FROM logs",
    "logs_sum_avg": "SELECT SUM(lat) AS s, AVG(lat) AS a FROM logs",
    "logs_window": "SELECT COUNT(*) AS c, SUM(lat) AS s FROM logs WHERE ts >= '2024-01-01T03:00:00Z' AND ts < '2024-01-01T04:00:00Z'",
    "logs_group": "SELECT level, COUNT(*) AS c FROM logs GROUP BY level",
    "logs_like": "SELECT COUNT(*) AS c FROM logs WHERE level LIKE 'erro%'",
    "logs_top10": "SELECT ts, level FROM logs ORDER BY ts DESC LIMIT 10",
}
POINTS = {
    "points_sum": "SELECT SUM(id) AS s FROM points",
    "points_group": "SELECT g, COUNT(*) AS c FROM points GROUP BY g",
    "points_top10": "SELECT id FROM points ORDER BY id DESC LIMIT 10",
    "points_get": "SELECT * FROM points WHERE id = 42",
    "points_count": "SELECT COUNT(*) AS c FROM points",
}
OVER_SF = ("count_star", "sum_long", "group_multi", "agg_filtered", "filter_ts_window", "like_infix", "hourly_errors", "having", "order_limit_pk_desc", "distinct")


def main() -> None:
    folder = tempfile.mkdtemp(prefix="quern-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e = Engine(spark, f"file://{folder}/engine")
    times: dict[str, float] = {}

    def clock(name: str, run) -> None:  # noqa: ANN001
        taken = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run()
            taken.append(time.perf_counter() - began)
        times[f"{name}_cold"], times[name] = round(taken[0], 4), round(statistics.median(taken[1:]), 4)

    try:
        e.execute("CREATE TABLE logs (ts timestamp PRIMARY KEY, level string, lat float)")
        e.execute("CREATE TABLE points (id int PRIMARY KEY, v string, g int)")
        x = F.col("id") % 100
        logs = spark.range(192_000).select(F.timestamp_millis(F.col("id") * 100 + 1_704_067_200_000).alias("ts"), F.when(x < 60, "info").when(x < 85, "warn").otherwise("error").alias("level"), (F.col("id") % 1000 / 10).alias("lat"))
        began = time.perf_counter()
        e.insert_frame("logs", logs)
        times["write_192k"] = round(time.perf_counter() - began, 4)
        e.insert_frame("points", spark.range(1_000_000).select("id", F.concat(F.lit("v"), "id").alias("v"), (F.col("id") % 100).alias("g")))
        began = time.perf_counter()
        e.execute("ADMIN COMPACT")
        times["compact"] = round(time.perf_counter() - began, 4)
        for name, sql in (LOGS | POINTS).items():
            clock(name, lambda sql=sql: e.sql(sql).collect())
        for name, sql in (("update_100k", "UPDATE points SET g = g + 1 WHERE id >= 100000 AND id < 200000"), ("delete_100k", "DELETE FROM points WHERE id >= 500000 AND id < 600000")):
            began = time.perf_counter()
            e.execute(sql)
            times[name] = round(time.perf_counter() - began, 4)
        clock("points_group_with_changes", lambda: e.sql(POINTS["points_group"]).collect())
        for t in ("nation", "part", "orders", "lineitem", "events"):
            e.register_parquet(t, f"{SF_DIR}/{t}.parquet")
        for name in OVER_SF:
            clock(name, lambda sql=SELECTS[name][0]: e.sql(sql).write.format("noop").mode("overwrite").save())
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    total = sum(v for k, v in times.items() if not k.endswith("_cold"))
    print(json.dumps({"metric": "sum of median query times", "value": round(total, 4), "unit": "sec", "queries": times, "sf": SF_DIR}))


if __name__ == "__main__":
    main()

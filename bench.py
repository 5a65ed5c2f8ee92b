"""Times the headline queries: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8). Each query
is run once to warm up and then timed by writing all of its rows to the noop sink. The survey steps of the
published capacity run follow, on its generator's rows: the import of a table of 13 channels into a store, the five-sample mean filter
published as a channel (1 M rows), the filter alone (8 M rows), and scans of one and of all channels.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = """moving_mean_complete moving_median_complete hampel_truncated segment_islands flight_summary base_station_quality
interpolate_base nearest_neighbours_k grid_idw empirical_variogram reciprocal_quality crossover_outliers line_crossovers energy_rebin channel_quality
formula_channel membership_filter smooth_nine_point reduction_to_pole line_leveling_solution butterworth_line_filter ordinary_kriging session_gap""".split()


def survey(spark: SparkSession, n: int):
    """30 transects, a field with a wave of 101 samples."""
    line = f"CAST(floor(id / {n // 30 + 1}) AS SMALLINT)"
    extra = [f"id * {k + 1} * 0.5D AS aux_{k}" for k in range(8)]
    return spark.range(n).selectExpr("id AS row_id", f"{line} AS line", "id * 0.1D AS time", f"50000 + 1000 * {line} + 0.001D * id + 2 * sin(2 * pi() * id / 101) AS mag", "50000 + sin(id * 0.001D) AS base", *extra)


def capacity(spark: SparkSession) -> dict[str, float]:
    from strataline.operators.lines import filter_runs
    from strataline.plans.store import SurveyStore

    took, folder = {}, tempfile.mkdtemp(prefix="strataline-bench-")

    def timed(name, run):
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    try:
        store = SurveyStore(spark, f"file://{folder}/store")
        held = []
        timed("import_1m_rows_13_channels", lambda: held.append(store.import_table("survey", survey(spark, 1_000_000))))
        database = held[0]
        timed("scan_1_channel_1m_rows", lambda: noop(store.scan(database, ["mag"])))
        timed("scan_all_channels_1m_rows", lambda: noop(store.scan(database, ["line", "time", "mag", "base", *(f"aux_{k}" for k in range(8))])))
        timed("mean_filter_channel_1m_rows", lambda: store.filter_channel(database, "mag", "mean", "mean", 5, line="line"))
        timed("mean_filter_8m_rows", lambda: noop(filter_runs(survey(spark, 8_000_000), "mag", ["line"], 5).select("row_id", "filtered")))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strataline.queries import QUERIES

    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    took |= capacity(spark)
    print(json.dumps({"metric": "headline survey queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()

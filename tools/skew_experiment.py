"""Skew experiment: exact median and row positions when one key holds a third
of all rows, against the plain window formulations.

Input is derived by Spark from the driver's events table (each row repeated
``--times`` times), so nothing is synthesised.  Task times come from Spark's
event log written to a scratch folder (the UI stays off).

Usage: python tools/skew_experiment.py [sf_dir] [--times N]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def task_stats(log_dir: str) -> dict[int, list[float]]:
    out: dict[int, list[float]] = {}
    for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(f):
            continue
        with open(f) as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:  # line still being written
                    continue
                if ev.get("Event") == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    out.setdefault(ev["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"]) / 1000)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 and not sys.argv[1].startswith("--") else "/root/testdata/sf0.1"
    times = int(sys.argv[sys.argv.index("--times") + 1]) if "--times" in sys.argv else 60
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from benchlens.operators import ranking
    from benchlens.session import local_session
    log_dir = tempfile.mkdtemp(prefix="benchlens-evlog-")
    spark = local_session(8, 32, app="skew", extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                                          "spark.eventLog.buffer.kb": "1k",
                                                          "spark.eventLog.compress": "false",
                                                          # small advisory size: AQE would otherwise merge the
                                                          # few-MB partitions of this small input into one task
                                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m"})
    e = spark.read.parquet(f"{sf}/events.parquet")
    big = (e.select("event_id", "user_id", "event_type", "value", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("rep"))
            .select((F.col("event_id") * times + F.col("rep")).alias("oid"),
                    F.when(F.col("event_id") % 3 == 0, F.lit("hot"))
                     .otherwise(F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string"))).alias("k"),
                    (F.col("value") * 100 + F.col("rep")).alias("v")))
    staged = os.path.join(tempfile.mkdtemp(prefix="benchlens-skew-"), "big")
    big.repartition(32).write.parquet(staged)  # many files: the scan itself is parallel
    big = spark.read.parquet(staged)
    n = big.count()
    print(f"rows={n}  hot share={big.where('k = \"hot\"').count() / n:.3f}")

    def run(name, build):
        """Time building (eager checkpoints count too) and running the query."""
        time.sleep(1.0)
        before = set(task_stats(log_dir))
        t0 = time.time()
        rows = build().collect()
        dt = time.time() - t0
        time.sleep(1.0)  # let the event log flush
        after = task_stats(log_dir)
        new = {s: v for s, v in after.items() if s not in before}
        worst = max((max(v) for v in new.values()), default=0.0)
        med = statistics.median([x for v in new.values() for x in v]) if new else 0.0
        print(f"{name:34s} {dt:6.2f}s  longest task {worst:5.2f}s  median task {med:5.2f}s  stages {len(new)}")
        if "-v" in sys.argv:
            for st, v in sorted(new.items()):
                print(f"    stage {st:3d}: tasks {len(v):3d}  max {max(v):5.2f}s  median {statistics.median(v):5.2f}s")
        return rows

    a = run("median: counted pairs in ranges", lambda: ranking.ordinal_median(big, ["k"], "v", "m"))
    w = Window.partitionBy("k").orderBy("v")
    naive = (big.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k")))
                .where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("k", F.col("v").alias("m")))
    b = run("median: window over raw rows", lambda: naive)
    assert {r.k: r.m for r in a} == {r.k: r.m for r in b}

    c = run("positions: written ranges", lambda: ranking.row_positions(big, ["k"], ["oid"], "pos")
            .groupBy("k").agg(F.max("pos").alias("mx"), F.sum("pos").alias("s")))
    naive_pos = big.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("oid")))
    d = run("positions: row_number window", lambda: naive_pos.groupBy("k").agg(F.max("pos").alias("mx"),
                                                                                F.sum("pos").alias("s")))
    assert {r.k: (r.mx, r.s) for r in c} == {r.k: (r.mx, r.s) for r in d}
    print("results identical; event log:", log_dir)
    spark.stop()


if __name__ == "__main__":
    main()

"""Times of the engine over one scale: python bench.py prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: threads of the local master (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from deltaloom import queries as views  # noqa: E402


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}

    def timed(name: str, f) -> object:
        t = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - t, 3)
        return out

    made = views.queries()
    timed("warm_up", lambda: made["maintain_join3_agg_mixed"](spark, folder).collect())
    for name in ("build_proj", "build_agg", "build_join2", "build_join3_agg", "build_items_revenue"):
        timed(name, lambda n=name: made[n](spark, folder).count())

    # Two views of three tables each, kept over inserts, updates and deletes of orders, one row a transaction.
    tables, definition = views.VIEWS["join3_agg"]
    engine, found = views._engine(spark, folder, *tables)
    engine.create_view("regions", definition)
    engine.create_view("lines", views.VIEWS["join3"][1])
    timed("build_both", engine.run_pending)
    changes = views.order_changes(found["orders"], "mixed").withColumn("lsn", F.row_number().over(Window.orderBy("ord")).cast("long")).withColumn("xid", F.col("lsn")).cache()
    n, at = changes.count(), 0
    sizes = {"10_tx": 10, "100_tx": 100, "1000_tx": 1000, "2000_tx": 2000, "backlog": min(20_000, n - 3110)}
    for label, size in sizes.items():
        engine.log.append({"public.orders": changes.where((F.col("lsn") > at) & (F.col("lsn") <= at + size))})
        timed(f"round_{label}", engine.drain)
        at += size
    end = engine.log.end()
    timed("full_recompute", lambda: [engine._rows_of(views.validate(engine, d), [engine._base(f"public.{t}", end) for t in views.VIEWS[v][0]]).write.format("noop").mode("overwrite").save() for v, d in (("join3_agg", definition), ("join3", views.VIEWS["join3"][1]))])
    feed = engine._view("regions")
    timed("read_feed", lambda: engine.changes("regions", feed["oldest_seq"] - 1, feed["epoch"], 1 << 40).count())

    # Fan-out: 200 customers change, each in a transaction of its own, and with each all of its rows in the view.
    tables, definition = views.VIEWS["join2"]
    engine, found = views._engine(spark, folder, *tables)
    engine.create_view("v", definition)
    engine.run_pending()
    c = found["customers"].where("id < 200")
    new = F.struct(*[(F.lit("MOVED") if n == "segment" else F.col(n)).alias(n) for n in c.columns])
    engine.log.append({"public.customers": c.select((F.col("id") + 1).cast("long").alias("lsn"), (F.col("id") + 1).cast("long").alias("xid"), F.lit(0).alias("ord"), F.lit("U").alias("op"), F.struct(*c.columns).alias("before"), new.alias("after"))})
    timed("fan_out_200_tx", engine.drain)
    backlog = sizes["backlog"]
    print(
        json.dumps(
            {
                "metric": "engine_total_sec", "value": round(sum(v for k, v in took.items() if k != "warm_up"), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder),
                "backlog_tx": backlog, "backlog_tx_per_sec": round(backlog / took["round_backlog"], 1), "fan_out_tx_per_sec": round(200 / took["fan_out_200_tx"], 1),
                "fan_out_changes": engine.current_seq("v"), "recompute_over_round_10_tx": round(took["full_recompute"] / took["round_10_tx"], 2),
            }
        )
    )


if __name__ == "__main__":
    main()

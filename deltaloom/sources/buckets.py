"""Rows kept in buckets by the hash of some columns, so that a round reads and writes only the buckets it touches.

A layout is a plain dict: ``by`` (columns), ``n`` (number of buckets), ``parts`` (bucket to folder; a bucket without rows
has none). Replacing buckets gives a new layout that shares the other folders with the old one, which stays readable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

#: Layouts of more buckets than this would be more files than a driver should list.
MOST = 4096
COLUMN = "__b"


def number(bytes_: int, per_bucket: int) -> int:
    return max(1, min(MOST, -(-bytes_ // per_bucket)))


def bucket_of(columns: Sequence[str | Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def put(store: Store, rows: DataFrame, by: Sequence[str], n: int, kind: str) -> dict:
    """Writes rows as a layout. Buckets with very many rows (a hot join key) are split over tasks and files."""
    path = store.folder(kind)
    if n == 1:
        rows.write.parquet(f"{path}/{COLUMN}=0")
        return {"by": list(by), "n": 1, "parts": {"0": f"{path}/{COLUMN}=0"}}
    rows.withColumn(COLUMN, bucket_of([F.col(c) for c in by], n)).hint("rebalance", COLUMN).write.partitionBy(COLUMN).parquet(path)
    parts = {x.split("=")[1]: f"{path}/{x}" for x in store.names(path) if x.startswith(f"{COLUMN}=")}
    return {"by": list(by), "n": n, "parts": parts}


def get(spark: SparkSession, layout: dict, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
    """The rows of a layout, or of some of its buckets."""
    paths = [p for k, p in layout["parts"].items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def touched(layout: dict, *keys: DataFrame) -> set[int] | None:
    """The buckets in which rows with the given values of ``by`` are (the columns of each frame, in that order); None for
    all, without a job, if there is one bucket. At most ``MOST`` numbers come to the driver."""
    if layout["n"] == 1:
        return None
    found: set[int] = set()
    for frame in keys:
        found |= {r["b"] for r in frame.select(bucket_of([F.col(f"`{c}`") for c in frame.columns], layout["n"]).alias("b")).distinct().collect()}
    return found


def replaced(store: Store, layout: dict, rows: DataFrame, only: set[int] | None, kind: str) -> tuple[dict, list[str]]:
    """(the layout with ``rows`` in place of some buckets, the folders that it no longer uses)."""
    new = put(store, rows, layout["by"], layout["n"], kind)
    kept = {} if only is None else {k: p for k, p in layout["parts"].items() if int(k) not in only}
    return new | {"parts": kept | new["parts"]}, [p for k, p in layout["parts"].items() if k not in kept]

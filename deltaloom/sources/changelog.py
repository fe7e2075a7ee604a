"""The change log: transactions in commit order, each a set of row changes of registered tables.

A segment holds whole transactions and is one Parquet folder for each relation, with columns
``lsn, xid, ord, op (I, U, D, T), before, after, unchanged``; ``before`` and ``after`` are structs of the relation's
columns, ``unchanged`` names columns whose value was not sent with an update. A segment counts once its entry, a numbered
file, is written, so a transaction that was not written to its end is never seen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store

Change = tuple[str, str, dict | None, dict | None]


def _entry(number: int) -> str:
    return f"segments/{number:012d}.json"


def change_schema(columns: T.StructType) -> T.StructType:
    row = T.StructType([T.StructField(f.name, f.dataType, True) for f in columns.fields])
    return T.StructType(
        [
            T.StructField("lsn", T.LongType()), T.StructField("xid", T.LongType()), T.StructField("ord", T.IntegerType()),
            T.StructField("op", T.StringType()), T.StructField("before", row), T.StructField("after", row),
            T.StructField("unchanged", T.ArrayType(T.StringType())),
        ]
    )


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = Store(spark, f"{root}/log")
        self._known: dict[int, dict] = {}

    def segments(self) -> list[dict]:
        """The segments, in order; an entry never changes, so each is read once."""
        there = self.store.numbered("segments")
        self._known = {n: self._known.get(n) or self.store.read(_entry(n)) for n in there}
        return [x for x in self._known.values() if x]

    def end(self) -> int:
        """The position of the last committed transaction."""
        found = self.segments()
        return found[-1]["to"] if found else 0

    def append(self, frames: dict[str, DataFrame]) -> int:
        """Commits a segment: for each relation its changes, with positions after the log's end. Returns the new end. A
        transaction lies whole in one segment: one that goes on at a position that the log has is refused, as is a
        position with two transactions, or a change without one. Of two writers at once one is first; the other's
        changes are refused if they aren't after the first one's."""
        paths, counts, low, high = {}, {}, None, None
        written: list[DataFrame] = []
        for relation, frame in frames.items():
            path = self.store.folder("segment")
            frame = frame.withColumn("unchanged", F.col("unchanged") if "unchanged" in frame.columns else F.lit(None).cast("array<string>"))
            frame.select("lsn", "xid", "ord", "op", "before", "after", "unchanged").write.parquet(path)
            rows = self.spark.read.parquet(path)
            bad = F.col("lsn").isNull() | F.col("xid").isNull() | F.col("ord").isNull() | ~F.coalesce(F.col("op").isin("I", "U", "D", "T"), F.lit(False))
            got = rows.agg(F.count("*").alias("n"), F.min("lsn").alias("a"), F.max("lsn").alias("b"), F.count_if(bad).alias("bad")).first()
            if got["bad"]:
                self.store.remove(path)
                raise ValueError(f"{got['bad']} changes of {relation} have no position, transaction, place in it or known operation")
            if got["n"]:
                paths[relation], counts[relation] = path, got["n"]
                written.append(rows.select("lsn", "xid"))
                low, high = min(got["a"], low if low is not None else got["a"]), max(got["b"], high or got["b"])
            else:
                self.store.remove(path)
        if not paths:
            return self.end()
        both = written[0]
        for rows in written[1:]:
            both = both.unionByName(rows)
        mixed = both.groupBy("lsn").agg(F.min("xid").alias("x"), F.max("xid").alias("y")).where("x < y").first()
        try:
            if mixed is not None:
                raise ValueError(f"position {mixed['lsn']} has two transactions, {mixed['x']} and {mixed['y']}")
            while True:
                end = self.end()
                if low <= end:
                    raise ValueError(f"changes at {low} are not after the log's end, {end}")
                number = max(self._known, default=0) + 1
                if self.store.create(_entry(number), {"from": low, "to": high, "changes": sum(counts.values()), "counts": counts, "paths": paths}):
                    return high
        except ValueError:
            for path in paths.values():
                self.store.remove(path)
            raise

    def trim(self, upto: int) -> int:
        """Removes segments that end at a position or before, but the last one, which tells the log's end."""
        self.segments()
        gone = [(n, s) for n, s in list(self._known.items())[:-1] if s and s["to"] <= upto]
        for n, s in gone:
            self.store.remove(_entry(n))
            for path in s["paths"].values():
                self.store.remove(path)
            del self._known[n]
        return len(gone)

    def commit(self, transactions: Iterable[list[Change]], schemas: dict[str, T.StructType]) -> int:
        """Commits transactions given as lists of (relation, op, before, after), one position each. For tests and small
        writers; large ones call :meth:`append`."""
        rows: dict[str, list] = {}
        lsn = self.end()
        for changes in transactions:
            lsn += 1
            for ord_, (relation, op, before, after, *rest) in enumerate(changes):
                full = lambda r, s=schemas[relation]: None if r is None else tuple(r.get(f.name) for f in s.fields)
                rows.setdefault(relation, []).append((lsn, 1000 + lsn, ord_, op, full(before), full(after), rest[0] if rest else None))
        return self.append({r: self.spark.createDataFrame(x, change_schema(schemas[r])) for r, x in rows.items()})

    def read(self, relation: str, columns: T.StructType, after: int, upto: int) -> DataFrame:
        """The relation's changes at positions in (after, upto]; only segments that can have some are opened."""
        schema = change_schema(columns)
        paths = [s["paths"][relation] for s in self.segments() if relation in s["paths"] and s["to"] > after and s["from"] <= upto]
        frame = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return frame.where((F.col("lsn") > after) & (F.col("lsn") <= upto))

    def upto(self, after: int, most: int) -> int:
        """The position to read to from ``after``: about ``most`` changes, whole segments, one at least."""
        at, n = after, 0
        for s in self.segments():
            if s["to"] > after and (n == 0 or n + s["changes"] <= most):
                at, n = s["to"], n + s["changes"]
            elif s["to"] > after:
                break
        return at

    def pending(self, after: int) -> int:
        return sum(s["changes"] for s in self.segments() if s["to"] > after)

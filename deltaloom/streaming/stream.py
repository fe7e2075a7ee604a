"""Structured Streaming around the engine.

``commits`` is a stream of the log's segments, one row each; ``maintain`` runs a round for each micro-batch of it, so a
query with ``availableNow`` catches up and one with ``processingTime`` keeps views current. The engine's manifest holds
the position, so a replayed micro-batch finds nothing to do: the stream's checkpoint may lag or be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from .engine import Engine


class _Segment(InputPartition):
    def __init__(self, rows: list[tuple[int, int, int]]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, tuple[int, int, int]] = {}  # entries never change

    def _segments(self) -> list[tuple[int, int, int]]:
        import json

        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        there = files.get_file_info(fs.FileSelector(f"{path}/log/segments", allow_not_found=True))
        for name in sorted(x.path for x in there if x.base_name.endswith(".json") and not x.base_name.startswith(".")):
            if name not in self.known:
                with files.open_input_stream(name) as f:
                    s = json.loads(f.read())
                self.known[name] = (s["from"], s["to"], s["changes"])
        return sorted(self.known.values())

    def initialOffset(self) -> dict:
        return {"lsn": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole segment: never within a transaction."""
        return {"lsn": max((s[1] for s in self._segments()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment([s for s in self._segments() if start["lsn"] < s[1] <= end["lsn"]])]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Nothing to do: the engine's manifest is the position."""


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deltaloom_commits"

    def schema(self) -> StructType:
        return StructType([StructField(n, LongType()) for n in ("from_lsn", "to_lsn", "changes")])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["root"])


def commits(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(CommitSource)
    return spark.readStream.format("deltaloom_commits").option("root", root).load()


def maintain(engine: Engine, checkpoint: str, **trigger) -> StreamingQuery:
    """A streaming query that keeps the engine's views current; ``trigger`` as for ``DataStreamWriter.trigger``."""

    def round_(_: DataFrame, __: int) -> None:
        engine.drain()

    return commits(engine.spark, engine.root).writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

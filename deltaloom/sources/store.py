"""Small files (manifests) in any Hadoop file system. A numbered file is written once: of two writers of one number, one
wins and the other is told, so nobody's work is undone unseen."""

from __future__ import annotations

import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith("/") else f"{self.root}/{name}")

    def read(self, name: str) -> dict | None:
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """Writes a file, all or nothing; False if there is one of that name already."""
        path, new = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.new")
        fs = path.getFileSystem(self._conf)
        stream = fs.create(new)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        if fs.getUri().getScheme() == "file":  # a local rename would replace; a link doesn't
            try:
                os.link(new.toUri().getPath(), path.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                fs.delete(new, False)
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(path), options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(path):
                return False
            raise
        return True

    def numbered(self, folder: str) -> list[int]:
        """The numbers of a folder's numbered files, ascending."""
        return sorted(int(n[:-5]) for n in self.names(folder) if re.fullmatch(r"\d+\.json", n))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def remove(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self._conf).delete(path, True)

    def folder(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or in a local session a local one
    where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        base = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/views-{uuid.uuid4().hex}"

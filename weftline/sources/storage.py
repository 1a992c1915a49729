"""Files by the Hadoop file system that a path is on: the driver's small bookkeeping (markers, renames), never rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """Whole-file operations; every path may be on another file system."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self._at(to)[1])

    def names(self, path: str) -> list[str]:
        """The names in a folder; none if it is not there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def put(self, path: str, value) -> None:
        """A JSON value as a file that is there whole or not at all."""
        fs, _ = self._at(path)
        part = f"{path}.{uuid.uuid4().hex}"
        stream = fs.create(self._at(part)[1])
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self.delete(path)
        if not self.rename(part, path):
            raise OSError(f"{path} can't be written")

    def get(self, path: str):
        """The value of ``put``; None if it is not there."""
        if not self.exists(path):
            return None
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

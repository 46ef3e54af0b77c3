"""Versions of a group of tables: what a reader sees is named by one small file, and each change names a new one.

Tables are written to fresh folders first. A version is a JSON file whose number is one more than the last; it
is written beside its place and renamed to it, and a rename to a taken name fails (as with Spark's own checkpoint files). So a change is
visible as a whole or not at all, a failed writer leaves the last version as it was, and of two writers one has to
look at the other's version and try again. Nothing that an older version names is overwritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark.sparkContext._jvm
        self._log = self._path(f"{folder}/versions")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._log.getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._log):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._log))
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/versions/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """Number and content of the latest version; (-1, {}) without any."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def publish(self, number: int, content: dict) -> bool:
        """Make this the version of that number; False if there is one already."""
        place, beside = f"{self.folder}/versions/{number:012d}.json", self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._log.toUri(), self._conf)
        try:
            files.rename(beside, self._path(place), options)
            return True
        except Exception as error:
            self._fs.delete(beside, False)
            if number in self.numbers():
                return False
            raise error

    def change(self, work: Callable[[dict], dict | None]) -> tuple[int, dict]:
        """Publish what work makes of the latest content, again if another writer was faster; None changes nothing."""
        while True:
            number, content = self.last()
            new = work(dict(content))
            if new is None:
                return number, content
            if self.publish(number + 1, new):
                return number + 1, new

    def write(self, group: str, rows: DataFrame, partition_by: str | None = None) -> str:
        """Write rows to a fresh folder of the group and return its path, for a version to name.

        The folder of a partitioned table is a partition load=<name> itself, so tables of several folders are read together.
        """
        writer = rows.write
        if not partition_by:
            path = f"{self.folder}/{group}/{uuid.uuid4().hex}"
            writer.parquet(path)
            return path
        path = f"{self.folder}/{group}/load={uuid.uuid4().hex}"
        writer.partitionBy(partition_by).parquet(path)
        return path

    def folders(self, path: str) -> list[str]:
        """Names of the folders of a partitioned table."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def load(self, paths: Iterable[str], schema) -> DataFrame:
        """The rows of all folders; without any, an empty table."""
        paths = list(paths)
        empty = self.spark.createDataFrame([], schema)
        if not paths:
            return empty
        reader = self.spark.read.schema(schema)
        if "/load=" in paths[0]:
            reader = reader.option("basePath", paths[0].split("/load=")[0])
        return reader.parquet(*paths).select(*empty.columns)

    def drop_unnamed(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last ``keep`` versions names, and older version files; returns the folders.

        For quiet times: a writer at work has folders that no version names yet.
        """
        numbers = self.numbers()
        texts = (p for n in numbers[-keep:] for v in self.read(n).values() for p in (v if isinstance(v, list) else [v]) if isinstance(p, str))
        # a table is named by its path, or by the places within its folder
        named = {x for p in texts for x in (p, p.split("/")[0])}
        gone = []
        for group in self._fs.listStatus(self._path(self.folder)):
            if group.isDirectory() and group.getPath().getName() != "versions":
                for table in self._fs.listStatus(group.getPath()):
                    path = f"{self.folder}/{group.getPath().getName()}/{table.getPath().getName()}"
                    if path not in named and table.getPath().getName() not in named:
                        self._fs.delete(table.getPath(), True)
                        gone.append(path)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{n:012d}.json"), False)
        return gone

"""A table as numbered commits, published one after another by compare-and-swap.

A commit is a folder of rows that Spark has written and a marker file that names it. The
marker is renamed to its number, which fails if the number is taken: of two writers that
start from one commit only one publishes, and the other is told. The rename is atomic on
HDFS and local file systems; a store without it needs another claim.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("_commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("_commits"))

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _markers(self) -> list[str]:
        """Names of the commits in order: number, kind and folder."""
        return sorted(name for s in self._fs.listStatus(self._at("_commits")) if not (name := s.getPath().getName()).startswith((".", "_")))

    def head(self) -> int:
        """The number of the last commit; -1 if there is none."""
        names = self._markers()
        return int(names[-1]) if names else -1

    def read(self, at: int | None = None) -> DataFrame:
        """The rows of all commits up to ``at``, from the last one that stands for all before it."""
        folders: list[str] = []
        for name in self._markers()[: None if at is None else at + 1]:
            kind, folder = self._note(name).split(" ", 1)
            folders = [folder] if kind == "whole" else [*folders, folder]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _note(self, name: str) -> str:
        stream = self._fs.open(self._at("_commits", name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, base: int, rows: DataFrame, whole: bool = False) -> bool:
        """Add ``rows`` as the commit after ``base``; false, and nothing added, if there is one already.

        ``whole``: the rows stand for all commits up to ``base``.
        """
        folder, note = f"rows-{uuid.uuid4().hex}", self._at(f"_note-{uuid.uuid4().hex}")
        rows.write.parquet(f"{self.path}/{folder}")
        stream = self._fs.create(note, False)
        stream.write(f"{'whole' if whole else 'more'} {folder}".encode())
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(note, self._at("_commits", f"{base + 1:020d}"), plain)
        except Exception as e:
            self._fs.delete(note, False)
            self._fs.delete(self._at(folder), True)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

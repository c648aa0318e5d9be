"""The folder that driver and executors share, and files of exact names in any store that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="domains-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> str:
    store, target = _store(spark, path)
    out = store.create(target, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return store.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of what lies in a folder, empty files too."""
    store, target = _store(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text; an error if it isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


class Files:
    """Files written piece by piece, each under its exact name; a file that is only named is empty."""

    LINES = 10_000

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: dict[str, list[str]] = {}
        self.streams: dict = {}

    def put(self, path: str, *lines: str) -> None:
        held = self.held.setdefault(path, [])
        held += lines
        if len(held) >= self.LINES or path not in self.streams:
            self._flush(path)

    def _flush(self, path: str) -> None:
        if path not in self.streams:
            store, target = _store(self.spark, path)
            self.streams[path] = store.create(target, True)
        if held := self.held.pop(path, []):
            self.streams[path].write(("\n".join(held) + "\n").encode())

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *error) -> None:
        for path in list(self.streams):
            try:
                if not error[0]:
                    self._flush(path)
            finally:
                self.streams.pop(path).close()

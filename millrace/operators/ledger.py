"""Small state in the shared folder: numbered marker files that are written whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from millrace.session import scratch


class Ledger:
    """JSON files and folders under ``home``. A run that dies leaves nothing that another one would take for published."""

    def __init__(self, spark: SparkSession, home: str | None = None, kind: str = "state") -> None:
        self.spark = spark
        self.home = home or f"{scratch(spark)}/{kind}-{uuid.uuid4().hex}"

    def _path(self, name: str) -> tuple[JavaObject, JavaObject]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, name: str) -> dict | None:
        """The content of a file, None if there is none."""
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        """Write a file under another name first, then rename it; an existing one is never replaced."""
        fs, path = self._path(name)
        _, half = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = fs.create(half, True)
        stream.write(json.dumps(content).encode())
        stream.close()
        if fs.exists(path) or not fs.rename(half, path):
            fs.delete(half, False)
            raise RuntimeError(f"{name} was written by another run")

    def last(self, kind: str) -> int:
        """The largest number among the files of a kind, -1 if there are none."""
        fs, path = self._path(kind)
        if not fs.exists(path):
            return -1
        numbers = (status.getPath().getName() for status in fs.listStatus(path))
        return max((int(n.removesuffix(".json")) for n in numbers if n.removesuffix(".json").isdigit()), default=-1)


def file_stamps(df: DataFrame) -> dict[str, str]:
    """File -> size and time of change, of every file ``df`` reads (none for a frame that is not read from files)."""
    spark, stamps = df.sparkSession, {}
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps[name] = f"{status.getLen()}:{status.getModificationTime()}"
    return stamps


def home_of(df: DataFrame, kind: str) -> str | None:
    """The home of state that is kept about the files of ``df``; None for a frame that is not read from files.

    It depends on the folder alone, so files that are added later find the state of the earlier ones.
    """
    folders = sorted({name.rsplit("/", 1)[0] for name in df.inputFiles()})
    if not folders:
        return None
    return f"{scratch(df.sparkSession, shared=True)}/{kind}-{hashlib.sha256(chr(10).join(folders).encode()).hexdigest()[:24]}"

"""Help with Spark sessions: workers that can import the library, and files in any Hadoop store."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def workers_ready(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package also when it isn't installed."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, on
    a local master only, below a temporary folder. Deleted when the process ends."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    folder = f"{root.rstrip('/')}/tidemill-{label}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_delete_all)
    _made.append((spark, folder))
    return folder


_made: list[tuple[SparkSession, str]] = []


def _delete_all() -> None:
    for spark, folder in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            Files(spark).delete(folder)


class Files:
    """Small text files beside tables, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        fs, p = self._open(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._open(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes a file that appears whole or not at all; False if the name is taken. Exclusive on local
        disks and on file systems whose rename fails if the target exists (HDFS); object stores need a
        committer that gives this."""
        fs, p = self._open(path)
        if fs.exists(p):
            return False
        _, part = self._open(f"{p.getParent()}/.{p.getName()}.{os.getpid()}.{id(text)}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.getUri().getScheme() == "file":  # a rename would replace a file that another writer published meanwhile
            source, target = (x.toUri().getPath() for x in (part, p))
            try:
                os.link(source, target)
            except FileExistsError:
                return False
            finally:
                fs.delete(part, False)
            return True
        if fs.rename(part, p):
            return True
        fs.delete(part, False)
        return False

    def delete(self, path: str) -> None:
        fs, p = self._open(path)
        fs.delete(p, True)

"""Versioned Parquet tables behind a manifest.

A commit writes new data files, then publishes `_manifest/<n>.json` by a rename that fails if the
version exists: data, schema, applied position and batch id become visible together. A crash before
that leaves files that no manifest lists. Keyed tables are hash-bucketed by key, so a batch rewrites
only the buckets that it touches; tables without keys list appended folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import lsn
from tidemill.functions.types import named
from tidemill.session import Files

BUCKETS = 16
#: Rows of a bucket, about, beyond which a table gets four times as many buckets.
BUCKET_ROWS = 1_000_000
#: Appended folders of a level that are merged into one of the next level.
FOLDERS = 32
#: Versions whose manifests stay.
VERSIONS = 100
HIDDEN_BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer published this version."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str | None = None  # JSON of the StructType
    keys: tuple[str, ...] = ()
    n_buckets: int = BUCKETS
    buckets: dict[str, str] = field(default_factory=dict)  # bucket -> folder
    appended: tuple[str, ...] = ()
    applied_lsn: str | None = None
    batch_id: int | None = None
    next_row: int = 0  # of synthetic positions
    n_rows: int = 0  # of a keyed table, about: what its buckets were chosen for

    @property
    def struct(self) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(self.schema)) if self.schema else None

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"keys": list(self.keys), "appended": list(self.appended)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(**(raw | {"keys": tuple(raw["keys"]), "appended": tuple(raw["appended"])}))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, table: str, catalog: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self.name = (schema, table)
        self.folder = "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate(filter(None, (root, catalog, schema, table))))

    def manifest(self) -> Manifest:
        """The newest version; version 0 of a table that doesn't exist."""
        numbers = [int(n[:-5]) for n in self.files.names(f"{self.folder}/_manifest") if n.endswith(".json") and n[:-5].isdigit()]
        return Manifest.from_json(self.files.read(f"{self.folder}/_manifest/{max(numbers)}.json")) if numbers else Manifest()

    def exists(self) -> bool:
        return self.manifest().schema is not None

    def read(self, m: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets. Columns that older files lack are null."""
        m = m or self.manifest()
        if m.schema is None:
            raise LookupError(f"no table {'.'.join(self.name)}")
        folders = [f for b, f in m.buckets.items() if buckets is None or int(b) in buckets] + ([] if buckets is not None else list(m.appended))
        if not folders:
            return self.spark.createDataFrame([], m.struct)
        return self.spark.read.schema(m.struct).parquet(*[f"{self.folder}/{f}" for f in folders])

    def write(self, rows: DataFrame, m: Manifest, schema: T.StructType, whole: bool = False) -> Manifest:
        """Writes rows of a keyed table by bucket, or as an appended folder; returns the next manifest,
        not yet published. whole: nothing of the version before remains."""
        folder = f"data/v={m.version + 1}-{uuid.uuid4().hex[:8]}"
        text = json.dumps(schema.jsonValue())
        if not m.keys:
            rows.write.parquet(f"{self.folder}/{folder}")
            return replace(m, schema=text, appended=((folder,) if whole else (*m.appended, folder)))
        rows.withColumn(HIDDEN_BUCKET, bucket_of(m.keys, m.n_buckets)).repartition(HIDDEN_BUCKET).write.partitionBy(HIDDEN_BUCKET).parquet(f"{self.folder}/{folder}")
        found = {n.split("=")[1]: f"{folder}/{n}" for n in self.files.names(f"{self.folder}/{folder}") if n.startswith(f"{HIDDEN_BUCKET}=")}
        return replace(m, schema=text, buckets=found if whole else m.buckets | found)

    def merge_folders(self, m: Manifest) -> Manifest:
        """Merges FOLDERS appended folders of one level into one of the next, so a row is rewritten once
        for each level and the folders stay few. Not yet published."""
        for level in range(64):
            small = [f for f in m.appended if _level(f) == level]
            if len(small) < FOLDERS:
                continue
            folder = f"data/v={m.version + 1}-{uuid.uuid4().hex[:8]}-l{level + 1}"
            rows = self.spark.read.schema(m.struct).parquet(*[f"{self.folder}/{f}" for f in small])
            rows.coalesce(max(1, rows.rdd.getNumPartitions() // FOLDERS)).write.parquet(f"{self.folder}/{folder}")
            m = replace(m, appended=tuple([folder, *[f for f in m.appended if f not in small]]))
        return m

    def commit(self, m: Manifest) -> Manifest:
        done = replace(m, version=m.version + 1)
        if not self.files.publish(f"{self.folder}/_manifest/{done.version}.json", done.to_json()):
            raise CommitConflict(f"{'.'.join(self.name)} version {done.version}")
        self.files.delete(f"{self.folder}/_manifest/{done.version - VERSIONS}.json")
        return done

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the last `keep`, and data folders that none of these lists."""
        numbers = sorted(int(n[:-5]) for n in self.files.names(f"{self.folder}/_manifest") if n.endswith(".json") and n[:-5].isdigit())
        live: set[str] = set()
        for n in numbers[-keep:]:
            m = Manifest.from_json(self.files.read(f"{self.folder}/_manifest/{n}.json"))
            live |= {"/".join(f.split("/")[:2]) for f in (*m.buckets.values(), *m.appended)}
        gone = [f"data/{d}" for d in self.files.names(f"{self.folder}/data") if f"data/{d}" not in live]
        for x in gone + [f"_manifest/{n}.json" for n in numbers[:-keep]]:
            self.files.delete(f"{self.folder}/{x}")
        return gone

    def applied(self) -> int | None:
        at = self.manifest().applied_lsn
        return None if at is None else lsn.parse(at)


def _level(folder: str) -> int:
    name = folder.rsplit("-l", 1)
    return int(name[1]) if len(name) == 2 and name[1].isdigit() else 0


def bucket_of(keys: tuple[str, ...], n: int):
    return F.pmod(F.xxhash64(*[named(k).cast("string") for k in keys]), F.lit(n)).cast("int")


def register_views(tables: list[VersionedTable]) -> None:
    """Temporary views schema_table over the newest versions, for Spark SQL."""
    for t in tables:
        if t.exists():
            t.read().createOrReplaceTempView("_".join(t.name))

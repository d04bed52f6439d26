"""What the operators of this subpackage share: the shared scratch folder, decisions about rows that
tasks look up by the rows' places (so texts are never shuffled), a per-worker word table, and joins
whose small side is broadcast only after its size was counted.

Conventions of every operator here: columns are chosen by name, so other columns of the input
(also ones named like an output) are ignored; a null text is an empty text; a null identifier
stays null; repeated rows are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Most keys (8 to 40 bytes each, about 60 MB as a hash relation) that a join may broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 300_000
#: Bytes of text whose words are held as Python objects at one time.
SLICE_BYTES = 1 << 20
#: Rows of a few numbers each that a task writes at least, where it is known how many there are.
TASK_ROWS = 100_000
#: Words that a worker keeps with their features; the table starts anew beyond that.
WORDS_KEPT = 150_000
#: Word tables that a worker keeps; workers serve one operator after another.
TABLES_KEPT = 2
#: Bytes of an Arrow batch, so that long texts don't make batches of 10,000 rows large.
BATCH_BYTES = 4 << 20


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def workers_ready(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, and lets Python workers of this machine import the package also
    when it isn't installed. On a cluster ship it with --py-files; a path that isn't there does no harm."""
    if spark.conf.get(_BATCH_CONF, None) is None:  # a limit that was set stays
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset
    (local tests) a folder of this process, removed at its end; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
        found = f"file://{own}"
    return found.rstrip("/")


_folders: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def sweep() -> None:
    """Deletes the scratch tables of this process; results that weren't written before are lost."""
    while _folders:
        folder, spark = _folders.popitem()
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, folder)


class Scratch:
    """Tables written in the shared folder, to cut lineage so that a lost executor costs one stage.
    They stay until sweep(), at the latest until the process ends, as lazy results read them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        workers_ready(spark)
        self.spark, self.folder = spark, f"{shared_root(spark)}/tidemill-{label}-{uuid.uuid4().hex[:12]}"
        _folders[self.folder] = spark

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many there are at most, if that is known. Few are written by few tasks: on a local
        disk each file, however small, and its checksum take a process each (chmod)."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))


def keep_or_drop(rows: DataFrame, keys: DataFrame, on: list[str], how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """left_semi or left_anti join; keys are broadcast if there are at most `most` of them."""
    small = keys.count() <= most
    return rows.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


#: Where a row stands: a hash of its file's path, and its number in that file. Never null, and no two rows share it.
FILE, AT = "tidemill_file", "tidemill_at"
#: Bytes of a row group of tables that tasks look up, so that a task holds few rows that aren't its own.
GROUP_BYTES = 1 << 20
#: A group with more than one row of so many counts as hot; there are fewer than this many hot groups.
HOT_SHARE = 1000


def located(docs: DataFrame, work: Scratch) -> DataFrame:
    """docs with FILE and AT. What isn't plainly read from Parquet files is written first, so that each
    reading of the result finds every row at the same place."""
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()

    def places(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(AT))

    if node.nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # a file format that doesn't number its rows
            return places(docs)
    return places(work.save(docs, "located"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark takes for it; a plain path if that is the local one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "/", full)


def arrow_opens(folder: str) -> bool:
    """Whether Arrow knows the folder's file system and finds the folder there."""
    from pyarrow import fs

    try:
        store, base = fs.FileSystem.from_uri(folder)
        return store.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


class Lookup:
    """A table of rows (FILE, AT, ...) that tasks look up by the places of the rows they scan: each task
    reads the row groups of its own places, so nothing is broadcast but the bounds of the table's files,
    of which there is one for each task that wrote it. Where Arrow can't open the shared folder (a store
    that only Spark reads), rows are joined with the table by a shuffle instead."""

    def __init__(self, rows: DataFrame, work: Scratch, name: str) -> None:
        workers_ready(work.spark)
        ordered = rows.repartitionByRange(FILE, AT).sortWithinPartitions(FILE, AT)
        ordered.write.option("parquet.block.size", GROUP_BYTES).mode("overwrite").parquet(work.path(name))
        saved = work.spark.read.schema(rows.schema).parquet(work.path(name))
        self.folder, self.schema = _qualified(work.spark, work.path(name)), rows.schema
        self.direct = arrow_opens(self.folder)
        place = F.struct(FILE, AT)
        files = saved.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).collect()
        self.files = sorted((tuple(r["lo"]), tuple(r["hi"]), r["name"]) for r in files)

    def saved(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.folder)

    def scanned(self, docs: DataFrame) -> DataFrame:
        """docs as tasks with a reader() need them: with FILE and AT."""
        return docs if self.direct else docs.join(self.saved(docs.sparkSession).hint("merge"), [FILE, AT])

    def reader(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, pa.Table | None]]:
        """For a batch of scanned(): the numbers of its rows that the table has, and their table rows."""
        if not self.direct:
            return lambda batch: (np.arange(batch.num_rows), pa.Table.from_batches([batch]) if batch.num_rows else None)
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        opened: dict[str, pq.ParquetFile] = {}
        read: dict[tuple[str, int], pa.Table] = {}

        def groups(file: int, lo: int, hi: int) -> Iterator[pa.Table]:
            wanted = {}
            for first, last, name in self.files:
                if last < (file, lo) or first > (file, hi):
                    continue
                if name not in opened:
                    opened[name] = pq.ParquetFile(store.open_input_file(f"{base}/{name}"))
                meta = opened[name].metadata
                column = {meta.schema.column(c).path: c for c in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    f, a = (meta.row_group(g).column(column[c]).statistics for c in (FILE, AT))
                    if f.min <= file <= f.max and (f.min < f.max or (a.min <= hi and a.max >= lo)):
                        wanted[name, g] = read.get((name, g)) or opened[name].read_row_group(g)
            for name in [n for n in opened if all(n != x for x, _ in wanted)]:
                opened.pop(name).close()
            read.clear()
            read.update(wanted)
            yield from wanted.values()

        def find(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Table | None]:
            file, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (FILE, AT))
            rows, found = [], []
            for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(file)) + 1) if len(at) else []:
                places = at[own]  # ascending, as the scan reads them
                for t in groups(int(file[own[0]]), int(places[0]), int(places[-1])):
                    there = t.column(AT).to_numpy()
                    k = np.minimum(np.searchsorted(places, there), len(places) - 1)
                    hit = np.flatnonzero((places[k] == there) & (t.column(FILE).to_numpy() == file[own[0]]))
                    if len(hit):
                        rows.append(own[k[hit]])
                        found.append(t.take(pa.array(hit)))
            return (np.concatenate(rows), pa.concat_tables(found)) if rows else (np.zeros(0, np.int64), None)

        return find


def without(docs: DataFrame, gone: DataFrame, work: Scratch, name: str = "gone") -> DataFrame:
    """docs, which has FILE and AT, without the rows at the places of gone, and without these columns. No
    row of docs is shuffled, unless only Spark can open the shared folder."""
    schema = docs.drop(FILE, AT).schema
    lookup = Lookup(gone.select(FILE, AT), work, name)
    if not lookup.files:
        return docs.drop(FILE, AT)
    if not lookup.direct:
        return docs.join(lookup.saved(docs.sparkSession).hint("merge"), [FILE, AT], "left_anti").drop(FILE, AT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup.reader()
        for b in batches:
            stays = np.ones(b.num_rows, bool)
            stays[find(b)[0]] = False
            yield b.select(schema.names).filter(pa.array(stays))

    return docs.mapInArrow(run, schema)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str) -> DataFrame:
    """rows joined with the one row of their group. Groups with over 1/HOT_SHARE of all rows (column `size`)
    are broadcast, fewer than HOT_SHARE of them, and the others are joined by a shuffle that no single
    group can fill. groups: a saved table."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot))
    others = rows.join(hot.select(on), on, "left_anti").join(groups.where(~is_hot), on)
    return rows.join(hot, on).unionByName(others)


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes together, at least one row each."""
    lo, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts as UTF-8) of the slices of an Arrow batch; null: empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int64)
    for lo, hi in slices(sizes):
        yield lo, hi, col.slice(lo, hi - lo).to_pylist()


class _Numbered(dict):
    """Gives every new key the next number and notes it."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class WordTable:
    """Features of words, computed once for each distinct word that a worker meets.
    features: list of words -> array with a row for each."""

    kept: ClassVar[list[WordTable]] = []  # in order of use, the last used at the end
    alone = False  # whether it serves without others

    def __init__(self, features: Callable[[list], np.ndarray], most: int = WORDS_KEPT, alone: bool = False) -> None:
        self.features, self.most, self.alone = features, most, alone
        self.clear()

    def _used(self) -> None:
        """Empties the tables that weren't used lately."""
        if not self.kept or self.kept[-1] is not self:
            self.kept[:] = [t for t in self.kept if t is not self] + [self]
            while len(self.kept) > (1 if self.alone else TABLES_KEPT):
                self.kept.pop(0).clear()

    def clear(self) -> None:
        self.index, self.rows = _Numbered(), None

    def ids(self, words: list) -> np.ndarray:
        """The words' numbers; self.rows[number] then holds the features."""
        self._used()
        if len(self.index) > self.most:
            self.clear()
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            new, old = self.features(self.index.fresh), len(self.index) - len(self.index.fresh)
            if self.rows is None or len(self.rows) < len(self.index):
                grown = np.zeros((max(1024, 2 * len(self.index)), *new.shape[1:]), new.dtype)
                if self.rows is not None:
                    grown[:old] = self.rows[:old]
                self.rows = grown
            self.rows[old : len(self.index)] = new
            self.index.fresh = []
        return ids

    def of(self, words: list) -> np.ndarray:
        """The features of each word."""
        ids = self.ids(words)
        return self.rows[ids]


def flat_words(texts: list, split: Callable[[object], list]) -> tuple[list, np.ndarray]:
    """All words of the texts and where each text's words start (one more entry than texts)."""
    parts = [split(t) for t in texts]
    return list(chain.from_iterable(parts)), np.cumsum([0, *map(len, parts)])


def segment_sum(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows[starts[i]:starts[i+1]]; zero where a segment is empty."""
    out = np.zeros((len(starts) - 1, *rows.shape[1:]), rows.dtype if rows.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(rows, starts[:-1][full], axis=0, dtype=out.dtype)
    return out


def sampled(rows: DataFrame, key: str | list[str], about: int, total: int) -> DataFrame:
    """About `about` of the rows (all, if there are no more), by a hash of their key."""
    if total <= about:
        return rows
    part = (about << 56) // total
    keys = [key] if isinstance(key, str) else key
    return rows.where(F.shiftrightunsigned(F.xxhash64(*keys, F.lit(20)), 8) < F.lit(part))


def gathered(rows: DataFrame, work: Scratch, name: str, most: int, most_bytes: int) -> list[Row]:
    """The distinct rows (doc_id, text, ...) on the driver. Where one id has very many rows, or the texts are long,
    only about `most` of them with about `most_bytes` of text, by a hash of id and text."""
    saved = work.save(rows.distinct(), name)
    n, size = saved.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, most / max(1, n), most_bytes / max(1, size))
    return sampled(saved, ["doc_id", "text"], int(share * n) if share < 1 else n, n).collect()


def held_out(key: str) -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0

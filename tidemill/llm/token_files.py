"""Token files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents (ascending doc_id) in blocks of 256. A block stores
its minimum, the differences packed at a width chosen among percentiles of their bit lengths (the
one with the fewest bytes), and an exception list of (position, high bits) for the others; an index
holds each block's start.

    magic "TMPF" | u32 version | u64 documents | u64 ids | u64 blocks | u64 bytes of an exception's high bits
    per document: i64 doc_id, u8 id present, then u64 ends (ids up to its end)
    per block: u32 minimum, u8 width, u16 exceptions, u64 start of its bytes
    blocks: packed differences, then exceptions as u8 positions and u16 or u32 high bits

Texts are encoded where they are scanned, and only ids travel, at the vocabulary's width. Documents are
range-partitioned by doc_id, so the concatenation of the files in the manifest's order is in ascending
order; rows that repeat a doc_id follow by their places in the table, null ids come first. A null or empty
text is the end id alone. A task that runs twice writes files under another name; only those that the
manifest lists are read. Empty table: empty manifest.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.base import AT, FILE, Scratch, located, text_slices, workers_ready

MAGIC, VERSION, BLOCK = b"TMPF", 1, 256
#: Percentiles of a block's bit lengths from which its width is chosen.
SHARES = (0.5, 0.75, 0.9, 0.95, 0.98, 1.0)
FILE_IDS = 4_000_000
END_ID = 2
#: Files that a task reads back where there are many.
FILES_READ = 16
MANIFEST = "part int, number int, path string, n_docs long, n_ids long"


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _packed(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values at w bits each, lowest bit first, as bytes."""
    if w in (8, 16):
        return np.ascontiguousarray(values.astype(f"<u{w // 8}")).view(np.uint8)
    bits = ((values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked(raw: np.ndarray, w: int) -> np.ndarray:
    if w in (8, 16):
        return np.ascontiguousarray(raw).view(f"<u{w // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), BLOCK, w)
    out = np.zeros((len(raw), BLOCK), np.uint32)
    for k in range(w):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def _by_width(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the same width, some at a time."""
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, max(1, len(at) // 512)):
            yield w, part


def _exception_places(width: np.ndarray, extra: np.ndarray, start: np.ndarray, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each exception of all blocks: its block, and where its position and its high bits lie."""
    extra = extra.astype(np.int64)
    block = np.repeat(np.arange(len(extra)), extra)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    base = (start.astype(np.int64) + width.astype(np.int64) * (BLOCK // 8))[block]
    return block, base + nth, base + extra[block] + high * nth


def encode_blocks(ids: np.ndarray, shares: tuple[float, ...] = SHARES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bytes]:
    """Minimum, width, number of exceptions and start of each block, bytes of high bits, and the blocks."""
    n = -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.int64).reshape(n, BLOCK)
    low = padded.min(axis=1)
    diff = (padded - low[:, None]).astype(np.uint32)
    high = 2 if not len(diff) or int(diff.max()) < 1 << 16 else 4
    bits = _bit_lengths(diff)
    ordered = np.sort(bits, axis=1)
    widths = ordered[:, [max(0, int(np.ceil(p * BLOCK)) - 1) for p in shares]].astype(np.int64)
    over = np.stack([(bits > widths[:, k, None]).sum(axis=1) for k in range(len(shares))], axis=1)
    sizes = widths * (BLOCK // 8) + (1 + high) * over
    best = sizes.argmin(axis=1)
    rows = np.arange(n)
    width, extra, sizes = widths[rows, best], over[rows, best], sizes[rows, best]
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for w, part in _by_width(width):
        packed = _packed(diff[part] & np.uint32((1 << w) - 1), w)
        out[start[part][:, None] + np.arange(packed.shape[1])] = packed
    block, where, upper = _exception_places(width, extra, start, high)
    odd_block, odd_at = np.nonzero(bits > width[:, None])
    out[where] = odd_at
    value = diff[odd_block, odd_at] >> width[odd_block].astype(np.uint32)
    for k in range(high):
        out[upper + k] = (value >> np.uint32(8 * k)) & np.uint32(255)
    return low.astype("<u4"), width.astype("u1"), extra.astype("<u2"), start.astype("<u8"), high, out.tobytes()


def decode_blocks(low: np.ndarray, width: np.ndarray, extra: np.ndarray, start: np.ndarray, high: int, data: np.ndarray) -> np.ndarray:
    """All ids of the blocks, with the last block's padding."""
    out = np.zeros((len(low), BLOCK), np.uint32)
    at = start.astype(np.int64)
    for w, part in _by_width(width):
        out[part] = _unpacked(data[at[part][:, None] + np.arange(w * (BLOCK // 8))], w)
    block, where, upper = _exception_places(width, extra, start, high)
    value = np.zeros(len(block), np.uint32)
    for k in range(high):
        value |= data[upper + k].astype(np.uint32) << np.uint32(8 * k)
    out[block, data[where]] |= value << width[block].astype(np.uint32)
    return (out + low.astype(np.uint32)[:, None]).ravel()


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    low, width, extra, start, high, data = encode_blocks(ids)
    head = MAGIC + struct.pack("<IQQQQ", VERSION, len(doc_ids), len(ids), len(low), high)
    known = np.array([d is not None for d in doc_ids], "u1")
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, numbers.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(), low.tobytes(), width.tobytes(), extra.tobytes(), start.tobytes(), data])


def parse_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ends and ids of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    version, n_docs, n_ids, n, high = struct.unpack_from("<IQQQQ", raw, 4)
    if version != VERSION:
        raise ValueError(f"token file of version {version}")
    at = 40
    parts = []
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n), ("u1", n), ("<u2", n), ("<u8", n)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    numbers, known, ends, low, width, extra, start = parts
    ids = decode_blocks(low, width, extra, start, high, np.frombuffer(raw, np.uint8, offset=at))[:n_ids]
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], ends.astype(np.int64), ids


def _order(column) -> Column:
    """The order of documents as a struct: null ids first."""
    return F.struct(column("doc_id").isNotNull().alias("known"), F.coalesce(column("doc_id"), F.lit(0)).alias("id"), column(FILE), column(AT))


def _encoder(tokenizer: str, end_id: int, lasts: list[tuple]):
    """lasts: the last place in the order of every partition but the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemill.llm.word_bpe import coder

        code = coder(tokenizer)
        kind = "<u2" if max(code.coder.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        for b in batches:
            for lo, hi, texts in text_slices(b):
                ids, bounds = code.encode(texts, end_id)
                data, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                packed = [data[size * x : size * y] for x, y in itertools.pairwise(bounds.tolist())]
                own = {c: b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("doc_id", FILE, AT)}
                part = [bisect.bisect_left(lasts, (d is not None, d or 0, f, a)) for d, f, a in zip(*(x.to_pylist() for x in own.values()), strict=True)]
                yield pa.record_batch({"part": pa.array(part, pa.int32()), **own, "width": pa.array([size] * (hi - lo), pa.int32()), "ids": pa.array(packed, pa.binary())})

    return run


def _writer(folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        docs: list[int | None] = []
        ends: list[int] = []
        number = width = 0

        def flush() -> pa.RecordBatch:
            path = f"{base}/part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.tmpf"
            with store.open_output_stream(path) as f:
                f.write(file_bytes(docs, np.array(ends), np.frombuffer(b"".join(held), f"<u{width}")))
            return pa.record_batch({"part": pa.array([task.partitionId()], pa.int32()), "number": pa.array([number], pa.int32()), "path": [path.removeprefix(base + "/")], "n_docs": pa.array([len(docs)], pa.int64()), "n_ids": pa.array([ends[-1]], pa.int64())})

        for b in batches:
            for doc, width, ids in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "width", "ids")), strict=True):
                held.append(ids)
                ends.append(len(ids) // width + (ends[-1] if ends else 0))
                docs.append(doc)
                if ends[-1] >= file_ids:
                    yield flush()
                    number += 1
                    held, docs, ends = [], [], []
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below `folder` (a URI that all executors reach) and a manifest table
    (part, number, path, n_docs, n_ids, base) as Parquet beside them; returns the manifest."""
    spark = docs.sparkSession
    workers_ready(spark)
    work = Scratch(spark, "encoded")
    read = located(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), work).select("doc_id", FILE, AT, "text")
    parts, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["doc_id", FILE, AT]
    # the bounds come from the ids alone, so that no text is encoded twice to sample them; a row for each partition
    dealt = read.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.max(_order(F.col)).alias("last")).orderBy("part").collect()
    lasts = [tuple(r["last"]) for r in dealt][:-1]
    encoded = read.mapInArrow(_encoder(tokenizer_path, end_id, lasts), f"part int, doc_id long, {FILE} long, {AT} long, width int, ids binary")
    ordered = encoded.repartitionById(max(1, len(dealt)), F.col("part")).sortWithinPartitions(*order).select("doc_id", "width", "ids")
    ordered.mapInArrow(_writer(f"{folder}/data", file_ids), MANIFEST).write.mode("overwrite").parquet(f"{folder}/written")
    written = spark.read.schema(MANIFEST).parquet(f"{folder}/written")
    # one row for each partition of the shuffle, not of the data
    bases, total = [], 0
    for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r["part"], total))
        total += r["n"]
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    manifest = written.join(F.broadcast(spark.createDataFrame(bases, "part int, first long")), "part").select("part", "number", "path", "n_docs", "n_ids", (F.col("first") + F.coalesce(before, F.lit(0))).alias("base"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{path}") as f:
                    docs, ends, ids = parse_file(f.read())
                data, starts = ids.astype("<u4").tobytes(), np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(first + starts, pa.int64()), "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = manifest.sparkSession
    workers_ready(spark)
    n = manifest.count()
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // FILES_READ)))
    # a stated number of tasks: by the manifest's few bytes all files would be read by one
    files = manifest.select("path", "base").repartition(tasks)
    return files.mapInArrow(_reader(f"{folder}/data"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes docs to token files and reads them back."""
    folder = folder or Scratch(docs.sparkSession, "tokens").folder
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)

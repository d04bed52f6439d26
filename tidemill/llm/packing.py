"""Packing of documents into sequences of at most 4096 tokens.

A scan tokenises; from there on only lengths travel. Pieces of a full sequence stand alone and aren't
shuffled (their sequences have negative numbers); what is left of each document goes to a group by a hash
of its place in the table, so that no id or text makes a group large, and each group is packed by
first-fit decreasing, the first bin with room found in a tournament tree of the bins' room.

A null or empty text is the end id alone. Repeated rows are packed as separate documents; ids may be
null or repeat. Empty table: empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import AT, FILE, Scratch, located, text_slices, workers_ready

ROOM, END_ID = 4096, 2
#: Documents of a group, about.
GROUP_DOCS = 2048


class TournamentTree:
    """Rooms of bins; each inner node holds the larger of its two, so the first bin with enough room
    is found from the root in as many steps as the tree is high."""

    def __init__(self, room: int) -> None:
        self.room, self.leaves, self.bins = room, 1, 0
        self.best = [0, room]

    def place(self, need: int) -> int:
        """Puts `need` into the first bin with room for it; the bin's number."""
        if self.best[1] < need:
            self._grow()
        i = 1
        while i < self.leaves:
            i = 2 * i if self.best[2 * i] >= need else 2 * i + 1
        at = i - self.leaves
        self.best[i] -= need
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])
        self.bins = max(self.bins, at + 1)
        return at

    def _grow(self) -> None:
        rooms = self.best[self.leaves :] + [self.room] * self.leaves
        self.leaves *= 2
        self.best = [0] * self.leaves + rooms
        for i in range(self.leaves - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])


def first_fit_decreasing(lengths: list[int], room: int = ROOM) -> list[int]:
    """The bin of each piece; ties keep the given order."""
    tree, out = TournamentTree(room), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        out[i] = tree.place(lengths[i])
    return out


def _pieces(path: str, room: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemill.llm.word_bpe import coder

        code = coder(path)
        for b in batches:
            row, start, length, crc, total = [], [], [], [], []
            for lo, _, texts in text_slices(b):
                ids, bounds = code.encode(texts, end_id)
                data, bounds = ids.astype("<u4").tobytes(), bounds.tolist()
                for k in range(len(texts)):
                    a, z = bounds[k], bounds[k + 1]
                    for s in range(a, z, room):
                        e = min(s + room, z)
                        row.append(lo + k)
                        start.append(s - a)
                        length.append(e - s)
                        crc.append(zlib.crc32(data[4 * s : 4 * e]))
                        total.append(z - a)
            at = pa.array(row, pa.int64())
            yield pa.record_batch({**{c: b.column(b.schema.get_field_index(c)).take(at) for c in ("doc_id", FILE, AT)}, "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())})

    return run


def _pack(room: int):
    def packed(rows: pa.Table) -> pa.RecordBatch:
        order = rows.sort_by([("length", "descending"), (FILE, "ascending"), (AT, "ascending")])
        lengths = order.column("length").to_pylist()
        bins = first_fit_decreasing(lengths, room)
        used, offsets = {}, []
        for bin_, n in zip(bins, lengths, strict=True):
            offsets.append(used.get(bin_, 0))
            used[bin_] = offsets[-1] + n
        group = order.column("part")[0].as_py()
        out = order.drop_columns(["part", FILE, AT]).append_column("sequence_id", pa.array([(group << 32) | x for x in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is packed when the next begins."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            parts = b.column(b.schema.get_field_index("part")).to_numpy()
            for at in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if not len(at):
                    continue
                piece = b.slice(int(at[0]), len(at))
                if held and held[0].column(held[0].schema.get_field_index("part"))[0].as_py() != int(parts[at[0]]):
                    yield packed(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, tokenizer_path: str, room: int = ROOM, end_id: int = END_ID, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    workers_ready(spark)
    work = Scratch(spark, "packing")
    read = located(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work).select("doc_id", FILE, AT, "text")
    id_type, numbers = dict(read.dtypes)["doc_id"], "start long, length long, ids_crc32 long, doc_tokens long"
    columns = f"doc_id {id_type}, {numbers}"
    pieces = work.save(read.mapInArrow(_pieces(tokenizer_path, room, end_id), f"doc_id {id_type}, {FILE} long, {AT} long, {numbers}"), "pieces")
    full, rest = F.col("length") == room, pieces.where(F.col("length") < room)
    groups = max(1, -(-rest.count() // group_docs))
    packed = rest.withColumn("part", F.pmod(F.xxhash64(FILE, AT), F.lit(groups))).repartition("part").sortWithinPartitions("part").mapInArrow(_pack(room), f"{columns}, sequence_id long, offset long")
    alone = pieces.where(full).drop(FILE, AT).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)

"""A replication transport kept in files: length-prefixed frames in segments, as a Spark data source.

`spark.readStream.format("tidemill_frames").option("path", folder)` yields rows of CHANGE_SCHEMA of
complete transactions only, from a folder that the driver and all executors can open. Offsets are
commit positions, so a transaction is never split. The driver notes where transactions stand, and each task
reads its own bytes of the log (option maxPartitionBytes). A commit writes the acknowledged position to
`ack`, after the batch is durable. The live network transport would implement the same reader around
Session and status_update().
"""

from __future__ import annotations

import bisect
import os
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemill.functions import lsn
from tidemill.sources.pgoutput import CHANGE_SCHEMA, ProtocolError, Session, Transaction, changelog_rows, decode

#: Bytes of the log that a task reads, about; a longer transaction is read by one task.
PARTITION_BYTES = 32 << 20


def write_segment(folder: str, name: str, frames: Sequence[bytes]) -> None:
    """Frames as one segment; appears whole."""
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f".{name}.part")
    with open(part, "wb") as f:
        f.writelines(struct.pack(">I", len(x)) + x for x in frames)
    os.replace(part, os.path.join(folder, f"{name}.frames"))


class Log:
    """Where the transactions of a folder's segments stand, from frame headers alone: the bodies of changes are
    passed over, and each segment is read once. Positions are bytes from the first segment's start. A transaction
    that comes again (after a reconnection) is known by its commit position, and passed over."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self._clear()

    def _clear(self) -> None:
        self.names: list[str] = []
        self.starts = [0]  # of the segments, and the end of the last
        self.ends: list[int] = []  # commit positions, ascending
        self.bounds = [0]  # where each transaction begins and the last one ends; what lies between belongs to the next
        self.relations: list[tuple[int, int, bytes]] = []  # position, relation, frame
        self.floor, self.is_open = 0, False

    def refresh(self) -> None:
        """Reads the segments that were added."""
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".frames"))
        if names[: len(self.names)] != self.names:
            self._clear()
        for name in names[len(self.names) :]:
            self._read(name)

    def _read(self, name: str) -> None:
        at, ends, bounds, relations, is_open = self.starts[-1], [], [], [], self.is_open
        last = self.ends[-1] if self.ends else self.floor
        with open(os.path.join(self.folder, name), "rb") as f:
            stop = at + os.fstat(f.fileno()).st_size
            while head := f.read(4):
                size = struct.unpack(">I", head.ljust(4, b"\0"))[0]
                if at + 4 + size > stop:
                    raise ProtocolError("malformed_frame", name, "cut")
                tag = f.read(min(1, size))
                if tag not in (b"B", b"C", b"R"):
                    f.seek(max(0, size - 1), os.SEEK_CUR)
                    at += 4 + size
                    continue
                frame = tag + f.read(size - 1)
                m = decode(frame)
                if m.kind == "unsupported":
                    raise ProtocolError("malformed_frame", m.tag, m.error)
                if m.kind == "relation":
                    relations.append((at, m.id, frame))
                elif (m.kind == "begin") == is_open:
                    raise ProtocolError(f"unexpected_{m.kind}")
                else:
                    is_open = m.kind == "begin"
                at += 4 + size
                if m.kind == "commit" and m.end_lsn > last:
                    last = m.end_lsn
                    ends.append(last)
                    bounds.append(at)
        self.names.append(name)
        self.starts.append(at)
        self.ends += ends
        self.bounds += bounds
        self.relations += relations
        self.is_open = is_open

    def forget(self, until: int) -> None:
        """Drops what isn't needed to read beyond a commit position."""
        k = bisect.bisect_right(self.ends, until)
        if k:
            self.floor = self.ends[k - 1]
            self.ends, self.bounds = self.ends[k:], self.bounds[k:]
            known = {oid: (at, oid, frame) for at, oid, frame in self.relations if at < self.bounds[0]}
            self.relations = sorted(known.values()) + [r for r in self.relations if r[0] >= self.bounds[0]]

    def after(self, position: int) -> list[int]:
        """Commit positions beyond this one."""
        return self.ends[bisect.bisect_right(self.ends, position) :]

    def spans(self, start: int, end: int, most: int) -> list[Span]:
        """Successive ranges of whole transactions with commit positions in (start, end], of about `most` bytes each
        (one transaction at least)."""
        if start < self.floor:
            self._clear()
        if start < end and (not self.ends or self.ends[-1] < end):
            self.refresh()
        out, lo, stop = [], bisect.bisect_right(self.ends, start), bisect.bisect_right(self.ends, end)
        while lo < stop:
            hi = min(stop, max(lo + 1, bisect.bisect_right(self.bounds, self.bounds[lo] + most) - 1))
            first, last = self.bounds[lo], self.bounds[hi]
            known = {oid: frame for at, oid, frame in self.relations if at < first}
            out.append(Span(max(start, self.ends[lo - 1] if lo else self.floor), self.ends[hi - 1], self._pieces(first, last), list(known.values())))
            lo = hi
        return out

    def _pieces(self, first: int, last: int) -> list[tuple[str, int, int]]:
        own = range(bisect.bisect_right(self.starts, first) - 1, bisect.bisect_left(self.starts, last))
        cut = [(self.names[k], max(first, self.starts[k]) - self.starts[k], min(last, self.starts[k + 1]) - self.starts[k]) for k in own]
        return [(os.path.join(self.folder, name), lo, hi) for name, lo, hi in cut if lo < hi]


class Span(InputPartition):
    """Bytes of segments that hold the transactions of (start, end], and the relations known before them."""

    def __init__(self, start: int, end: int, pieces: list[tuple[str, int, int]], relations: list[bytes]) -> None:
        self.start, self.end, self.pieces, self.relations = start, end, pieces, relations

    def frames(self) -> Iterator[bytes]:
        yield from self.relations
        for path, at, end in self.pieces:
            with open(path, "rb") as f:
                f.seek(at)
                while at < end:
                    size = struct.unpack(">I", f.read(4))[0]
                    yield f.read(size)
                    at += 4 + size

    def transactions(self, max_changes: int | None = None) -> Iterator[Transaction]:
        session, last = Session(max_changes), self.start
        for frame in self.frames():
            if (done := session.push(frame)) and last < done.end_lsn <= self.end:
                last = done.end_lsn
                yield done


class _Base:
    def __init__(self, options: dict[str, str]) -> None:
        self.log = Log(options["path"])
        self.max_changes = int(options["maxChanges"]) if "maxChanges" in options else None
        self.per_batch = int(options.get("maxTransactionsPerBatch", "0"))
        self.per_task = int(options.get("maxPartitionBytes", str(PARTITION_BYTES)))
        self.initial = lsn.parse(options.get("startLsn", "0/0"))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "log": None}  # tasks get what they need with their partition

    def split(self, start: int, end: int) -> list[InputPartition]:
        return self.log.spans(start, end, self.per_task) or [Span(start, end, [], [])]

    def read(self, partition: Span) -> Iterator[tuple]:
        from decimal import Decimal

        for t in partition.transactions(self.max_changes):
            for r in changelog_rows(t):
                yield (r[0], Decimal(r[1]), *r[2:])


class FramesReader(_Base, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.split(self.initial, (1 << 64) - 1)


class FramesStreamReader(_Base, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.folder, self.reached = options["path"], self.initial

    def initialOffset(self) -> dict:
        return {"lsn": lsn.to_text(self.initial)}

    def latestOffset(self) -> dict:
        """The last complete transaction, never behind what was acknowledged or handed out before."""
        self.log.refresh()
        self.reached = max(self.reached, self.acknowledged())
        ends = self.log.after(self.reached)
        self.reached = max([self.reached, *(ends[: self.per_batch] if self.per_batch else ends[-1:])])
        return {"lsn": lsn.to_text(self.reached)}

    def acknowledged(self) -> int:
        path = os.path.join(self.folder, "ack")
        if not os.path.exists(path):
            return 0
        with open(path) as f:
            return lsn.parse(f.read().strip())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.split(lsn.parse(start["lsn"]), lsn.parse(end["lsn"]))

    def commit(self, end: dict) -> None:
        if lsn.parse(end["lsn"]) > self.acknowledged():
            part = os.path.join(self.folder, ".ack.part")
            with open(part, "w") as f:
                f.write(end["lsn"])
            os.replace(part, os.path.join(self.folder, "ack"))
        self.log.forget(lsn.parse(end["lsn"]))


class FramesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_frames"

    def schema(self) -> str:
        return CHANGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FramesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FramesStreamReader(self.options)

"""Durable positions: checkpoints of each table, snapshot handoffs, and the store's own migrations."""

from __future__ import annotations

import datetime as dt
import sqlite3
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import lsn

V = TypeVar("V")


class MetaStore(Protocol):
    def fetch_checkpoint(self, key: str) -> str: ...
    def upsert_checkpoint(self, key: str, at: str) -> None: ...
    def fetch_start_lsn(self, keys: Iterable[str], default: str = "0/0") -> str: ...
    def fetch_handoff(self, source: str) -> dict[str, Any] | None: ...
    def mark_pending(self, source: str, boundary: str) -> None: ...
    def mark_complete(self, source: str, boundary: str) -> None: ...
    def clear_handoff(self, source: str) -> None: ...


MIGRATIONS: list[tuple[list[str], list[str]]] = [
    (
        ["CREATE TABLE IF NOT EXISTS checkpoints (checkpoint_key TEXT PRIMARY KEY, last_committed_lsn TEXT NOT NULL, updated_at TEXT NOT NULL)"],
        ["DROP TABLE IF EXISTS checkpoints"],
    ),
    (
        ["CREATE TABLE IF NOT EXISTS snapshot_handoffs (source_name TEXT PRIMARY KEY, state TEXT NOT NULL CHECK (state IN ('pending', 'complete')), boundary_lsn TEXT NOT NULL, started_at TEXT NOT NULL, completed_at TEXT, updated_at TEXT NOT NULL)"],
        ["DROP TABLE IF EXISTS snapshot_handoffs"],
    ),
]


def statements(script: str) -> list[str]:
    """Statements of an SQL script, without comments."""
    lines = [line.split("--", 1)[0] for line in script.splitlines()]
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


class SqliteMetaStore:
    """A MetaStore in one SQLite file on the driver. Positions only move forward."""

    def __init__(self, path: str) -> None:
        self.path = path

    @contextmanager
    def _db(self) -> Iterator[sqlite3.Connection]:
        db = sqlite3.connect(self.path, timeout=30)
        try:
            with db:
                yield db
        finally:
            db.close()

    def bootstrap(self) -> SqliteMetaStore:
        self.migrate_up()
        return self

    def version(self) -> int:
        with self._db() as db:
            db.execute("CREATE TABLE IF NOT EXISTS migration_versions (one INTEGER PRIMARY KEY CHECK (one = 1), version INTEGER NOT NULL)")
            row = db.execute("SELECT version FROM migration_versions").fetchone()
            return row[0] if row else 0

    def migrate_up(self, to: int | None = None) -> int:
        return self._migrate(len(MIGRATIONS) if to is None else to)

    def migrate_down(self, to: int = 0) -> int:
        return self._migrate(to)

    def _migrate(self, to: int) -> int:
        if not 0 <= to <= len(MIGRATIONS):
            raise ValueError(f"no version {to}")
        at = self.version()
        with self._db() as db:
            while at != to:
                for s in MIGRATIONS[at][0] if at < to else MIGRATIONS[at - 1][1]:
                    db.execute(s)
                at += 1 if at < to else -1
            db.execute("INSERT INTO migration_versions VALUES (1, ?) ON CONFLICT (one) DO UPDATE SET version = excluded.version", (at,))
        return at

    def fetch_checkpoint(self, key: str) -> str:
        with self._db() as db:
            row = db.execute("SELECT last_committed_lsn FROM checkpoints WHERE checkpoint_key = ?", (key,)).fetchone()
        return row[0] if row else "0/0"

    def upsert_checkpoint(self, key: str, at: str) -> None:
        lsn.parse(at)
        with self._db() as db:
            db.execute("BEGIN IMMEDIATE")
            row = db.execute("SELECT last_committed_lsn FROM checkpoints WHERE checkpoint_key = ?", (key,)).fetchone()
            furthest = lsn.latest(row[0] if row else None, at)
            db.execute("INSERT INTO checkpoints VALUES (?, ?, ?) ON CONFLICT (checkpoint_key) DO UPDATE SET last_committed_lsn = excluded.last_committed_lsn, updated_at = excluded.updated_at", (key, furthest, _now()))

    def fetch_start_lsn(self, keys: Iterable[str], default: str = "0/0") -> str:
        """The smallest checkpoint, or the default if any key has none."""
        keys = list(dict.fromkeys(keys))
        with self._db() as db:
            found = [r[0] for r in db.execute(f"SELECT last_committed_lsn FROM checkpoints WHERE checkpoint_key IN ({','.join('?' * len(keys))})", keys)]
        if not keys or len(found) < len(keys):
            return default
        return min(found, key=lsn.parse)

    def fetch_handoff(self, source: str) -> dict[str, Any] | None:
        names = ("source_name", "state", "boundary_lsn", "started_at", "completed_at", "updated_at")
        with self._db() as db:
            row = db.execute(f"SELECT {', '.join(names)} FROM snapshot_handoffs WHERE source_name = ?", (source,)).fetchone()
        return dict(zip(names, row, strict=True)) if row else None

    def mark_pending(self, source: str, boundary: str) -> None:
        self._mark(source, "pending", boundary)

    def mark_complete(self, source: str, boundary: str) -> None:
        self._mark(source, "complete", boundary)

    def _mark(self, source: str, state: str, boundary: str) -> None:
        lsn.parse(boundary)
        now = _now()
        with self._db() as db:
            db.execute("INSERT INTO snapshot_handoffs VALUES (?, ?, ?, ?, ?, ?) ON CONFLICT (source_name) DO UPDATE SET state = excluded.state, boundary_lsn = excluded.boundary_lsn, completed_at = excluded.completed_at, updated_at = excluded.updated_at", (source, state, boundary, now, now if state == "complete" else None, now))

    def clear_handoff(self, source: str) -> None:
        with self._db() as db:
            db.execute("DELETE FROM snapshot_handoffs WHERE source_name = ?", (source,))


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat()


def with_retries(action: Callable[[], V], retries: int = 2, delay_s: float = 0.0, sleep: Callable[[float], None] | None = None) -> V:
    """The action's result; the last error once it has failed retries + 1 times."""
    for left in range(retries, -1, -1):
        try:
            return action()
        except Exception:
            if not left:
                raise
            if delay_s and sleep:
                sleep(delay_s)
    raise AssertionError


def start_lsn(checkpoints: DataFrame, keys: DataFrame, default: str = "0/0") -> DataFrame:
    """fetch_start_lsn as a plan: one row (start_lsn) over checkpoint_key, last_committed_lsn tables."""
    found = keys.select("checkpoint_key").distinct().join(checkpoints, "checkpoint_key", "left")
    at = lsn.lsn_from_text(F.col("last_committed_lsn"))
    some = found.agg(F.min(at).alias("m"), F.count(F.lit(1)).alias("n"), F.count("last_committed_lsn").alias("k"))
    return some.select(F.when((F.col("n") > F.col("k")) | (F.col("n") == 0), F.lit(default)).otherwise(lsn.lsn_to_text(F.col("m"))).alias("start_lsn"))

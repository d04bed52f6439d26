"""Preparing a Postgres source: replica identity, publication, slot. Driver-side and small; every
function takes `run(sql, params) -> rows`, so any client library serves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from tidemill.functions import lsn
from tidemill.plans.specs import TableSpec

Run = Callable[[str, Sequence[Any]], list[tuple]]
PLUGIN = "pgoutput"
DUPLICATE_OBJECT = "42710"


class SetupError(RuntimeError):
    def __init__(self, reason: str, *detail: Any) -> None:
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail = reason, detail


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables_sql(specs: Iterable[TableSpec]) -> str:
    """Each source table once, in order."""
    return ", ".join(dict.fromkeys(f"{identifier(s.source_schema)}.{identifier(s.source_table)}" for s in specs))


def full_identity(run: Run, specs: Iterable[TableSpec]) -> None:
    """Old rows must come whole: every table needs REPLICA IDENTITY FULL."""
    for schema, table in dict.fromkeys(s.source for s in specs):
        rows = run("SELECT c.relreplident FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = $1 AND c.relname = $2", [schema, table])
        if not rows:
            raise SetupError("unknown_table", schema, table)
        if rows[0][0] != "f":
            raise SetupError("replica_identity_not_full", schema, table)


def has_publication(run: Run, name: str) -> bool:
    return bool(run("SELECT 1 FROM pg_publication WHERE pubname = $1", [name]))


def ensure_publication(run: Run, name: str, specs: Sequence[TableSpec]) -> str:
    """`created` or `exists`; another session that creates it meanwhile is no error."""
    if has_publication(run, name):
        return "exists"
    return _once(run, f"CREATE PUBLICATION {identifier(name)} FOR TABLE {tables_sql(specs)}", [])


def slot(run: Run, name: str) -> dict[str, Any] | None:
    rows = run("SELECT plugin, slot_type, confirmed_flush_lsn::text FROM pg_replication_slots WHERE slot_name = $1", [name])
    return dict(zip(("plugin", "type", "confirmed_lsn"), rows[0], strict=True)) if rows else None


def ensure_slot(run: Run, name: str) -> tuple[str, str | None]:
    """(created, its start) or (exists, None); a slot of another kind is an error."""
    found = slot(run, name)
    if found is None:
        made: list[tuple] = []
        if _once(lambda q, p: made.extend(run(q, p)) or made, "SELECT slot_name, lsn::text FROM pg_create_logical_replication_slot($1, $2)", [name, PLUGIN]) == "created":
            return "created", made[0][1] if made else None
        found = slot(run, name) or {}
    if (found.get("plugin"), found.get("type")) != (PLUGIN, "logical"):
        raise SetupError("slot_mismatch", name, found)
    return "exists", None


def drop_slot(run: Run, name: str) -> bool:
    if slot(run, name) is None:
        return False
    run("SELECT pg_drop_replication_slot($1)", [name])
    return True


def current_lsn(run: Run) -> str:
    at = run("SELECT pg_current_wal_lsn()::text", [])[0][0]
    lsn.parse(at)
    return at


def _once(run: Run, sql: str, params: Sequence[Any]) -> str:
    try:
        run(sql, params)
    except Exception as e:
        if DUPLICATE_OBJECT not in (getattr(e, "sqlstate", None), getattr(e, "pgcode", None)):
            raise
        return "exists"
    return "created"


@dataclass(frozen=True)
class Prepared:
    publication: str
    slot: str
    start_lsn: str | None  # of a new slot; an existing one starts where its checkpoints say


def prepare(run: Run, specs: Sequence[TableSpec], publication: str, slot_name: str) -> Prepared:
    """Identity check, then publication, then slot."""
    full_identity(run, specs)
    made = ensure_publication(run, publication, specs)
    state, start = ensure_slot(run, slot_name)
    return Prepared(made, state, (start or current_lsn(run)) if state == "created" else None)


def begin_snapshot(run: Run) -> tuple[str, str]:
    """A read-only repeatable-read transaction: (exported snapshot, boundary)."""
    run("BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY", [])
    return run("SELECT pg_export_snapshot()", [])[0][0], current_lsn(run)


def end_snapshot(run: Run, ok: bool = True) -> None:
    run("COMMIT" if ok else "ROLLBACK", [])


class Source:
    """A database to mirror: what a start prepares there, and the transaction of its snapshot."""

    def __init__(self, run: Run, publication: str, slot_name: str) -> None:
        self.run, self.publication, self.slot_name = run, publication, slot_name
        self.exported: str | None = None  # the snapshot that readers of the tables import

    def prepare(self, specs: Sequence[TableSpec]) -> Prepared:
        return prepare(self.run, specs, self.publication, self.slot_name)

    def begin_snapshot(self) -> str:
        """The boundary."""
        self.exported, boundary = begin_snapshot(self.run)
        return boundary

    def end_snapshot(self, ok: bool) -> None:
        if self.exported is not None:
            self.exported = None
            end_snapshot(self.run, ok)

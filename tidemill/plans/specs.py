"""Configuration: which source table mirrors into which target, and how a stream runs."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any
from urllib.parse import parse_qs, quote, unquote, urlsplit

from pyspark.sql import types as T

MODES = ("cdc_changelog",)
SPEC_KEYS = ("source_schema", "source_table", "target_schema", "target_table", "mode", "primary_keys", "checkpoint_key")


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class TableSpec:
    source_schema: str
    source_table: str
    target_schema: str
    target_table: str
    mode: str = "cdc_changelog"
    primary_keys: tuple[str, ...] = ()
    checkpoint_key: str = ""

    @staticmethod
    def from_dict(raw: Mapping[str, Any], prefix: str | None = None) -> TableSpec:
        given = {str(k): v for k, v in raw.items()}
        if unknown := set(given) - set(SPEC_KEYS):
            raise ConfigError(f"unknown keys: {sorted(unknown)}")
        if missing := [k for k in SPEC_KEYS[:4] if not given.get(k)]:
            raise ConfigError(f"missing keys: {missing}")
        if given.get("mode", MODES[0]) not in MODES:
            raise ConfigError(f"unsupported mode: {given['mode']}")
        keys = tuple(dict.fromkeys(str(k) for k in given.get("primary_keys") or ()))
        spec = TableSpec(*(str(given[k]) for k in SPEC_KEYS[:4]), mode=MODES[0], primary_keys=keys, checkpoint_key=given.get("checkpoint_key") or "")
        return spec if spec.checkpoint_key else replace(spec, checkpoint_key=checkpoint_key(spec.source, prefix))

    @property
    def source(self) -> tuple[str, str]:
        return self.source_schema, self.source_table

    @property
    def target(self) -> tuple[str, str]:
        return self.target_schema, self.target_table

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def checkpoint_key(relation: tuple[str, str], prefix: str | None = None) -> str:
    name = ".".join(relation)
    return f"{prefix}:{name}" if prefix else name


def specs_by_target(specs: Iterable[TableSpec]) -> dict[tuple[str, str], TableSpec]:
    return {s.target: s for s in specs}


def specs_by_source(specs: Iterable[TableSpec]) -> dict[tuple[str, str], TableSpec]:
    """The last mapping of a source wins."""
    return {s.source: s for s in specs}


def select_tables(available: Mapping[str, Mapping[str, Any]], selection: Iterable[Any], target_schema: str = "raw", source_schema: str = "public", prefix: str | None = None) -> list[TableSpec]:
    """Specs of a selection over known tables: a name; (target, source) names; or a mapping with
    `table` and any keys to change."""
    out = []
    for item in selection:
        change: dict[str, Any] = {}
        if isinstance(item, str):
            source, target = item, item
        elif isinstance(item, Mapping):
            change = {str(k): v for k, v in item.items()}
            source = change.pop("table", None) or change.get("source_table")
            target = change.get("target_table", source)
        else:
            target, source = item
        if source not in available:
            raise ConfigError(f"unknown table: {source}")
        base = {"source_schema": source_schema, "target_schema": target_schema, "source_table": source, "target_table": target}
        out.append(TableSpec.from_dict(base | dict(available[source]) | change | {"source_table": source, "target_table": target}, prefix))
    return out


def infer_spec(name: str, schema: T.StructType, primary_keys: Iterable[str] = (), enabled: bool = True, source_schema: str = "public", target_schema: str = "raw", prefix: str | None = None) -> TableSpec | None:
    """A spec from a table's schema; `schema.table` names carry their own source schema; None if not enabled."""
    if not enabled:
        return None
    keys = tuple(primary_keys) or tuple(f.name for f in schema if f.metadata.get("primary_key"))
    if lost := [k for k in keys if k not in schema.names]:
        raise ConfigError(f"keys without a column: {lost}")
    own, _, table = name.rpartition(".")
    return TableSpec.from_dict({"source_schema": own or source_schema, "source_table": table, "target_schema": target_schema, "target_table": table, "primary_keys": keys}, prefix)


@dataclass(frozen=True)
class IngestConfig:
    max_rows: int = 10_000
    max_bytes: int = 128 << 20
    flush_interval_ms: int = 5_000
    max_inflight: int = 1
    max_pending: int = 1_000
    overflow: str = "fail"

    def __post_init__(self) -> None:
        for name in ("max_rows", "max_bytes", "flush_interval_ms", "max_inflight"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ConfigError(f"{name} must be a positive whole number")
        if self.max_pending < 0 or self.overflow not in ("fail", "drop_oldest"):
            raise ConfigError("max_pending must be 0 or more, overflow fail or drop_oldest")


@dataclass(frozen=True)
class StreamConfig:
    source_name: str
    root: str
    meta_path: str
    tables: tuple[TableSpec, ...]
    ingest: IngestConfig = field(default_factory=IngestConfig)
    snapshot_before_stream: bool = True
    snapshot_on_restart: bool = False
    resume_incomplete_snapshot: bool = True
    default_start_lsn: str = "0/0"
    max_lag_bytes: int | None = None
    checkpoint_location: str | None = None
    catalog: str | None = None
    #: SQL that each start runs first, such as settings and views.
    setup_sql: tuple[str, ...] = ()
    #: Of a new keyed table; about its final size by 256 MB, as a batch rewrites whole buckets.
    buckets: int = 16

    def __post_init__(self) -> None:
        if self.buckets < 1:
            raise ConfigError("buckets must be a positive whole number")

    @staticmethod
    def from_dict(raw: Mapping[str, Any]) -> StreamConfig:
        given = {str(k): v for k, v in raw.items()}
        known = set(StreamConfig.__dataclass_fields__)
        if unknown := set(given) - known:
            raise ConfigError(f"unknown keys: {sorted(unknown)}")
        if missing := [k for k in ("source_name", "root", "meta_path", "tables") if not given.get(k)]:
            raise ConfigError(f"missing keys: {missing}")
        tables = tuple(t if isinstance(t, TableSpec) else TableSpec.from_dict(t, given["source_name"]) for t in given["tables"])
        ingest = given.get("ingest") or {}
        sql = given.get("setup_sql") or ()
        return StreamConfig(**(given | {"setup_sql": (sql,) if isinstance(sql, str) else tuple(sql), "tables": tables, "ingest": ingest if isinstance(ingest, IngestConfig) else IngestConfig(**ingest)}))


@dataclass(frozen=True)
class ConnectionOptions:
    host: str = "localhost"
    port: int = 5432
    database: str = ""
    username: str | None = None
    password: str | None = None
    ssl: bool = False


def parse_url(url: str, **override: Any) -> ConnectionOptions:
    """Connection options of a postgres:// or postgresql:// URL; a few may be overridden."""
    parts = urlsplit(url)
    if parts.scheme not in ("postgres", "postgresql"):
        raise ConfigError(f"unsupported scheme: {parts.scheme!r}")
    if not parts.hostname or not parts.path.strip("/"):
        raise ConfigError("the URL needs a host and a database")
    if unknown := set(override) - set(ConnectionOptions.__dataclass_fields__):
        raise ConfigError(f"unknown options: {sorted(unknown)}")
    mode = parse_qs(parts.query).get("sslmode", ["disable"])[0]
    if mode not in ("disable", "allow", "prefer", "require", "verify-ca", "verify-full"):
        raise ConfigError(f"unknown sslmode: {mode}")
    decoded = lambda x: unquote(x) if x is not None else None
    found = {"host": parts.hostname, "port": parts.port or 5432, "database": unquote(parts.path.strip("/")), "username": decoded(parts.username), "password": decoded(parts.password), "ssl": mode in ("require", "verify-ca", "verify-full")}
    return ConnectionOptions(**(found | override))


def build_url(username: str | None = None, password: str | None = None, hostname: str = "localhost", port: int = 5432, database: str = "", url: str | None = None, ssl: bool = False) -> str:
    """A postgres:// URL from a connection's settings; an ecto:// one is rewritten."""
    if url:
        return re.sub(r"^ecto://", "postgres://", url)
    user = "" if not username else quote(username, safe="") + (f":{quote(password, safe='')}" if password else "") + "@"
    return f"postgres://{user}{hostname}:{port}/{quote(database, safe='')}" + ("?sslmode=require" if ssl else "")


def truthy(value: Any) -> bool:
    return value in (True, "true", "1", 1, "yes", "on")


def reconnect_backoff(base_ms: int, low_ms: int = 100, high_ms: int = 60_000, jitter: float = 0.0, draw=random.random) -> int:
    """A wait within [low, high], moved by up to the jitter's share of it in either direction."""
    clamp = lambda x: max(low_ms, min(high_ms, x))
    wait = clamp(base_ms)
    return int(clamp(wait + wait * jitter * (2 * draw() - 1)))

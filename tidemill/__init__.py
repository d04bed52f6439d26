"""Change-data-capture and event ingestion on Spark: mirrored tables, append streams, snapshots.

The names below are the public interface; they are imported when first used."""

from __future__ import annotations

import importlib

_WHERE = {
    "tidemill.functions.lsn": ("parse", "to_text", "lsn_from_text", "lsn_to_text", "lag_bytes"),
    "tidemill.functions.types": ("infer_columns", "schema_of", "cast_column"),
    "tidemill.operators.apply": ("append_rows", "append_records", "apply_changes", "apply_snapshot", "mirrored"),
    "tidemill.operators.changelog": ("route", "collapse", "assemble", "ChangeError"),
    "tidemill.operators.store": ("VersionedTable", "Manifest", "CommitConflict", "register_views"),
    "tidemill.plans.specs": ("TableSpec", "StreamConfig", "IngestConfig", "ConfigError", "select_tables", "infer_spec", "parse_url"),
    "tidemill.sources.pgoutput": ("decode", "Session", "Converter", "TransactionBuffer", "CHANGE_SCHEMA", "decode_frames"),
    "tidemill.sources.frames": ("FramesDataSource", "write_segment"),
    "tidemill.sources.snapshot": ("plan_snapshot", "run_snapshot", "tag", "scan"),
    "tidemill.streaming.meta": ("MetaStore", "SqliteMetaStore"),
    "tidemill.streaming.runtime": ("start_stream", "seed_and_start", "process_batch", "StreamHandle", "AppendStream", "Manager"),
    "tidemill.streaming.telemetry": ("Forwarder", "ProgressListener", "EVENTS"),
}
_HOME = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(_HOME[name]), name)

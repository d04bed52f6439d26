import pytest

from tidemill.plans.specs import TableSpec
from tidemill.sources import setup as su

SPEC = TableSpec.from_dict({"source_schema": "public", "source_table": 'u"s', "target_schema": "raw", "target_table": "u", "primary_keys": ["id"]})


class Fake:
    """Answers by the first words of the SQL that fit."""

    def __init__(self, **answers):
        self.answers, self.seen = answers, []

    def __call__(self, sql, params):
        self.seen.append(sql)
        for key, a in self.answers.items():
            if key in sql:
                if isinstance(a, Exception):
                    raise a
                return a.pop(0) if a and isinstance(a[0], list) else a
        return []


class Duplicate(Exception):
    sqlstate = "42710"


def test_prepare_creates_everything():
    run = Fake(relreplident=[("f",)], pg_create_logical=[("s", "0/16B")])
    assert su.prepare(run, [SPEC, SPEC], "p", "s") == su.Prepared("created", "created", "0/16B")
    assert 'CREATE PUBLICATION "p" FOR TABLE "public"."u""s"' in run.seen


def test_what_exists_is_kept():
    run = Fake(relreplident=[("f",)], pg_publication=[(1,)], pg_replication_slots=[("pgoutput", "logical", "0/1")])
    assert su.prepare(run, [SPEC], "p", "s") == su.Prepared("exists", "exists", None)
    assert su.drop_slot(run, "s") and not su.drop_slot(Fake(), "s")


def test_races_and_errors():
    assert su.ensure_publication(Fake(CREATE=Duplicate()), "p", [SPEC]) == "exists"
    with pytest.raises(RuntimeError):
        su.ensure_publication(Fake(CREATE=RuntimeError("no")), "p", [SPEC])
    raced = Fake(pg_create_logical=Duplicate(), pg_replication_slots=[[], [("pgoutput", "logical", None)]])
    assert su.ensure_slot(raced, "s") == ("exists", None)
    with pytest.raises(su.SetupError, match="slot_mismatch"):
        su.ensure_slot(Fake(pg_replication_slots=[("test", "logical", None)]), "s")
    with pytest.raises(su.SetupError, match="not_full"):
        su.full_identity(Fake(relreplident=[("d",)]), [SPEC])
    with pytest.raises(su.SetupError, match="unknown_table"):
        su.full_identity(Fake(), [SPEC])


def test_snapshot_transaction():
    run = Fake(pg_export_snapshot=[("snap",)], pg_current_wal_lsn=[("0/10",)])
    assert su.begin_snapshot(run) == ("snap", "0/10") and "REPEATABLE READ READ ONLY" in run.seen[0]
    su.end_snapshot(run, ok=False)
    assert run.seen[-1] == "ROLLBACK"

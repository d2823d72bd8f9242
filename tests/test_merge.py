"""The kept conversation table: repeated epochs, crashes, project filter, force and failed deliveries."""

import pytest

from supportkb.sources import versions
from supportkb.streaming.merge import ConversationTable

ROWS = "id string, update_time string, payload string, ord long"


def _frame(spark, rows, kind=ROWS):
    return spark.createDataFrame(rows, kind)


def _held(table):
    return {r.id: (r.update_time, r.payload) for r in table.read().collect()}


def test_epochs_crashes_and_counts(spark, tmp_path, monkeypatch):
    schema = _frame(spark, []).schema
    table = ConversationTable(spark, str(tmp_path / "t"), schema, buckets=3)
    assert table.read().count() == 0
    first = _frame(spark, [("a", "v1", "A1", 0), ("a", "v1", "A1 again", 1), ("b", "v1", "B1", 2), ("c", "v1", None, 3), ("a", "v2", "A2", 4)])
    table.merge(first, 0)
    assert _held(table) == {"a": ("v2", "A2"), "b": ("v1", "B1")}
    assert table.counts() == {"imported": 3, "skipped": 1, "failed": 1}
    table.merge(_frame(spark, [("b", "v9", "never seen", 0)]), 0)              # the epoch has been committed
    assert _held(table)["b"] == ("v1", "B1") and table.counts()["imported"] == 3
    second = _frame(spark, [("a", "v1", "A3", 5), ("b", "v1", "B2", 6), ("d", "v1", "D1", 7)])
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(second, 1)
    assert _held(table) == {"a": ("v2", "A2"), "b": ("v1", "B1")}              # written, but no version names it
    table.merge(second, 1)
    assert _held(table) == {"a": ("v1", "A3"), "b": ("v1", "B1"), "d": ("v1", "D1")}
    assert table.counts() == {"imported": 5, "skipped": 2, "failed": 1}
    again = ConversationTable(spark, str(tmp_path / "t"), schema, buckets=3)    # a new driver reads the same state
    again.merge(_frame(spark, []), 2)
    assert _held(again) == _held(table) and again.counts()["skipped"] == 2


def test_project_and_force(spark, tmp_path):
    kind = ROWS + ", folder string, title string"
    rows = _frame(spark, [("a", "v1", "A", 0, "Work/x", "t"), ("b", "v1", "B", 1, "", "about Work"), ("c", "v1", "C", 2, "Home", "t"), ("d", "v1", None, 3, None, None)], kind)
    table = ConversationTable(spark, str(tmp_path / "t"), _frame(spark, []).schema, project="Work")
    table.merge(rows, 0)
    assert set(_held(table)) == {"a", "b"} and table.counts() == {"imported": 2, "skipped": 0, "failed": 0}
    forced = ConversationTable(spark, str(tmp_path / "t"), _frame(spark, []).schema, force=True)
    forced.merge(rows.selectExpr("id", "update_time", "payload || '2' AS payload", "ord"), 1)
    assert _held(forced)["a"] == ("v1", "A2") and forced.counts() == {"imported": 5, "skipped": 0, "failed": 1}

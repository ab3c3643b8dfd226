import os

from notegrain import queries


def test_notes_and_shuffle_files_go_once_features_are_written(spark, monkeypatch):
    texts, tables, calls = ["a", "b", "c"], [], []
    df = spark.sql("SELECT 1L AS song, 0 AS dim, 1e0 AS x")
    keep = queries.written
    monkeypatch.setattr(queries, "bound", lambda op, bindings: (lambda *_: df, ""))
    monkeypatch.setattr(queries, "written", lambda d, label: tables.append((label, keep(d, label))) or tables[-1][1])
    monkeypatch.setattr(queries, "released", lambda s: calls.append(s), raising=False)
    monkeypatch.setattr(queries.whole, "FEATURES", texts)
    monkeypatch.setattr(queries, "_KEPT", {})
    assert queries._features(spark, "nowhere").count() == 3 and len(calls) == 3
    there = {label: os.path.exists(t._written_at.removeprefix("file://")) for label, t in tables}
    assert there == {"notes": False, "features": True}

import pytest

from notegrain.sources import smf


def test_round_trip_settings_and_overlaps():
    notes = [(0, 480, 0, 60, 90), (0, 240, 9, 36, 100), (240, 10, 9, 38, 1), (480, 481, 0, 64, 80), (100_000, 3, 15, 127, 127)]
    tpb, got, tempos, meters = smf.decode(smf.encode(480, notes, [(0, 120.0), (960, 93.75)], [(0, 7, 8)]))
    assert (tpb, got, meters) == (480, sorted(notes), [(0, 7, 8)])
    assert [t for t, _ in tempos] == [0, 960] and [b for _, b in tempos] == pytest.approx([120.0, 93.75])


def test_running_status_velocity_zero_and_open_notes():
    body = bytes([0, 0x90, 60, 64, 96, 60, 0, 0, 62, 64, 10, 0xFF, 0x2F, 0])
    data = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk" + len(body).to_bytes(4, "big") + body
    assert smf.decode(data)[1] == [(0, 96, 0, 60, 64), (96, 10, 0, 62, 64)]


def test_bad_files_become_error_rows(spark, tmp_path):
    good = smf.encode(96, [(0, 10, 0, 60, 64)])
    for name, data in (("a", good), ("b", good[:20]), ("c", b""), ("d", b"RIFF....")):
        (tmp_path / f"{name}.mid").write_bytes(data)
    files = smf.scan(spark, str(tmp_path))
    rows = smf.events_of(files).collect()
    assert sorted(r.kind for r in rows) == ["error", "error", "note"]  # the scan leaves out the file without bytes
    note = next(r for r in rows if r.kind == "note")
    assert (note.start, note.dur, note.pitch, note.tpb) == (0, 10, 60, 96)
    assert smf.events_of(spark.createDataFrame([("x", None)], "md5 string, content binary")).first().kind == "error"

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans.cli import main
from tessera.sources import midi, midi_sink


def tracks(name, shift=0):
    return [{"name": name, "notes": [(60 + shift, 90, 0.0, 0.5), (64, 80, 0.5, 1.25)]}, {"name": "Drums", "channel": 9, "notes": [(36, 100, 0.0, 0.25)]}, {"name": "é Lead", "channel": 3, "program": 5, "notes": [(70, 70, 1.0, 2.0)]}]


def test_notes_come_back(spark, tmp_path):
    """Notes written by tasks and read again, at any tempo; tracks, programs, drums and names stay."""
    (tmp_path / "in").mkdir()
    for k in range(7):
        (tmp_path / "in" / f"{k}.mid").write_bytes(midi.written(tracks("Piano", k)))
    (tmp_path / "in" / "bad.mid").write_bytes(b"MThd")
    read = midi.files(spark, str(tmp_path / "in"), errors="drop")
    rows = read.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "notes")
    for tempo in (120.0, 90.0):
        out = tmp_path / f"out{tempo:.0f}"
        midi_sink.write_files(midi_sink.encoded(rows.repartition(3), tempo), str(out / "deep"))
        again = {r.path.rsplit("/", 1)[1]: r for r in midi.files(spark, str(out / "deep")).collect()}
        assert len(again) == 7 and not [p for p in (out / "deep").iterdir() if p.is_dir()]
        for r in rows.collect():
            plain = lambda notes: [(n.track_idx, n.name, n.program, n.is_drum, n.pitch, n.velocity, round(n.t0, 2), round(n.t1, 2)) for n in notes]
            assert [x[1:] for x in plain(again[r.name].notes)] == [x[1:] for x in plain(r.notes)]


def test_refused_names_and_failures_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a.mid", b"1"), ("b/a.mid", b"2"), ("c.mid", None)], "name string, content binary")
    midi_sink.write_files(df, str(tmp_path / "o"))
    assert (tmp_path / "o" / "b" / "a.mid").read_bytes() == b"2" and (tmp_path / "o" / "c.mid").read_bytes() == b""
    for name in ("a.mid", "../x", "/x", None):
        with pytest.raises(ValueError):
            midi_sink.write_files(df.unionByName(spark.createDataFrame([(name, b"3")], df.schema)), str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()
    failing = df.withColumn("content", F.when(F.col("name") == "c.mid", F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("content"))).repartition(3)
    writer = midi_sink.FileWriter(str(tmp_path / "q"))
    writer.write(iter(df.limit(2).collect()))
    writer.abort([None])
    assert not list((tmp_path / "q").rglob("*.mid"))
    with pytest.raises(Exception, match="no"):
        spark.dataSource.register(midi_sink.Files)
        failing.write.format("files").mode("append").save(str(tmp_path / "r"))
    assert not list((tmp_path / "r").rglob("*.mid"))


def test_renamed_tracks(spark, tmp_path):
    """Only names change: all other bytes stay, with running status and names of other lengths; a dry run lists them."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    raw = bytearray(midi.written(tracks("Piano")))
    for name, data in (("x.mid", bytes(raw)), ("sub/y.mid", midi.written(tracks("electric PIANO 2"))), ("z.mid", midi.written(tracks("Bass"))), ("bad.mid", b"MThd\0\0")):
        (tmp_path / "in" / name).write_bytes(data)
    new, changed = midi_sink.retitled(bytes(raw), " piano ", "A much longer name than before " * 5)
    assert changed == ["Piano"] and midi_sink.retitled(new, ("A much longer name than before " * 5).strip(), "Piano")[0] == bytes(raw)
    running = b"MThd\0\0\0\6\0\0\0\1\1\xe0MTrk\0\0\0\x1a" + b"\0\xff\x03\1a" + b"\0\x90\x3c\x40" + b"\x10\x3c\0" + b"\0\x3e\x40\x10\x3e\0" + b"\0\xff\x2f\0"
    body = running[22:]
    running = running[:18] + len(body).to_bytes(4, "big") + body
    again, changed = midi_sink.retitled(running, "a", "bcd")
    assert changed == ["a"] and again == running[:18] + (len(body) + 2).to_bytes(4, "big") + body.replace(b"\3\1a", b"\3\3bcd")
    assert [n["pitch"] for n in midi.decoded(again)["notes"]] == [60, 62]
    main(["rename", str(tmp_path / "in"), "piano", "Lead", str(tmp_path / "dry"), "--contains", "--dry-run"], spark)
    found = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "dry")).collect()]
    assert sorted((r["path"].rsplit("/", 1)[1], r["changed"]) for r in found) == [("x.mid", ["Piano"]), ("y.mid", ["electric PIANO 2"])]
    main(["rename", str(tmp_path / "in"), "piano", "Lead", str(tmp_path / "out"), "--midi"], spark)
    assert [p.name for p in (tmp_path / "out").rglob("*.mid")] == ["x.mid"] and (tmp_path / "in" / "x.mid").read_bytes() == bytes(raw)
    assert [n["name"] for n in midi.decoded((tmp_path / "out" / "x.mid").read_bytes())["notes"]] == ["Lead", "Lead", "Drums", "é Lead"]


def test_metadata_alone_and_errors(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(midi.written(tracks("Piano")))
    (tmp_path / "b.mid").write_bytes(b"none")
    whole, meta = (midi.files(spark, str(tmp_path), with_notes=x).orderBy("path").collect() for x in (True, False))
    assert [r.asDict() | {"notes": None} for r in whole] == [r.asDict() for r in meta] and whole[0].notes and whole[1].error
    assert midi.files(spark, str(tmp_path), errors="drop").count() == 1
    with pytest.raises(Exception, match="b.mid"):
        midi.files(spark, str(tmp_path), errors="fail").collect()
    with pytest.raises(ValueError):
        midi.files(spark, str(tmp_path), errors="other")

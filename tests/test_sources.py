import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import likelihood, roles
from tessera.plans import evaluation
from tessera.sources import files, midi, sinks
from tessera.streaming import ticks as streamed


def test_midi_round_trip(spark, tmp_path):
    tracks = [{"name": "Piano", "notes": [(60, 90, 0.0, 0.5), (64, 80, 0.5, 2.0)]}, {"name": "Guitar", "program": 25, "channel": 1, "notes": [(40, 70, 1.0, 1.5)]}, {"name": "kit", "channel": 9, "notes": [(36, 100, 0.0, 0.25)]}]
    (tmp_path / "a.mid").write_bytes(midi.written(tracks, tempo=90.0, numerator=3))
    (tmp_path / "b.mid").write_bytes(b"MThd nonsense")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = midi.files(spark, str(tmp_path)).cache()
    assert {r.path.rsplit("/", 1)[1]: r.error is None for r in got.select("path", "error").collect()} == {"a.mid": True, "b.mid": False}
    notes = midi.notes(got, side="generated").collect()
    want = sorted((t["name"], t.get("program", 0), t.get("channel") == 9, p, v, round(a, 3), round(b, 3)) for t in tracks for p, v, a, b in t["notes"])
    assert sorted((n.name, n.program, n.is_drum, n.pitch, n.velocity, round(n.t0, 3), round(n.t1, 3)) for n in notes) == want
    meta = got.where("error is null").first()
    assert meta.tempo == pytest.approx(90, abs=0.01) and meta.ts_numerator == 3 and meta.end_time == pytest.approx(2.0, abs=1e-3)
    assert meta.downbeats[:2] == pytest.approx([0, 2.0], abs=1e-3) and meta.beats[1] == pytest.approx(60 / 90, abs=1e-3)
    assert roles.melody_notes(midi.notes(got), roles.is_melody(names=["guitar"])).count() == 1


def test_running_status_and_tempo_changes():
    body = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\x90\x3c\x40" + b"\x60\x3c\x00" + b"\x00\xff\x51\x03\x0f\x42\x40" + b"\x00\x3d\x40\x60\x3d\x00" + b"\x00\xff\x2f\x00"
    body = body.replace(b"\x00\xff\x51\x03\x0f\x42\x40\x00\x3d\x40", b"\x00\xff\x51\x03\x0f\x42\x40\x00\x90\x3d\x40")
    data = b"MThd" + (6).to_bytes(4, "big") + b"\x00\x00\x00\x01\x00\x60" + b"MTrk" + len(body).to_bytes(4, "big") + body
    assert [(n["pitch"], n["t0"], n["t1"]) for n in midi.decoded(data)["notes"]] == [(60, 0.0, 0.5), (61, 0.5, 1.5)]


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))


def test_logs(spark, tmp_path):
    run = tmp_path / "exp" / "interval_1_gen_frame_5" / "prompt2" / "batch_run"
    write(run / "s1" / "tick_history.json", [{"tick": 0, "is_hit": True, "backup_level": 4}, {"tick": 1, "is_hit": False}])
    write(run / "s2" / "deep" / "tick_history.json", [{"tick": 0, "is_hit": True}])
    write(run / "s3" / "tick_history.json", "broken")
    write(run / "s1" / "inferences.json", [{"response": {"timings": {"round_trip_time": 0.5}}}, {"response": {"timings": {"request_arrival_time": 1.0, "response_output_time": 1.25}}}])
    assert files.ticks(spark, str(tmp_path)).count() == 2 and files.ticks(spark, str(tmp_path), direct=False).count() == 3
    got = files.timings(spark, str(tmp_path)).collect()
    assert len(got) == 2 and {r.frames for r in got} == {5} and got[0].run.endswith("interval_1_gen_frame_5_prompt2")
    write(tmp_path / "final-sys-results" / "a.json", {"global": {"global_hit_rate": 0.5, "ISR_w": "x", "total_samples": 4}})
    write(tmp_path / "final-sys-results" / "b.json", {"other": 1})
    rows = files.system_globals(spark, str(tmp_path)).collect()
    assert [(r.name, r.global_hit_rate, r.ISR_w, r.total_samples) for r in rows] == [("a", 0.5, None, 4)]


def test_annotations(spark, tmp_path):
    write(tmp_path / "c" / "chords.txt", "0.0\t1.5\tC:maj\n\n1.5\t2.0\tN\n")
    assert [(r.seg_idx, r.s1, r.label) for r in files.chords(spark, str(tmp_path / "c")).orderBy("seg_idx").collect()] == [(0, 1.5, "C:maj"), (1, 2.0, "N")]
    write(tmp_path / "bad" / "chords.txt", "0.0 1.5 C\n")
    with pytest.raises(Exception, match="three fields"):
        files.chords(spark, str(tmp_path / "bad")).collect()
    write(tmp_path / "p" / "x.jsonl", '{"accompaniment_path": "d/song.mid", "events": [{"time": 1.0, "duration": 0.5}]}\n{"events": [{"time": 0, "duration": 1}]}\n{"accompaniment_path": "e", "events": []}\n')
    assert sorted((r.song, r.t0, r.t1) for r in files.phrase_events(spark, str(tmp_path / "p")).collect()) == [("song", 1.0, 1.5), ("unknown", 0.0, 1.0)]
    write(tmp_path / "runs.conf", "# c\n\nbase:/a/b:c\nmalformed\n: /x\n")
    assert [tuple(r) for r in files.run_config(spark, str(tmp_path / "runs.conf")).collect()] == [("base", "/a/b:c")]


def test_results_and_manifest(spark, tmp_path):
    write(tmp_path / "r" / "a.json", {"summary": {"accompaniment_vs_groundtruth": {"pitch_jsd": {"mean": 0.25}, "frechet_music_distance": {"mean": 3}}}, "details": [{"pitch_jsd": 0.5}, {"pitch_jsd": None, "harmonicity": {"consonant_ratio": 1}}, 7]})
    write(tmp_path / "r" / "b.json", "{")
    docs = files.documents(files.texts(spark, str(tmp_path / "r")))
    got = files.result_items(docs, ["path"], {"pitch": ("pitch_jsd",), "cons": ("consonant_ratio", "harmonicity.consonant_ratio")}).orderBy("item").collect()
    assert [(r.item, r.pitch, r.cons) for r in got] == [(0, 0.5, None), (1, None, 1.0), (2, None, None)]
    systems = spark.createDataFrame([("sys_run_x", 0.5, 2.0, 0.25)], "candidate string, global_hit_rate double, global_avg_backup double, ISR_w double")
    nll = spark.createDataFrame([("RUN_X", 1.5, 1.25)], "candidate string, ave_nll double, weighted_ave_nll double")
    row = evaluation.report(docs.withColumn("name", F.lit("run_x")), systems, nll).first()
    assert (row.pitch_jsd, row.frechet_music_distance, row.onset_jsd, row.ISR, row.ISR_w, row.ave_nll) == (0.25, 3.0, None, 0.5, 0.25, 1.5)
    write(tmp_path / "m" / "m.json", {"k": {"root": "/r", "dirs": {"d1": 1, "d2": {}}}, "bad": {"error": "x"}, "odd": 3})
    assert sorted(tuple(r) for r in files.manifest(files.documents(files.texts(spark, str(tmp_path / "m")))).collect()) == [("k", "/r", "d1"), ("k", "/r", "d2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r/1", 0.5, None), ("r/1", None, [1, 2])], "run string, v double, a array<int>")
    sinks.csv(df, str(tmp_path / "c"), digits=6)
    assert sorted((r.v or "", r.a or "") for r in files.report(spark, str(tmp_path / "c")).collect()) == [("", "[1,2]"), ("0.500000", "")]
    sinks.by_run(df.drop("a"), "run", str(tmp_path / "d"))
    assert [p.name for p in (tmp_path / "d").iterdir() if p.is_dir()] == ["run_file=r_1"]
    rows = spark.createDataFrame([(1, 0.25)], "p int, jsd double")
    from tessera.operators.stats import summary_struct

    for most, details in ((10, [{"p": 1, "jsd": 0.25}]), (0, None)):
        sinks.json_payload(rows, rows.agg(summary_struct(F.col("jsd")).alias("jsd")), str(tmp_path / "j"), most)
        got = json.loads(spark.read.text(str(tmp_path / "j" / "result")).first().value)
        assert got["meta"] == {"pairs": 1} and got.get("details") == details and got["summary"]["jsd"]["median"] == 0.25
        assert json.loads(spark.read.text(str(tmp_path / "j" / "details")).first().value) == {"p": 1, "jsd": 0.25}
    from tessera.operators.stats import five_number

    text = sinks.summary_text(five_number(rows.withColumn("name", F.lit("JSD")), ["name"], "jsd"), "name").first().block
    assert text.splitlines()[:2] == ["  JSD:", "    mean: 0.2500"] and text.endswith("count: 1")


def test_evaluation(spark):
    from tessera.plans import views

    notes = views.notes(spark, "/root/testdata/sf0.001")
    rows = evaluation.details(notes, ["piece_id"], roles.is_melody(names=["guitar"]))
    assert rows.count() == notes.select("piece_id").distinct().count()
    one = evaluation.run_summary(rows, ["piece_id"]).first()
    assert 0 < one.accompaniment_vs_groundtruth.pitch_jsd.mean < 0.7 and one.melody_relationship.harmonicity.consonant_ratio["count"] > 0
    assert one.inter_track_continuity.auto_phrase_pairs is None
    songs = notes.select(F.col("piece_id").cast("string").alias("song"), F.lit(0).alias("record"), "t0", "t1")
    pairs = evaluation.validation_pairs(songs, evaluation.Options(random_pairs=50)).first().validation_pairs
    assert pairs.random["count"] == 50 and pairs.same_song["count"] > pairs.adjacent["count"] > 0
    assert evaluation.plot_rows(rows.withColumn("model", F.lit("m")), "model", ["pitch_jsd"]).columns == ["model", "metric", "value"]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = e.select("ts", (F.col("user_id") % 3).alias("run"), (F.col("event_type") != "error").alias("is_hit"), (F.col("event_id") % 33).cast("double").alias("backup_level"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streamed.started(source, ["run"], "tick_windows", str(tmp_path / "ck"), window="1 day", late="1 day")
    q.processAllAvailable()
    q.stop()
    want = {(r.run, r.start): (r.n, r.hit_rate) for r in streamed.windowed(rows, ["run"], window="1 day").collect()}
    got = {(r.run, r.start): (r.n, r.hit_rate) for r in spark.table("tick_windows").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_likelihood_grid_of_files(spark, tmp_path):
    write(tmp_path / "x.nll.json", {"f": {"avg_nll": 1.0, "total_nll": 2, "total_tokens": 2}})
    docs = files.documents(files.texts(spark, str(tmp_path), "*.nll.json"))
    assert likelihood.run_means(likelihood.records(docs, ["path"]), ["path"]).first().weighted_ave_nll == 1.0


def test_folders(spark, tmp_path):
    for p in ("prompt3/gen/a", "prompt3/gt/b", "prompt4/gen/c", "offline_x/gen/d", "k/e"):
        write(tmp_path / p, "x")
    listed = files.listing(spark, str(tmp_path))
    assert [r.name for r in files.child_folders(listed, str(tmp_path)).collect()] == ["k", "prompt3", "prompt4"]
    assert [(r.folder.rsplit("/", 1)[1], r.prompt) for r in files.prompt_folders(listed, ("gen", "gt")).collect()] == [("prompt3", 3)]
    doc = '{"collected": [{"filename": "a_b_prompt2_x", "ISR_w": 0.5, "global_hit_rate": "nan"}, 3]}'
    docs = spark.createDataFrame([(doc,)], "text string").withColumn("doc", F.try_parse_json("text"))
    assert [tuple(r) for r in files.collected(docs).where("filename is not null").collect()] == [("a_b", "a_b_prompt2_x", None, None, 0.5)]

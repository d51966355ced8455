import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import evaluation
from tessera.plans.cli import main
from tessera.sources import files, midi, sinks

from .test_sources import write


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def one(spark, path):
    return spark.read.option("header", True).csv(str(path)).first()


@pytest.fixture
def run(tmp_path):
    """Two sides of two pieces, chords, prompts and phrases."""
    for k, name in enumerate("ab"):
        for side, shift in (("generated", 0), ("groundtruth", 4)):
            (tmp_path / "x" / "prompt2" / side).mkdir(parents=True, exist_ok=True)
            tracks = [{"name": "Piano", "notes": [(60 + shift + 2 * k, 90, t, t + 0.5 + 0.25 * (shift > 0)) for t in range(12)]}, {"name": "Melody", "channel": 1, "notes": [(67, 80, 0.0, 9.0)]}]
            (tmp_path / "x" / "prompt2" / side / f"{name}.{'mid' if shift else 'mid.mid'}").write_bytes(midi.written(tracks))
        (tmp_path / "chords" / name).mkdir(parents=True)
        (tmp_path / "chords" / name / "chord_midi.txt").write_text("0.0\t4.0\tC:maj\n4.0\t8.0\tN\n8.0\t90.0\tC:maj\n")
        (tmp_path / "x" / "prompt2" / f"{name}_promptlen2.mid").write_bytes(midi.written([{"name": "p", "notes": [(60, 90, 0.0, 2.0)]}]))
    events = lambda n: [{"time": 0.3 * k * n, "duration": 0.5} for k in range(20)]
    (tmp_path / "phrases.jsonl").write_text("\n".join(json.dumps({"accompaniment_path": f"q/{n}.mid", "events": events(n)}) for n in (1, 2, 3)))
    return tmp_path


def test_evaluate_then_report(spark, run):
    """Every metric of a report has a number after an evaluation with all options."""
    gen, truth = (str(run / "x" / "prompt2" / s) for s in ("generated", "groundtruth"))
    pieces = [str(p) for p in (run / "x" / "prompt2" / "generated").iterdir()]
    kinds = ("prompt_polydis", "prompt_generated_continuation_polydis", "prompt_groundtruth_continuation_polydis")
    rows = [(f"file:{p}" if not p.startswith("file:") else p, kind, part, [0.0, 0.0], [3.0, 4.0 + k]) for k, p in enumerate(pieces) for kind in kinds for part in ("txt", "chd")]
    spark.createDataFrame(rows, "piece string, kind string, part string, a array<double>, b array<double>").write.parquet(str(run / "latents"))
    vectors = [(side, [float(k % 3 + d), float(k % 5)]) for d, side in enumerate(("generated", "ground_truth")) for k in range(20)]
    spark.createDataFrame(vectors, "side string, embedding array<double>").write.parquet(str(run / "emb"))
    (run / "x" / "prompt2" / "generated" / "broken.mid").write_bytes(b"no midi")
    out = run / "r" / "interval_1_gen_frame_5.json"
    options = ["--melody-name", "melody", "--chords", str(run / "chords"), "--phrases", str(run / "phrases.jsonl"), "--auto-phrases", "--bars", "1", "--prompts", str(run / "x"), "--latents", str(run / "latents"), "--embeddings", str(run / "emb"), "--histograms"]
    main(["evaluate", gen, truth, str(out), *options], spark)
    got = json.loads(lines(spark, out / "result")[0])
    assert got["meta"] == {"pairs": 2} and len(got["details"]) == 2 and len(lines(spark, out / "details")) == 2
    first = next(d for d in got["details"] if d["piece"] == "a")
    assert first["note_counts"] == {"generated": 12, "ground_truth": 12} and first["prompt_path"].endswith("a_promptlen2.mid") and sum(first["histograms"]["pitch_generated"]) == 12
    assert first["harmonicity"] == {"consonant_ratio": 1.0, "dissonant_ratio": 0.0, "unsupported_ratio": 0.0}  # a fifth below the melody
    assert len(first["auto_phrase_metrics"]["generated"]) == len(first["auto_phrase_metrics"]["ground_truth"]) > 3
    assert got["summary"]["inter_track_continuity"]["validation_pairs"]["adjacent"]["rd"]["count"] > 0 and got["summary"]["melody_relationship"]["chord_accuracy"]["count"] == 2
    assert "broken" in lines(spark, out / "errors")[0]
    assert spark.read.parquet(str(out / "continuations")).agg({"t0": "min"}).first()[0] >= 2.0
    printed = "\n".join(lines(spark, out / "printed"))
    assert printed.startswith("Pairs evaluated: 2") and "  Pitch JSD:\n    count: 2\n    mean: " in printed and "  PolyDis (prompt):\n    txt mean distance:\n      count: 2" in printed
    write(run / "s" / "final-sys-results" / "interval_1_gen_frame_5.json", {"global": {"global_hit_rate": 0.5, "global_avg_backup": 1, "ISR_w": 0.25}})
    main(["report", str(run / "r"), str(run / "s"), str(run / "o")], spark)
    row = one(spark, run / "o").asDict()
    assert list(row) == ["filename", *evaluation.REPORT, "ISR", "Staleness", "ISR_w"] and all(v not in (None, "") for v in row.values())
    main(["stats", str(run / "r"), str(run / "o2"), "--stat", "mean"], spark)
    stats = one(spark, run / "o2").asDict()
    assert all(stats[f"{m}-mean"] for m in evaluation.ITEM_METRICS)
    write(run / "n" / "experiments_interval_1_gen_frame_5.json", {"f": {"mean_nll": 2.0, "sum_nll": 8, "tokens": 4}, "g": {"avg_nll": 0, "avg_loss": 4.0}})
    main(["merge", str(run / "o"), str(run / "n"), str(run / "o3")], spark)
    assert (one(spark, run / "o3").ave_nll, one(spark, run / "o3").weighted_ave_nll) == ("3.0", "2.0")
    with pytest.raises(ValueError, match="not a MIDI file"):
        main(["evaluate", gen, truth, str(run / "z.json"), "--strict"], spark)


def test_batches(spark, run):
    (run / "runs.conf").write_text(f"# runs\nfirst:{run / 'x'}\n")
    main(["batch", str(run / "runs.conf"), str(run / "b"), "--melody-name", "melody", "--midi"], spark)
    assert sorted(str(p.relative_to(run / "b" / "midi")) for p in (run / "b" / "midi").rglob("*.mid")) == [f"first_prompt2/{side}/{n}.mid" for side in ("generated", "ground_truth") for n in "ab"]
    table = spark.read.option("header", True).option("multiLine", True).csv(str(run / "b" / "table")).first()
    assert table["prompt"] == "2" and table["first"].startswith("Pairs evaluated: 2")
    main(["folders", str(run / "x"), str(run / "x" / "prompt2" / "groundtruth"), str(run / "f"), "--melody-name", "melody"], spark)
    main(["report", str(run / "f"), str(run / "x"), str(run / "o")], spark)
    assert one(spark, run / "o").pitch_jsd and one(spark, run / "o").rd is None
    main(["rename", str(run / "x"), "melody", "Lead", str(run / "named")], spark)
    assert {json.loads(x)["name"] for x in lines(spark, run / "named")} == {"Piano", "Lead", "p"}


def test_many_runs_in_one_plan(spark, tmp_path):
    """A batch of eight runs: as many jobs as of two, and the results of evaluations one by one."""

    def jobs(command):
        spark.sparkContext.setJobGroup(str(command), "")
        main(command, spark)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(command)))

    for label in "pqrs":
        for prompt in (2, 4):
            for side, shift in (("generated", 0), ("groundtruth", 3)):
                folder = tmp_path / label / f"prompt{prompt}" / side
                folder.mkdir(parents=True)
                for k in range(2):
                    notes = [(40 + shift + prompt + 5 * k + ord(label) % 7, 90, t, t + 0.5 + shift / 8) for t in range(8 + k)]
                    (folder / f"{k}.mid").write_bytes(midi.written([{"name": "Piano", "notes": notes}, {"name": "Melody", "channel": 1, "notes": [(67, 80, 0.0, 5.0)]}]))
    (tmp_path / "one.conf").write_text(f"p:{tmp_path / 'p'}\n")
    options = ["--melody-name", "melody"]
    few = jobs(["batch", str(tmp_path / "one.conf"), str(tmp_path / "few"), *options])
    many = jobs(["batch", *[f"{x}:{tmp_path / x}" for x in "pqrs"], str(tmp_path / "many"), *options])
    assert abs(few - many) <= few / 10  # the same but for what the adaptive plan splits
    got = {p.name[5:-5]: json.loads(lines(spark, p)[0]) for p in (tmp_path / "many" / "results").glob("file=*")}
    assert sorted(got) == [f"{x}_prompt{n}" for x in "pqrs" for n in (2, 4)]
    for name in ("p_prompt2", "s_prompt4"):
        label, prompt = name.split("_")
        main(["evaluate", *[str(tmp_path / label / prompt / side) for side in ("generated", "groundtruth")], str(tmp_path / "alone" / f"{name}.json"), *options], spark)
        alone = json.loads(lines(spark, tmp_path / "alone" / f"{name}.json" / "result")[0])
        assert got[name]["summary"] == alone["summary"] and got[name]["meta"] == alone["meta"]
        details = [json.loads(x) for x in lines(spark, tmp_path / "many" / "details" / f"file={name}.json")]
        key = lambda d: d["generated_path"]
        assert sorted(details, key=key) == sorted(alone["details"], key=key)
    main(["stats", str(tmp_path / "many"), str(tmp_path / "s1"), "--stat", "mean"], spark)
    main(["stats", str(tmp_path / "alone"), str(tmp_path / "s2"), "--stat", "mean"], spark)
    of = lambda p: {r["name"]: tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / p)).collect()}
    assert len(of("s1")) == 8 and of("s2").items() <= of("s1").items()
    with pytest.raises(ValueError, match="several runs"):
        main(["folders", str(tmp_path), str(tmp_path / "p"), str(tmp_path / "f"), *options], spark)
    main(["folders", str(tmp_path / "p"), str(tmp_path / "p" / "prompt2" / "groundtruth"), str(tmp_path / "f"), *options, "--names", "folders"], spark)
    assert len(list((tmp_path / "f" / "results").glob("file=*p_prompt?.json"))) == 2


def test_results_of_any_size(spark, tmp_path):
    """What stats reads of a run doesn't change with its number of pieces, nor with the bound of the text's details."""
    rows = spark.range(50_000).selectExpr("id as piece", "id % 64 / 64.0D as pitch_jsd")
    for k, (df, most) in enumerate(((rows, sinks.MOST_PIECES), (rows.limit(5), 10), (rows.limit(5), 2))):
        sinks.json_payload(df, df.agg(F.struct(F.avg("pitch_jsd").alias("mean")).alias("pitch_jsd")), str(tmp_path / "r" / f"run{k}.json"), most)
    found = files.details(spark, str(tmp_path / "r"), {"pitch_jsd": ("pitch_jsd",)})
    assert {r.name: (r.n, r.x) for r in found.groupBy("name").agg(F.count("pitch_jsd").alias("n"), F.sum("pitch_jsd").alias("x")).collect()} == {"run0": (50_000, rows.agg(F.sum("pitch_jsd")).first()[0]), "run1": (5, 10 / 64), "run2": (5, 10 / 64)}
    main(["stats", str(tmp_path / "r"), str(tmp_path / "o"), "--stat", "mean"], spark)
    assert all(r["pitch_jsd-mean"] for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect())


def test_logs_and_reports(spark, tmp_path):
    run = tmp_path / "x" / "interval_1_gen_frame_5" / "p" / "batch_run" / "s"
    write(run / "tick_history.json", [{"tick": 0, "is_hit": True, "backup_level": 16}])
    write(run / "inferences.json", [{"response": {"timings": {"round_trip_time": 9.0}}}])
    main(["system", str(tmp_path / "x"), str(tmp_path / "o1")], spark)
    assert any("GLOBAL,1.0,16.0,0.5,1,1" in x for x in lines(spark, tmp_path / "o1" / "rows"))
    main(["globals", str(tmp_path / "o1"), str(tmp_path / "o0")], spark)  # a system's results are what globals reads
    assert json.loads(lines(spark, tmp_path / "o0")[0])["mean_ISR_w"] == 0.5
    main(["deadlines", str(tmp_path / "x"), str(tmp_path / "o2")], spark)
    assert json.loads(lines(spark, tmp_path / "o2")[0])["dmr"] == 1.0 and json.loads(lines(spark, tmp_path / "o2")[0])["details_sample"] == [9.0]
    write(run.parent / "t" / "inferences.json", [{"response": {"timings": {"round_trip_time": x}}} for x in (0.0, 8.0)])
    main(["deadlines", str(tmp_path / "x"), str(tmp_path / "o8"), "--records", "--by-run", "--sample", "2"], spark)
    records = [json.loads(lines(spark, p)[0])["details_sample"] for p in (tmp_path / "o8").glob("file=*.json")]
    assert [[(r["subdir"].rsplit("/", 1)[1], r["round_trip_time"], r["miss"]) for r in x] for x in records] == [[("s", 9.0, True), ("t", 0.0, False)]]
    main(["system", str(tmp_path / "x"), str(tmp_path / "o9"), "--aggregated"], spark)
    assert json.loads(lines(spark, tmp_path / "o9" / "aggregated")[0])["backup_level"] == 16
    write(tmp_path / "s" / "final-sys-results" / "interval_1_gen_frame_5.json", {"global": {"global_hit_rate": 0.5, "global_avg_backup": 1, "ISR_w": 0.25, "total_samples": 2, "total_hits": 1}})
    write(tmp_path / "n" / "interval_1_gen_frame_5.nll.json", {"f": {"avg_nll": 1.0, "total_nll": 6, "total_tokens": 4}})
    write(tmp_path / "r" / "interval1_gen5.json", {"summary": {"accompaniment_vs_groundtruth": {"pitch_jsd": {"mean": 0.125}}}, "details": [{"pitch_jsd": 0.5}, {"pitch_jsd": 0.25}]})
    main(["globals", str(tmp_path / "s"), str(tmp_path / "o3")], spark)
    assert json.loads(lines(spark, tmp_path / "o3")[0])["mean_ISR_w"] == 0.25
    main(["report", str(tmp_path / "r"), str(tmp_path / "s"), str(tmp_path / "o4"), "--nll", str(tmp_path / "n")], spark)
    row = spark.read.option("header", True).csv(str(tmp_path / "o4")).first()
    assert (row.filename, row.pitch_jsd, row.ISR, row.weighted_ave_nll) == ("interval1_gen5", "0.125", "0.5", "1.5")
    main(["nll", str(tmp_path / "n"), str(tmp_path / "o5")], spark)
    main(["grid", str(tmp_path / "n"), str(tmp_path / "o6")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "o6")).first()["5"] == "1.500000"
    main(["stats", str(tmp_path / "r"), str(tmp_path / "o7"), "--stat", "mean"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "o7")).first()["pitch_jsd-mean"] == "0.375"
    with pytest.raises(SystemExit):
        main(["nothing"], spark)

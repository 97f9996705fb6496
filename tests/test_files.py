"""Readers, manifests, sinks, audio decoding and the bank on real files."""

import json
import math
import struct
import uuid
import wave

import pytest
from pyspark.sql import functions as F

from cuewright.operators import audio, bank
from cuewright.sources import manifest as M, readers, sinks


def write_wav(path, values, rate=24000, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        top = 2 ** (8 * width - 1) - 1
        raw = b""
        for v in values:
            n = int(v * top)
            raw += (bytes([n + 128]) if width == 1 else n.to_bytes(width, "little", signed=True)) * channels
        w.writeframes(raw)


def tone(n=7200, amp=0.12, quiet=120):
    return [amp * math.sin(2 * math.pi * 220 * i / 24000) if i < n - quiet else 0.0 for i in range(n)]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("takes")
    for block in ("B01", "B02"):
        (root / block).mkdir()
        (root / block / "phrases.json").write_text(json.dumps([{"text": "하나", "sentence_final": True}, 5, {"text": "둘", "forced": True}]))
        for p in range(2):
            for k in range(2):
                body = {"take": k, "seed": 7, "ok": k == 0, "why": [] if k == 0 else ["rate 9"], "n_syl": 5, "numeric": False, "text": "하나",
                        "metrics": {"dur": 2.0, "median_hz": 230.0, "range_st": 8.0, "end_slope": -12.0, "tail_delta": -2.0}}
                (root / block / f"P{p:02d}_t{k}.json").write_text(json.dumps(body))
    (root / "B01" / "P09_t0.json").write_text("{broken")
    (root / "B01" / "P09_t1.json").write_text("[1]")
    (root / "B01" / "p08_T3.JSON").write_text(json.dumps({"take": 3}))
    (root / "B01_pins.json").write_text(json.dumps({"P00": 1, "note": 3, "P1": 0}))
    (root / "B02_report.json").write_text(json.dumps({"id": "B02", "picks": [1, 0]}))
    (root / "jobs.json").write_text(json.dumps({"blocks": [{"id": "B01", "text": "가", "seed": 1}, {"id": "B03", "text": "나", "seed": 2}]}))
    return root


def test_take_scan(spark, tree):
    raw = readers.read_files(spark, str(tree), "*.json")
    takes, errors = readers.parse_takes(raw)
    assert takes.count() == 8 and takes.where("block_id = 'B01' AND phrase_idx = 1 AND take_id = 1").first()["why"] == ["rate 9"]
    assert {r["error"] for r in errors.collect()} == {"take_json_error:JSONDecodeError", "take_json_error:ValueError"}
    one_level, _ = readers.read_takes(spark, str(tree), blocks=["B02"], recursive=False)
    assert one_level.count() == 4
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tree)).select("path", F.decode("content", "UTF-8").alias("content"))
    assert readers.parse_takes(loose, ignore_case=True)[0].where("phrase_idx = 8").first()["take_id"] == 3


def test_side_files(spark, tree):
    read = lambda glob: readers.read_files(spark, str(tree), glob)
    phrases = readers.parse_phrases(read("phrases.json")).where("block_id = 'B01'").orderBy("phrase_idx").collect()
    assert [(r["phrase_idx"], r["text"], r["sentence_final"], r["forced"]) for r in phrases] == [(0, "하나", True, False), (2, "둘", False, True)]
    pins = {(r["block_id"], r["phrase_idx"]): r["take_id"] for r in readers.parse_pins(read("*_pins.json")).collect()}
    assert pins == {("B01", 0): 1, ("B01", 1): 0}
    reports = readers.parse_reports(read("*_report.json"))
    assert {(r["phrase_idx"], r["take_id"]) for r in reports.collect()} == {(0, 1), (1, 0)}
    jobs = readers.read_jobs(spark, str(tree / "jobs.json"))
    assert {r["block_id"] for r in readers.pending(jobs, reports).collect()} == {"B01", "B03"}


def test_manifest(spark, tree):
    entries = M.manifest(readers.read_files(spark, str(tree), "*"), "path", "raw").cache()
    same = M.read_only_verified(entries, entries).first()
    assert same["read_only_verified"] and same["same"] == entries.count()
    changed = entries.withColumn("sha256", F.when(F.col("path").contains("P00_t0"), "x").otherwise(F.col("sha256")))
    assert not M.read_only_verified(entries, changed).first()["read_only_verified"]
    a, b, c = (M.fingerprint(df).first()["digest"] for df in (entries, entries.repartition(7), changed))
    assert a == b != c
    assert M.fingerprint(entries.unionByName(entries.limit(1))).first()["digest"] != a


def test_sink_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    with pytest.raises(ValueError):
        sinks.write_report(df, f"{tmp_path}/in/../in/out", f"file://{tmp_path}/in")
    out = sinks.write_report(df, f"{tmp_path}/out", f"{tmp_path}/in")
    assert spark.read.schema("a int, b double").json(out).first()["b"] is None
    with pytest.raises(Exception):
        sinks.write_report(df, out, f"{tmp_path}/in")
    assert not sinks.is_within("/a/bc", "/a/b") and sinks.is_within("s3://x/a/b", "s3://x/a")


@pytest.fixture(scope="module")
def wavs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    write_wav(root / "good.wav", tone())
    write_wav(root / "rate.wav", tone(), rate=16000)
    write_wav(root / "short.wav", tone(1200, quiet=200))
    write_wav(root / "silent.wav", [0.0] * 7200)
    write_wav(root / "loud.wav", tone(amp=0.999))
    write_wav(root / "offset.wav", [0.05 + v for v in tone(quiet=0)])
    write_wav(root / "gap.wav", tone(4800, quiet=0) + [0.0] * 24000 + tone(4800))
    write_wav(root / "lead.wav", [0.0] * 40000 + tone())
    write_wav(root / "abrupt.wav", [0.3 * (1 if i % 2 else -1) for i in range(7200)])
    body = (root / "good.wav").read_bytes()
    (root / "cut.wav").write_bytes(body[:2000])
    (root / "noise.wav").write_bytes(b"not audio")
    (root / "coded.wav").write_bytes(body[:20] + struct.pack("<H", 6) + body[22:])
    for width in (1, 3, 4):
        write_wav(root / f"w{width}.wav", tone(), width=width, channels=2)
    return root


def test_audio_sanity(spark, wavs):
    files = spark.read.format("binaryFile").load(str(wavs)).withColumn("path", F.regexp_extract("path", r"([^/]*)\.wav$", 1))
    decoded = audio.decode(files).cache()
    expected = files.select("path").unionByName(spark.createDataFrame([("gone",)], "path string"))
    got = {r["path"]: r["reasons"] for r in audio.sanity(expected, decoded).collect()}
    assert got["good"] == [] and got["w3"] == [] and got["w4"] == []
    assert got["rate"] == ["unexpected_sample_rate"] and "file_too_short" in got["short"]
    assert got["silent"] == ["zero_waveform"]
    assert "peak_guard_exceeded" in got["loud"] and "dc_offset_exceeded" in got["offset"]
    assert got["gap"] == ["internal_silence_too_long"] and got["lead"] == ["leading_silence_too_long"] and "abrupt_end" in got["abrupt"]
    assert got["gone"] == ["file_missing"] and got["cut"] == got["noise"] == got["coded"] == ["decode_error"]
    widths = {r["path"]: (r["sample_width"], r["channels"]) for r in decoded.where("path LIKE 'w%'").collect()}
    assert widths == {"w1": (1, 2), "w3": (3, 2), "w4": (4, 2)}
    assert len(audio.SanityConfig().config_hash) == 64 and audio.SanityConfig(peak_guard=0.5).config_hash != audio.SanityConfig().config_hash


def deliver(spark, rows):
    shape = ("project_id string, path string, sha256 string, seq long, modified long, block_id string, phrase_id string, take_id int, ok boolean, "
             "why array<string>, n_syl double, dur double, tail_delta double, range_st double, error string")
    return spark.createDataFrame(rows, shape)


def test_bank_runs(spark, tmp_path):
    row = lambda k, sha, seq, ok=True: ("p", f"B/P00_t{k}.json", sha, seq, 0, "B", "P00", k, ok, [] if ok else ["rate"], 10.0, 2.0, -2.0, 8.0, None)
    store = bank.Bank(spark, str(tmp_path / uuid.uuid4().hex))
    pins = spark.createDataFrame([("p", "B", "P00", 1)], "project_id string, block_id string, phrase_id string, take_id int")
    bad = ("p", "B/P01_t0.json", None, 9, 0, "B", "P01", 0, None, None, None, None, None, None, "JSONDecodeError")
    first = store.ingest(deliver(spark, [row(0, "a", 1), row(1, "b", 2), row(1, "b", 3), bad]), pins, "r1").first()
    assert (first["inserted"], first["unchanged"], first["errors"]) == (2, 1, 1)
    moved = spark.createDataFrame([("p", "B", "P00", 0)], pins.schema)
    second = store.ingest(deliver(spark, [row(0, "a", 4), row(1, "c", 5, ok=False)]), moved, "r2").first()
    assert (second["inserted"], second["unchanged"]) == (1, 1)
    takes = {(r["take_id"], r["sha256"]): r["decision"] for r in store.table("takes").collect()}
    # an unchanged revision keeps its decision although the pin moved
    assert takes == {(0, "a"): "not_selected", (1, "b"): "selected", (1, "c"): "not_selected"}
    assert store.table("events").count() == 1
    newest = bank.latest_revision(store.table("takes"), "seq").where("take_id = 1").first()
    assert newest["sha256"] == "c"
    # a run of known and unreadable files only is finished too
    worse = ("p", "B/P02_t0.json", None, 11, 0, "B", "P02", 0, None, None, None, None, None, None, "JSONDecodeError")
    third = store.ingest(deliver(spark, [row(0, "a", 10), worse]), pins, "r3").first()
    assert (third["inserted"], third["unchanged"], third["errors"]) == (0, 1, 1) and store.table("errors").count() == 2
    # what an interrupted run left is not seen, and is replaced when the run is repeated
    deliver(spark, [bad]).select("project_id", "path", "error").write.parquet(f"{store.path('errors')}/run_id=r4")
    assert store.table("errors").count() == 2
    assert store.ingest(deliver(spark, [row(2, "d", 12)]), pins, "r4").first()["inserted"] == 1
    assert store.table("errors").count() == 2 and store.table("takes").count() == 4
    with pytest.raises(ValueError):
        store.ingest(deliver(spark, []), pins, "r4")


def test_keys_tell_separators_and_nulls_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("c", None)], "x string, y string")
    assert rows.select(bank.key_of("x", "y").alias("k")).distinct().count() == 4


def test_numbers_too_long_for_a_name(spark):
    raw = spark.createDataFrame([("B/P99999999999_t0.json", '{"take": 0}'), ("B/P1_t2.json", '{"take": 2}')], "path string, content string")
    good, errors = readers.parse_takes(raw)
    assert [r["take_id"] for r in good.collect()] == [2] and [r["error"] for r in errors.collect()] == ["take_name_error:OverflowError"]
    pins = spark.createDataFrame([("x/B_pins.json", '{"P00": 1, "P99999999999": 2}')], "path string, content string")
    assert [tuple(r)[1:] for r in readers.parse_pins(pins).collect()] == [(0, 1)]


def test_decisions(spark):
    rows = [("p", "B", "1", 0, False, ["rate"]), ("p", "B", "2", 0, False, []), ("p", "B", "3", 0, True, []), ("p", "B", "4", 0, None, [])]
    takes = spark.createDataFrame(rows, "project_id string, block_id string, phrase_id string, take_id int, ok boolean, why array<string>")
    pins = spark.createDataFrame([("p", "B", "3", 0)], "project_id string, block_id string, phrase_id string, take_id int")
    got = {r["phrase_id"]: r["decision"] for r in bank.pin_decision(takes, pins).collect()}
    assert got == {"1": "rejected", "2": "unknown", "3": "selected", "4": "unknown"}


def test_wav_blocks_of_every_width(spark, tmp_path, monkeypatch):
    from cuewright.operators import audio

    values = [((i * 37) % 200 - 100) / 128 for i in range(1000)]
    for width in (1, 2, 3, 4):
        scale = 1 << (8 * width - 1)
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            frames = b""
            for v in values:
                for side in (v, 0.0):
                    n = int(side * scale)
                    frames += (n + 128).to_bytes(1, "little") if width == 1 else n.to_bytes(width, "little", signed=True)
            w.writeframes(frames)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    whole = {r["path"][-6:]: r["samples"] for r in audio.decode(files).collect()}
    assert sorted(whole) == ["w1.wav", "w2.wav", "w3.wav", "w4.wav"]
    assert all(max(abs(a - v / 2) for a, v in zip(s, values)) < 1e-2 for s in whole.values()) and all(len(s) == 1000 for s in whole.values())
    monkeypatch.setattr(audio, "BLOCK_SAMPLES", 64)
    layout = audio.wav_layout((tmp_path / "w3.wav").read_bytes())
    content = memoryview((tmp_path / "w3.wav").read_bytes())
    first, frame = layout[3], layout[1] * layout[2]
    pieces = [x for at in range(0, 1000, 64) for x in audio.mono_samples(content[first + at * frame : first + min(1000, at + 64) * frame], 2, 3)]
    assert pieces == whole["w3.wav"]


def test_names_of_groups_and_configurations(spark):
    from pyspark.sql import functions as F

    from cuewright.operators import audio, ranker
    from cuewright.rules import FEATURE_NAMES

    assert spark.range(1).select(audio.SanityConfig.config_hash_of()).first()[0] == audio.SanityConfig().config_hash
    changed = audio.SanityConfig.config_hash_of(peak_guard=F.lit(0.5))
    assert spark.range(1).select(changed).first()[0] == audio.SanityConfig(peak_guard=0.5).config_hash
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    assert spark.range(1).select(ranker.schema_hash_of(names)).first()[0] == ranker.schema_hash()
    scores = spark.createDataFrame([("me", 0.9), ("me", 0.7), ("other", 0.2), ("other", 0.75), ("tired", 0.6)], "group string, primary_score double")
    row = audio.calibrate(scores, positives=("me",), negative="other", extras=("tired",)).first()
    assert (row["status"], round(row["threshold"], 6), row["n_tired"], row["false_accepts"], row["false_rejects"]) == ("calibrated_candidate", 0.725, 1, 1, 1)


def test_null_keys_keep_their_measures(spark):
    from datetime import datetime

    from cuewright.operators import measure, sessions

    frames = [(k, i / 100, 200.0 + i % 7) for k in (None, "a") for i in range(120)]
    lengths = spark.createDataFrame([(None, 1.2), ("a", 1.2)], "k string, dur double")
    got = measure.pitch(spark.createDataFrame(frames, "k string, t double, f0 double"), lengths, ["k"]).collect()
    assert len(got) == 2 and got[0][2:] == got[1][2:] and all(r["measurable"] and r["end_slope"] is not None for r in got)
    events = [(None, datetime(2024, 1, 1, 0, i), i, "synth", "g1" if i < 3 else "g2") for i in range(5)]
    out = sessions.discard_stale(spark.createDataFrame(events, "session_id long, ts timestamp, seq long, kind string, generation_id string"))
    assert sorted((r["seq"], r["stale"]) for r in out.collect()) == [(0, False), (1, False), (2, False), (3, True), (4, True)]


def test_completed_validations(spark):
    from cuewright.operators import shadow

    validators = (("x", True, "x_absent"), ("y", False, "y_absent"))
    takes = spark.createDataFrame([("p", "b", 1, 0), ("p", "b", 1, 1)], "project_id string, block_id string, phrase_id long, take_id int")
    kinds = "project_id string, block_id string, phrase_id long, take_id int, validator_name string, status string, hard_gate boolean, score double, reasons array<string>, metrics map<string,double>"
    results = spark.createDataFrame([("p", "b", 1, 0, "y", "pass", None, 0.5, [], None), ("p", "b", 1, 0, "z", "fail", True, None, [], None), ("p", "b", 1, 0, "y", "fail", True, 0.1, ["low"], None)], kinds)
    got = sorted((r["take_id"], r["validator_name"], r["status"], r["hard_gate"], r["score"] or 0, tuple(r["reasons"])) for r in shadow.complete_validations(takes, results, validators).collect())
    assert got == [
        (0, "x", "not_run", True, 0, ("x_absent",)), (0, "y", "fail", True, 0.1, ("low",)), (0, "y", "pass", False, 0.5, ()),
        (1, "x", "not_run", True, 0, ("x_absent",)), (1, "y", "not_run", False, 0, ("y_absent",)),
    ]
    alive = {r["take_id"]: (r["survives"], r["passed"]) for r in shadow.survival(takes, results, validators, with_passed=True).collect()}
    assert alive == {0: (False, ["y"]), 1: (True, [])}

import io
import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from turnloom.plans import models
from turnloom.sources import readers as rd
from turnloom.sources import writers as wr


def put(path, text):
    path.write_text(text)
    return str(path)


def test_gold_events(spark, tmp_path):
    nested = rd.json_records(spark, put(tmp_path / "a.jsonl", json.dumps({"session_id": "s1:mid180", "events": [{"t": 1.5, "kind": "Turn Shift", "speaker": "user"}, {"time": 2, "event": "bc"}, {"t": 3, "kind": "??"}]}) + "\n"))
    assert sorted((r["t"], r["kind"]) for r in rd.gold_events(nested).collect()) == [(1.5, "turn_shift"), (2.0, "backchannel")]
    flat = rd.json_records(spark, put(tmp_path / "b.json", json.dumps([{"name": "s", "t": 1, "kind": "overlap"}, {"t": 2, "kind": "bc"}], indent=1)))
    assert [tuple(r)[:3] for r in rd.gold_events(flat).collect()] == [("s", 1.0, "barge_in")]


def test_envelope(spark, tmp_path):
    df = rd.json_records(spark, put(tmp_path / "e.json", json.dumps({"records": [{"id": "a", "surprise": [1.0, 2.0]}, {"id": "b", "surprise": [1.0]}]}, indent=1)))
    got = rd.surprise_series(df).collect()
    assert [(r["session_id"], r["frame"], r["value"]) for r in got] == [("a", 0, 1.0), ("a", 1, 2.0)]
    assert rd.aggregates_only(df, rd.SURPRISE_KEYS).count() == 1


def test_transcripts_and_vad(spark, tmp_path):
    t = rd.json_records(spark, put(tmp_path / "t.jsonl", json.dumps({"session_id": "s", "segments": [{"spk": "u", "begin": 0, "stop": 1, "utterance": "hi"}, {"spk": "u", "begin": 0}]})))
    assert [tuple(r) for r in rd.transcript_turns(t).collect()] == [("s", "u", 0.0, 1.0, "hi")]
    v = rd.json_records(spark, put(tmp_path / "v.jsonl", json.dumps({"uuid": "s", "left": [[0, 1]], "assistant_vad": [{"start": 2, "end": 3}], "intervals": [{"start": 4, "end": 5}]})))
    assert sorted(tuple(r)[1:] for r in rd.vad_intervals(v).collect()) == [("assistant", 2.0, 3.0), ("unknown", 4.0, 5.0), ("user", 0.0, 1.0)]


def test_csv_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "candor_abc-uuid.csv", "speaker, startTime ,stopTime,utterance\nu,0,1,hey\n")
    put(tmp_path / "in" / "q_turns.csv", "speaker,startTime,stopTime,utterance\nu,15000,20000,a\nv,20000,35000,b\n")
    got = sorted(tuple(r) for r in rd.transcript_csvs(spark, str(tmp_path / "in")).collect())
    assert got == [("abc-uuid", "u", 0.0, 1.0, "hey"), ("q", "u", 15.0, 20.0, "a"), ("q", "v", 20.0, 35.0, "b")]


def test_csv_of_many_sessions(spark, tmp_path, monkeypatch):
    ids = ["007", "2021-01-02", "", " a ", 'q"\\', "x\ny,z", "candor_s", "dc_candor_s", *[f"s{i}" for i in range(300)]]
    turns = [(i, "User", x, 1.5, 3.25) for i, x in enumerate(ids)] + [(900, None, "s1", 9.5, 10.0), (901, "user", "s2", 0.001, 0.002), (902, "user", None, 0.0, 1.0)]
    turns += [(903, "user", "short", 1.0, 2.0)] + [(904 + i, "a", x, 20.0, 20.5) for i, x in enumerate(ids)]
    df = spark.createDataFrame(turns, "turn_id bigint, speaker string, session_id string, start_s double, end_s double")
    df.write.parquet(str(tmp_path / "transcript_turns.parquet"))
    monkeypatch.setattr(models, "place", lambda spark, name: str(tmp_path / name))
    got = sorted(tuple(r) for r in entry.queries()["src_06_transcript_csv"](spark, str(tmp_path)).select("session_id", "speaker", "start_s", "end_s").collect())
    c = duckdb.connect()
    c.execute(f"create view transcript_turns as select * from '{tmp_path}/transcript_turns.parquet/*.parquet'")
    want = sorted(c.execute(f"select session_id, speaker, start_s, end_s from ({entry.oracle_sql()['src_06_transcript_csv']})").fetchall())
    assert got == want and {"007", "2021-01-02", "", " a ", "s", "candor_s"} <= {r[0] for r in got}
    assert len(list((tmp_path / "csv").rglob("*.csv"))) <= 20  # a file for each session before


def test_series(spark, tmp_path):
    rec = {"session_id": "s", "audio_nll_per_step": [1.25, 0.5], "p_now": [0.25, 0.75], "audio_nll": 0.9, "duration_s": 7.5}
    df = rd.json_records(spark, put(tmp_path / "s.jsonl", json.dumps(rec)))
    nll = rd.nll_series(df).orderBy("frame").collect()
    assert [r["value"] for r in nll] == [1.25, 0.5] and nll[1]["t_end_s"] == pytest.approx(0.16) and nll[0]["duration_s"] == 7.5
    assert [r["value"] for r in rd.shift_series(df).collect()] == pytest.approx([0.75, 0.25])
    only = rd.json_records(spark, put(tmp_path / "x.jsonl", json.dumps({"session_id": "only-means", "audio_nll": 2.5, "p_shift_mean": 0.125})))
    assert rd.nll_series(only).count() == 0


def test_arrays_and_wav(spark, tmp_path):
    np.save(tmp_path / "dc_a.npy", np.arange(6.0).reshape(3, 2))
    np.savez(tmp_path / "b.npz", hidden=np.ones((2, 4)), junk=np.zeros(1))
    got = {(r["session_id"], r["row"]): r["values"] for r in rd.array_files(spark, str(tmp_path), ["hidden"]).collect()}
    assert got[("a", 2)] == [4.0, 5.0] and got[("b", 1)] == [1.0] * 4 and len(got) == 5
    (tmp_path / "x.wav").write_bytes(wr.wav_bytes(np.zeros((100, 2)), 8000))
    r = rd.wav_info(spark, str(tmp_path)).first()
    assert (r["channels"], r["rate"], r["frames"], r["complete"]) == (2, 8000, 100, True)


GOOD = {"schema": "v", "protocol_version": "1", "assignment_id": "a", "presentation_id": "p", "annotator_id": "x", "action": "wait", "confidence": 3, "also_acceptable": [], "tags": [], "acceptable_onset": None, "quality": "clean", "ratable": True}


def test_strict_answers(spark, tmp_path):
    bad = [GOOD | {"confidence": 3.0}, GOOD | {"confidence": True}, GOOD | {"extra": 1}, {k: v for k, v in GOOD.items() if k != "tags"}, GOOD | {"action": "dance"}, GOOD | {"ratable": False}, GOOD | {"also_acceptable": ["wait", "ack"]}]
    lines = [json.dumps(GOOD), *map(json.dumps, bad), json.dumps(GOOD)[:-1] + ', "tags": []}', json.dumps(GOOD).replace("3", "NaN"), "  "]
    got = rd.strict_answers(spark, put(tmp_path / "r.jsonl", "\n".join(lines) + "\n")).collect()
    assert len(got) == len(lines) and [r["error"] is None for r in got] == [True] + [False] * (len(lines) - 1)
    assert len(got[0]["row_sha256"]) == 64


def test_config_receipts_tables():
    assert rd.config("a: 1 # x\nb: true\nc: text\n", {"a": int, "b": bool, "c": str}) == {"a": 1, "b": True, "c": "text"}
    for text in ("a: 1\na: 2", "z: 1", "a: x", "a: .nan"):
        with pytest.raises(ValueError):
            rd.config(text, {"a": int})
    signed = wr.receipt({"b": 1, "a": "ü"}, b"key")
    assert wr.verified(signed, b"key") and not wr.verified(signed | {"b": 2}, b"key") and not wr.verified(signed, b"other")
    assert wr.text_table([{"x": 1.0, "y": None}], ["x", "y"]) == "x      y\n1.000  -"
    assert wr.wav_bytes(np.zeros(4), 8000)[:4] == b"RIFF" and io.BytesIO(wr.wav_bytes(np.zeros(4), 8000)).read(4) == b"RIFF"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 2.0), ("b", 0, 1.0), ("a", 0, None)], "session_id string, frame long, value double")
    nested = {r["session_id"]: r["v"] for r in wr.nested_series(df, "value", "v").collect()}
    assert nested == {"b": [1.0, 2.0], "a": [None]}
    wr.manifest(df, str(tmp_path / "m"), ["session_id", "frame"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines == ['{"frame":0,"session_id":"a","value":null}', '{"frame":0,"session_id":"b","value":1.0}', '{"frame":1,"session_id":"b","value":2.0}']
    wr.publish(df, str(tmp_path / "p"))
    assert (tmp_path / "p" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        wr.publish(df, str(tmp_path / "p"))

import json

import numpy as np
import pytest

from turnloom.operators import protocols as pr
from turnloom.sources import strict as st
from turnloom.sources import weights as wt
from turnloom.sources import writers as wr


def put(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


FINE = {"session_id": "fine", "lineage_id": "l", "source": "x", "duration_s": 9, "user_vad": [[4, 5.5], [0.5, 2]], "right": [{"start_s": 2, "end_s": 3}, {"start": 3, "end": 4}], "extra": {"a": 1}}


def test_strict_speech(spark, tmp_path):
    bad = {
        "session_id": FINE | {"session_id": " "},
        "lineage_id": {k: v for k, v in FINE.items() if k != "lineage_id"} | {"session_id": "b"},
        "source": FINE | {"session_id": "c", "source": ""},
        "duration_s": FINE | {"session_id": "d", "duration_s": "9"},
        "challenge": FINE | {"session_id": "e", "challenge": "yes"},
        "user alias": FINE | {"session_id": "f", "left": []},
        "assistant alias": {k: v for k, v in FINE.items() if k != "right"} | {"session_id": "g"},
        "user list": FINE | {"session_id": "h", "user_vad": [[1]]},
        "assistant list": FINE | {"session_id": "i", "right": [{"start_s": 1}]},
        "user range": FINE | {"session_id": "j", "user_vad": [[8, 9.5]]},
        "assistant order": FINE | {"session_id": "k", "right": [[3, 3]]},
        "user overlap": FINE | {"session_id": "m", "user_vad": [[3, 4], [1, 3.5]]},
        "object": "[1, 2]",
    }
    path = put(tmp_path / "v.jsonl", [FINE, "", *bad.values(), FINE | {"session_id": "twice"}, FINE | {"session_id": "twice", "source": "y"}])
    sessions, intervals, broken = st.strict_vad(spark, path)
    got = {}
    for r in broken.collect():
        got.setdefault(r["session_id"], set()).add(r["rule"])
    for rule, row in bad.items():
        assert rule in got[row["session_id"] if isinstance(row, dict) else None], rule
    assert all(got[r["session_id"]] == {k} for k, r in bad.items() if isinstance(r, dict) and k not in ("session_id",))
    assert got["twice"] == {"unique"} and "fine" not in got
    assert [tuple(r) for r in sessions.collect()] == [("fine", "l", "x", 9.0, False)]
    assert sorted(map(tuple, intervals.collect())) == [("fine", "assistant", 2.0, 3.0), ("fine", "assistant", 3.0, 4.0), ("fine", "user", 0.5, 2.0), ("fine", "user", 4.0, 5.5)]
    with pytest.raises(ValueError, match="speech"):
        st.require_none(broken, "speech")
    st.require_none(broken.where("false"), "speech")


def test_label_lines_have_numbers(spark, tmp_path):
    row = {"episode_id": "e1", "checkpoint_elapsed_s": 0.48, "annotator": "p", "action": "wait", "quality": "clean"}
    lines = [row, "", row | {"action": "Wait"}, "{broken", row | {"annotator": "q", "also_acceptable": ["ack", "hum"]}, row, row | {"annotator": "r", "quality": None}, row | {"annotator": "s", "also_acceptable": ["ack"], "tags": ["t"]}]
    good, broken = st.label_lines(spark, put(tmp_path / "labels.jsonl", lines))
    assert {(r["line"], r["rule"]) for r in broken.collect()} == {(3, "action"), (4, "object"), (5, "also_acceptable"), (6, "repeated"), (7, "quality")}
    assert sorted(r["line"] for r in good.collect()) == [1, 8]


def test_resolving_names(spark, tmp_path):
    for n in ("dc_abc.npy", "candor_xyz:mid180.npy", "xyz.npy", "other.txt"):
        (tmp_path / n).write_bytes(b"1234")
    ids = spark.createDataFrame([("ABC:first60",), ("xyz",), ("candor_xyz:mid180",), ("none",), (None,)], "session_id string")
    got = {r["session_id"]: r["name"] for r in st.resolved(ids, st.named_files(spark, str(tmp_path), ".npy")).collect()}
    assert got == {"ABC:first60": "dc_abc", "xyz": "xyz", "candor_xyz:mid180": "candor_xyz:mid180", "none": None, None: None}


def test_archive(spark):
    rows = [(1, "a", "train", 1.0, 1.0, [1.0, 2.0]), (2, "a", "test", 1.0, 2.0, [1.0, 2.0]), (3, "b", "test", 2.5, 2.0, [1.0, float("nan")]), (4, "c", "train", None, 2.0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "row_id int, lineage_id string, split string, available_at_s double, model_cutoff_s double, x array<double>")
    got = sorted(tuple(r) for r in st.archive_breaks(df, spark.createDataFrame([("a", "train"), ("b", "test")], "lineage_id string, split string"), ["x"]).collect())
    assert got == [(2, "split"), (3, "causal"), (3, "x finite"), (4, "causal"), (4, "split"), (4, "x width")]


def test_natural_order(spark):
    names = ["layer10.w", "layer2.w", "layer2.b", "a", "layer002.a", "layer1"]
    want = ["a", "layer1", "layer002.a", "layer2.b", "layer2.w", "layer10.w"]
    assert [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(st.natural("n")).collect()] == want == sorted(names, key=wt.natural_key)


def test_weights(tmp_path):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(5, 3)), rng.normal(size=3)), (rng.normal(size=(3, 2)), rng.normal(size=2))]
    base = f"file://{tmp_path}/w"
    for name in ("step2", "step10", "step9"):
        wt.save_weights(layers, f"{base}/{name}.npz")
    assert wt.newest(base).endswith("/step10.npz")
    turned = {"model": {f"net.{i}": {"weight": w.T, "bias": b} for i, (w, b) in enumerate(layers)}}
    for got in (wt.load_weights(wt.newest(base), 5), wt.layers_of(turned, 5)):
        assert all((w == v).all() and (b == c).all() for (w, b), (v, c) in zip(got, layers, strict=True))
    for wrong in ({}, {"a.weight": np.ones((2, 2))}, {"a.weight": np.ones((5, 3)), "a.bias": np.ones(4)}, {"a.weight": np.full((5, 3), np.nan), "a.bias": np.ones(3)}):
        with pytest.raises(ValueError):
            wt.layers_of(wrong, 5)


def test_horizons():
    assert st.horizons_of({"a": 3, "horizons": {"H_set": [12, 1, 12]}}) == [1, 12] and st.horizons_of('{"H": 62}') == [62]
    for wrong in ({"H": 0}, {"H": [1.5]}, {"H": True}, {"lambda": 1}):
        with pytest.raises(ValueError):
            st.horizons_of(wrong)


def test_packages(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "package")
    wr.publish_package({"a": df, "b": df}, path)
    assert wr.read_package(spark, path, "b").count() == 3 and (tmp_path / "package" / "READY").exists()
    with pytest.raises(FileExistsError):
        wr.publish_package({"a": df}, path)
    with pytest.raises(ValueError):
        wr.publish_package({"a": df, "no/name": df}, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    with pytest.raises(FileNotFoundError):
        wr.read_package(spark, str(tmp_path), "a")


def test_seeds_and_stand_ins(spark):
    assert pr.stable_seed("a", 1) == pr.stable_seed("a", 1) != pr.stable_seed("a", 2) and 0 <= pr.stable_seed("x") < 1 << 32
    assert sorted(pr.permutation(50, "q")) == list(range(50)) and (pr.permutation(50, "q") == pr.permutation(50, "q")).all()
    f = spark.createDataFrame([("s", 0), ("s", 3)], "session_id string, frame long")
    m = pr.WaveModel(3)
    assert [r["surprise"] for r in pr.surprise(m, m, f).collect()] == [0.0, 0.0]
    e = spark.createDataFrame([("s", "ts", 5), ("t", "ts", 6)], "session_id string, kind string, t_ms long")
    assert pr.TableEvents(e).events(f).count() == 1

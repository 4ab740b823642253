import random

from turnloom.streaming import gate as gt

FRAME = "session_id string, frame long, active boolean, candidate string"


def rows(seed):
    rng = random.Random(seed)
    return [(s, i, rng.random() < 0.2, rng.choice([None, "ack", "ack", "respond"])) for s in "ab" for i in range(150)]


def machine(data, needed=2):
    out = set()
    for s in {r[0] for r in data}:
        g = gt.Gate(needed)
        for _, f, a, c in sorted(r for r in data if r[0] == s):
            out.add((s, f, g.step(f, a, c)))
    return out


def test_batch_equals_machine(spark):
    for needed in (1, 2, 3):
        data = rows(needed)
        assert {tuple(r) for r in gt.gate_batch(spark.createDataFrame(data, FRAME), needed).collect()} == machine(data, needed)


def test_stream_equals_machine(spark, tmp_path):
    data = sorted(rows(9), key=lambda r: r[1])
    for k in range(3):  # micro-batches in the order of time, rows inside in none
        part = data[k * 100 : (k + 1) * 100]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FRAME).parquet(str(tmp_path / "in"))
        q = gt.gate_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == machine(data)


def test_candidates(spark):
    df = spark.createDataFrame([(1, {"wait": 0.9, "ack": 0.6, "respond": 0.6}), (2, {"wait": 1.0}), (3, {"ack": 0.59}), (4, None)], "k int, probabilities map<string, double>")
    assert {r["k"]: r["candidate"] for r in gt.candidates(df).collect()} == {1: "respond", 2: None, 3: None, 4: None}

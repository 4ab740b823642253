from types import SimpleNamespace

import pytest

from turnloom import runtime


def session(master, folder=None):
    found = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, _jsc=jsc))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_folder(session(master))
        assert runtime.shared_folder(session(master, "hdfs://n/scratch/")) == "hdfs://n/scratch"
    assert runtime.shared_folder(session("local[2]")).startswith("file:///")


def test_scratch_is_deleted_through_its_file_system(spark):
    path = runtime.place(spark, "t")
    spark.range(3).write.parquet(path)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    assert there() and path in runtime._tables
    runtime._delete(path, runtime._tables.pop(path))
    assert not there()


def test_times_since_1970_are_usable(spark):
    from turnloom.functions.columns import to_ms

    rows = [(1.7e9,), (-1.7e9,), (2.0005,), (float("nan"),), (float("inf"),), (1e13,), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t double").select(to_ms("t")).collect()] == [1_700_000_000_000, -1_700_000_000_000, 2001, None, None, None, None]

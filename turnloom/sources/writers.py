"""Sinks: series as nested JSON lines, canonical manifests, sealed folders, signed receipts, text tables."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import re
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nested_series(frames: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """One record per session with its values in the order of frames."""
    keys = keys or ["session_id"]
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("frame", value))), lambda s: s.getField(value))
    return frames.groupBy(*keys).agg(ordered.alias(out))


#: Rows of a CSV file at most: a file whose values may hold line ends is read by one task.
FILE_ROWS = 1_000_000


def csv_files(df: DataFrame, path: str) -> None:
    """CSV files with a header, every value quoted and kept as it is; as many files as tasks, more only beyond ``FILE_ROWS``."""
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": True, "escape": '"'}
    df.write.options(header=True, maxRecordsPerFile=FILE_ROWS, **whole).csv(path)


def save_arrays(series: DataFrame, folder: str) -> int:
    """A .npy file with one column per row of ``series`` (name, values), written by the tasks; returns the number of files.

    ``folder`` is a URI of a file system that all executors share (file:, hdfs:, s3:, gs: as pyarrow names them). A file
    is written under a name of its own and moved, so a task that runs again leaves no half file.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in frames:
            for name, x in zip(pdf["name"], pdf["values"], strict=True):
                box = io.BytesIO()
                np.save(box, np.asarray(x, float)[:, None])
                temporary = f"{base}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary) as out:
                    out.write(box.getvalue())
                fs.move(temporary, f"{base}/{name}.npy")
            yield pd.DataFrame({"n": [len(pdf)]})

    return series.select("name", "values").mapInPandas(save, "n long").agg(F.sum("n")).first()[0] or 0


def canonical(df: DataFrame) -> Column:
    """The row as compact JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def manifest(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON lines in one file, sorted; refuses to overwrite. For tables of report size."""
    lines = df.select(canonical(df).alias("value"), *order).repartition(1).sortWithinPartitions(*order).select("value")
    lines.write.mode("errorifexists").text(path)


def publish(df: DataFrame, path: str) -> None:
    """A new folder that readers may trust once its _SUCCESS marker is there; refuses to overwrite."""
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)


READY = "READY"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish_package(parts: dict[str, DataFrame], path: str) -> None:
    """Several tables as one folder with a READY marker written last. Refuses a folder that is there; what failed is taken back."""
    spark = next(iter(parts.values())).sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        raise FileExistsError(path)
    try:
        for name, df in parts.items():
            if not re.fullmatch(r"[A-Za-z0-9_]+", name):
                raise ValueError(f"{name!r} is no name for a part")
            publish(df, f"{path}/{name}")
        fs.create(at(f"{path}/{READY}")).close()
    except Exception:
        fs.delete(at(path), True)
        raise


def read_package(spark: SparkSession, path: str, name: str) -> DataFrame:
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/{READY}")):
        raise FileNotFoundError(f"{path} isn't ready")
    return spark.read.parquet(f"{path}/{name}")


def receipt(body: dict, key: bytes) -> dict:
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return body | {"hmac": hmac.new(key, text.encode(), hashlib.sha256).hexdigest()}


def verified(signed: dict, key: bytes) -> bool:
    body = {k: v for k, v in signed.items() if k != "hmac"}
    return hmac.compare_digest(receipt(body, key)["hmac"], str(signed.get("hmac", "")))


def text_table(rows: list[dict], columns: list[str]) -> str:
    """Fixed-width text of a small report; undefined numbers are a dash."""
    shown = [[("-" if r.get(c) is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows]
    width = [max(len(x) for x in [c, *(row[i] for row in shown)]) for i, c in enumerate(columns)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, width, strict=True)).rstrip() for row in [columns, *shown])


def report_json(df: DataFrame, note: str) -> str:
    """A report-size table as JSON text with a note."""
    return json.dumps({"note": note, "rows": [r.asDict(recursive=True) for r in df.collect()]}, indent=2, default=str)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """PCM 16 bit; samples in [-1, 1], one column per channel."""
    x = np.atleast_2d(samples.T).T
    box = io.BytesIO()
    with wave.open(box, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return box.getvalue()

"""Readers that turn the many shapes of label and series files into the canonical tables. Schema on read, then aliases."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.columns import event_kind, finite, first_of, session_from_file

#: Names under which each role is found, first match first.
SESSION_KEYS = ["session_id", "conversation_id", "uuid", "clip_id", "episode_id", "id"]
LABEL_SESSION_KEYS = [*SESSION_KEYS[:-1], "id", "name"]
KIND_KEYS = ["kind", "event", "type"]
TIME_KEYS = ["t", "time", "t_s", "onset"]
SPEAKER_KEYS = ["speaker", "speakerId", "speaker_id", "spk", "role", "channel", "name"]
START_KEYS = ["start", "start_s", "t_start", "startTime", "start_time", "begin", "onset"]
END_KEYS = ["end", "end_s", "t_end", "endTime", "end_time", "stopTime", "stop_time", "stop", "offset"]
TEXT_KEYS = ["text", "utterance"]
CONTAINER_KEYS = ["turns", "utterances", "segments", "items"]
VAD_KEYS = {"user_vad": "user", "user": "user", "left": "user", "LEFT": "user", "assistant_vad": "assistant", "assistant": "assistant", "agent_vad": "assistant", "right": "assistant", "RIGHT": "assistant"}
NLL_KEYS = ["audio_nll_per_step", "audio_per_step", "nll_audio_per_step", "user_nll_per_step", "user_channel_nll", "nll_per_step", "values", "nll_audio", "audio_nll", "user_nll", "nll"]
SHIFT_KEYS = ["p_shift_per_step", "p_shift", "p(shift)", "vap_p_shift"]
NOW_KEYS = ["p_now_per_step", "p_now", "vap_p_now"]
SURPRISE_KEYS = ["surprise", "jepa_surprise", "values", "mse", "prediction_error"]
DURATION_KEYS = ["duration_s", "duration_sec", "duration", "clip_duration_s", "length_s"]
FRAME_S = 0.08
#: Times from here on can't be seconds of a conversation: the file counts milliseconds.
MS_FROM = 10_000


def json_records(spark: SparkSession, path: str, envelope: str = "records", schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of JSON lines, of one JSON document (object or list) or of an object with a list of ``records``.

    The first line decides: a whole value means lines, anything else one document.
    """
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    try:
        lines = not head or bool(json.loads(head[0][0])) or True
    except ValueError:
        lines = False
    reader = spark.read.option("multiLine", not lines).option("caseSensitive", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if envelope in df.columns and isinstance(df.schema[envelope].dataType, T.ArrayType):
        inner = df.where(F.col(envelope).isNotNull()).select(F.explode(envelope).alias("r")).select("r.*")
        rest = df.where(F.col(envelope).isNull()).drop(envelope)
        df = inner.unionByName(rest, allowMissingColumns=True) if rest.columns else inner
    return df


def _field(struct: Column, kind: T.DataType, aliases: list[str]) -> Column:
    names = kind.fieldNames() if isinstance(kind, T.StructType) else []
    have = [struct.getField(a) for a in aliases if a in names]
    return F.coalesce(*[h.cast("string") for h in have]) if have else F.lit(None).cast("string")


def _number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def gold_events(df: DataFrame) -> DataFrame:
    """session_id, t, kind, speaker from nested ``events`` or flat rows. Rows without a session, kind or time are left out."""
    sid = first_of(df, LABEL_SESSION_KEYS).cast("string")
    out = []
    if "events" in df.columns:
        kind = df.schema["events"].dataType.elementType
        e = df.select(sid.alias("session_id"), F.explode("events").alias("e"))
        out.append(e.select("session_id", _number(_field(F.col("e"), kind, TIME_KEYS)).alias("t"), event_kind(_field(F.col("e"), kind, KIND_KEYS)).alias("kind"), _field(F.col("e"), kind, SPEAKER_KEYS).alias("speaker")))
    if any(k in df.columns for k in KIND_KEYS) and any(k in df.columns for k in TIME_KEYS):
        flat = df.where(F.col("events").isNull()) if "events" in df.columns else df
        speaker = first_of(flat, SPEAKER_KEYS).cast("string")
        out.append(flat.select(sid.alias("session_id"), _number(first_of(flat, TIME_KEYS).cast("string")).alias("t"), event_kind(first_of(flat, KIND_KEYS).cast("string")).alias("kind"), speaker.alias("speaker")))
    if not out:
        raise ValueError("no events and no kind/time columns")
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return rows.dropna(subset=["session_id", "t", "kind"])


def _turns(session: Column, struct: Column | None, kind: T.DataType, df: DataFrame) -> list[Column]:
    pick = (lambda keys: _field(struct, kind, keys)) if struct is not None else (lambda keys: first_of(df, keys).cast("string"))
    return [session.alias("session_id"), F.coalesce(pick(SPEAKER_KEYS), F.lit("unknown")).alias("speaker"), _number(pick(START_KEYS)).alias("start_s"), _number(pick(END_KEYS)).alias("end_s"), F.coalesce(pick(TEXT_KEYS), F.lit("")).alias("text")]


def transcript_turns(df: DataFrame) -> DataFrame:
    """session_id, speaker, start_s, end_s, text from a container of turns or flat rows; rows without two times are left out."""
    sid = first_of(df, LABEL_SESSION_KEYS).cast("string")
    box = next((k for k in CONTAINER_KEYS if k in df.columns), None)
    if box:
        kind = df.schema[box].dataType.elementType
        rows = df.select(sid.alias("_s"), F.explode(box).alias("e"))
        return rows.select(*_turns(F.col("_s"), F.col("e"), kind, rows)).dropna(subset=["start_s", "end_s"])
    return df.select(*_turns(F.coalesce(sid, F.lit("unknown")), None, T.NullType(), df)).dropna(subset=["start_s", "end_s"])


def vad_intervals(df: DataFrame) -> DataFrame:
    """session_id, speaker, start_s, end_s from the channel keys (items are pairs or objects) and a generic list of intervals."""
    sid = F.coalesce(first_of(df, LABEL_SESSION_KEYS).cast("string"), F.lit("unknown"))
    parts = []
    for key, who in VAD_KEYS.items():
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            kind = df.schema[key].dataType.elementType
            rows = df.select(sid.alias("session_id"), F.lit(who).alias("speaker"), F.explode(key).alias("e"))
            ends = [F.get(F.col("e"), i).cast("string") for i in (0, 1)] if isinstance(kind, T.ArrayType) else [_field(F.col("e"), kind, k) for k in (START_KEYS, END_KEYS)]
            parts.append(rows.select("session_id", "speaker", _number(ends[0]).alias("start_s"), _number(ends[1]).alias("end_s")))
    if "intervals" in df.columns:
        kind = df.schema["intervals"].dataType.elementType
        rows = df.select(sid.alias("_s"), F.explode("intervals").alias("e"))
        parts.append(rows.select(*_turns(F.col("_s"), F.col("e"), kind, rows)).drop("text"))
    if not parts:
        raise ValueError("no channel keys and no intervals")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropna(subset=["start_s", "end_s"])


def seconds(turns: DataFrame, file: str = "session_id") -> DataFrame:
    """Times in milliseconds become seconds: a file counts milliseconds if any of its times reaches ``MS_FROM``."""
    w = Window.partitionBy(file)
    top = F.max(F.greatest("start_s", "end_s")).over(w)
    scale = F.when(top >= MS_FROM, 1000.0).otherwise(1.0)
    return turns.withColumn("_k", scale).withColumn("start_s", F.col("start_s") / F.col("_k")).withColumn("end_s", F.col("end_s") / F.col("_k")).drop("_k")


def transcript_csvs(spark: SparkSession, path: str, glob: str = "*.csv", session: str | None = None) -> DataFrame:
    """Turns of all CSV files below a folder (or of one file). Headers are trimmed.

    The session is the file's name, or the column ``session`` of files that hold several (as it stands there, blank too). Milliseconds
    are told from seconds session by session.
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    df = df.select("*", session_from_file(F.col("_metadata.file_name")).alias("_file"))
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])
    rows = df.select(*_turns(F.coalesce(F.col(session), F.lit("")) if session else F.col("_file"), None, T.NullType(), df)).dropna(subset=["start_s", "end_s"])
    return seconds(rows)


def _series(df: DataFrame, keys: list[str]) -> Column:
    """First of the keys that holds at least two values; numbers and one-element lists are aggregates, no series."""
    have = [F.when(F.size(k) >= 2, F.col(k).cast("array<double>")) for k in keys if k in df.columns and isinstance(df.schema[k].dataType, T.ArrayType)]
    return F.coalesce(*have) if have else F.lit(None).cast("array<double>")


def _long(df: DataFrame, values: Column, name: str) -> DataFrame:
    sid = first_of(df, SESSION_KEYS).cast("string")
    duration = F.coalesce(first_of(df, DURATION_KEYS).cast("double"), F.size("_v") * FRAME_S)
    rows = df.withColumn("_v", values).withColumn("_sid", sid).where("_v is not null and _sid is not null")
    each = rows.select(F.col("_sid").alias("session_id"), duration.alias("duration_s"), F.posexplode("_v").alias("frame", "value"))
    return each.select("session_id", F.lit(name).alias("signal_name"), F.col("frame").cast("bigint").alias("frame"), ((F.col("frame") + 1) * FRAME_S).alias("t_end_s"), "value", "duration_s")


def nll_series(df: DataFrame) -> DataFrame:
    return _long(df, _series(df, NLL_KEYS), "nll")


def shift_series(df: DataFrame) -> DataFrame:
    """p_shift where given, else 1 - p_now."""
    now = F.transform(_series(df, NOW_KEYS), lambda x: 1 - x)
    return _long(df, F.coalesce(_series(df, SHIFT_KEYS), now), "p_shift")


def surprise_series(df: DataFrame) -> DataFrame:
    return _long(df, _series(df, SURPRISE_KEYS), "surprise")


def aggregates_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Records that hold no series under any of the keys: what a reader has to reject."""
    return df.where(_series(df, keys).isNull())


def array_files(spark: SparkSession, path: str, keys: list[str], glob: str = "*.np[yz]") -> DataFrame:
    """Vectors and matrices of .npy and .npz files: session_id (file name), row, values. Files are read whole, rows are streamed out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    box = np.load(io.BytesIO(content), allow_pickle=False)
                    key = next((k for k in keys if k in box.files), None)
                    if key is None:
                        raise ValueError(f"{name}: none of {keys}")
                    a = box[key]
                else:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                a = np.atleast_2d(np.asarray(a, float)) if a.ndim < 2 else np.asarray(a, float)
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096]
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(part)), "values": list(part)})

    out = files.select("path", "content").mapInPandas(load, "path string, row bigint, values array<double>")
    return out.select(session_from_file("path").alias("session_id"), "row", "values")


def wav_info(spark: SparkSession, path: str) -> DataFrame:
    """Channels, rate, width and frames of PCM WAV files, from their headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((name, w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes(), len(w.readframes(w.getnframes())) == w.getnframes() * w.getnchannels() * w.getsampwidth()))
            yield pd.DataFrame(rows, columns=["path", "channels", "rate", "width", "frames", "complete"])

    return files.select("path", "content").mapInPandas(load, "path string, channels int, rate int, width int, frames bigint, complete boolean")


#: The fields of a blinded answer and the actions it may name.
ANSWER_FIELDS = ["schema", "protocol_version", "assignment_id", "presentation_id", "annotator_id", "action", "confidence", "also_acceptable", "tags", "acceptable_onset", "quality", "ratable"]
ANSWER_ACTIONS = ["wait", "ack", "respond", "repair", "unratable"]


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _constant(x: str):
    raise ValueError(f"{x} is no JSON number")


def strict_answer(line: str) -> tuple[dict | None, str | None, str | None]:
    """(row, sha256 of the canonical JSON, None) or (None, None, why not). Nothing is coerced, no field may be added."""
    import hashlib

    try:
        if not line.strip():
            raise ValueError("blank row")
        o = json.loads(line, object_pairs_hook=_unique, parse_constant=_constant)
        if not isinstance(o, dict) or set(o) != set(ANSWER_FIELDS):
            raise ValueError("fields differ")
        if not all(isinstance(o[k], str) and o[k].strip() for k in ("assignment_id", "presentation_id", "annotator_id")):
            raise ValueError("ids must be nonempty strings")
        if type(o["confidence"]) is not int or not 1 <= o["confidence"] <= 5:
            raise ValueError("confidence must be a whole number from 1 to 5")
        if type(o["ratable"]) is not bool or o["ratable"] == (o["action"] == "unratable"):
            raise ValueError("ratable and action disagree")
        if o["action"] not in ANSWER_ACTIONS or not isinstance(o["also_acceptable"], list) or len(o["also_acceptable"]) > 1 or not set(o["also_acceptable"]) <= set(ANSWER_ACTIONS):
            raise ValueError("unknown action")
        canonical = json.dumps(o, sort_keys=True, separators=(",", ":"), allow_nan=False)
        return o, hashlib.sha256(canonical.encode()).hexdigest(), None
    except (ValueError, TypeError) as e:
        return None, None, str(e)


def strict_answers(spark: SparkSession, path: str) -> DataFrame:
    """assignment_id, annotator_id, action, confidence, row_sha256, error: one row per line, error where it breaks a rule."""
    lines = spark.read.text(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for line in pdf["value"]:
                o, digest, why = strict_answer(line)
                rows.append((*((o[k] for k in ("assignment_id", "annotator_id", "action", "confidence")) if o else (None,) * 4), digest, why))
            yield pd.DataFrame(rows, columns=["assignment_id", "annotator_id", "action", "confidence", "row_sha256", "error"]).astype({"confidence": "Int32"})

    return lines.mapInPandas(parse, "assignment_id string, annotator_id string, action string, confidence int, row_sha256 string, error string")


def config(text: str, allowed: dict[str, type] | None = None) -> dict:
    """Flat ``key: value`` settings; repeated or unknown keys, wrong types and numbers that aren't finite are errors."""
    out: dict = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, _, raw = line.partition(":")
        key, raw = key.strip(), raw.strip()
        if key in out:
            raise ValueError(f"{key} occurs twice")
        try:
            value = json.loads(raw, parse_constant=_constant)
        except ValueError as e:
            if raw in ("NaN", "Infinity", "-Infinity", ".nan", ".inf", "-.inf"):
                raise ValueError(f"{key} isn't finite") from e
            value = raw
        if allowed is not None and (key not in allowed or not isinstance(value, allowed[key])):
            raise ValueError(f"{key} is unknown or of another type")
        out[key] = value
    return out

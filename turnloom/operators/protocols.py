"""What the plans ask of a model or a source of events, and small stand-ins that need no weights (UDF-03, UDF-05, ML-11)."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EventSource(Protocol):
    """Events of sessions: session_id, kind, t_ms."""

    def events(self, sessions: DataFrame) -> DataFrame: ...


class HiddenStates(Protocol):
    """A vector for every frame: session_id, frame, vec."""

    def hidden(self, frames: DataFrame) -> DataFrame: ...


class TargetVectors(Protocol):
    """The vector a frame is to predict: session_id, frame, target."""

    def targets(self, frames: DataFrame) -> DataFrame: ...


class WaveModel:
    """Vectors that follow from session and frame alone, the same everywhere: sin(phase + frame * (k + 1) / 10)."""

    def __init__(self, width: int = 4) -> None:
        self.width = width

    def _vector(self):
        phase = F.pmod(F.conv(F.substring(F.sha2("session_id", 256), 1, 8), 16, 10).cast("bigint"), F.lit(628)) / 100.0
        return F.array(*[F.sin(phase + F.col("frame") * (k + 1) / 10.0) for k in range(self.width)])

    def hidden(self, frames: DataFrame) -> DataFrame:
        return frames.select("session_id", "frame", self._vector().alias("vec"))

    def targets(self, frames: DataFrame) -> DataFrame:
        return self.hidden(frames).withColumnRenamed("vec", "target")


class TableEvents:
    """Events that are in a table already."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def events(self, sessions: DataFrame) -> DataFrame:
        return self.table.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "kind", "t_ms")


def surprise(model: HiddenStates, target: TargetVectors, frames: DataFrame) -> DataFrame:
    """Mean squared distance of a model's vector and its target, whatever they come from."""
    j = model.hidden(frames).join(target.targets(frames), ["session_id", "frame"])
    square = F.aggregate(F.zip_with("vec", "target", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return j.select("session_id", "frame", (square / F.size("vec")).alias("surprise"))


def stable_seed(*parts: object) -> int:
    """The first four bytes of a sha256 of the parts as a whole number."""
    import hashlib

    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:4], "big")


def permutation(n: int, *parts: object) -> np.ndarray:
    """A permutation by numpy's PCG64 under the stable seed: the same numbers as any other program with that generator."""
    return np.random.Generator(np.random.PCG64(stable_seed(*parts))).permutation(n)

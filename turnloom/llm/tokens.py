"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; it is read once on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts text before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    key = hash(raw)
    if key not in _encoders:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``out`` (bigint) instead of ``text``: the tokens of each whole text; 0 for null and empty texts.

    A column ``out`` that is there already is replaced. The vocabulary (about 1 MB, whatever the data) is broadcast.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = docs.drop(out).select(*[c for c in docs.columns if c not in (text, out)], F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(raw.value).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = [len(encode(t)) if t else 0 for at in range(0, len(texts), 64) for t in texts.slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], out])

    schema = rest.drop("_text").withColumn(out, F.lit(0).cast("bigint")).schema
    return rest.mapInArrow(run, schema)

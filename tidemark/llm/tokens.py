"""Encoding of a whole corpus with a public tokenizer (problem 7).

The vocabulary file is read once on the driver (its size is that of the vocabulary, some 50,000 merges) and travels with
the tasks; texts are encoded where they lie, without a shuffle. Null and empty texts get an empty list. Strings that look
like special tokens are ordinary text. Rows are neither dropped nor joined; other columns can be passed through.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import fresh
from tidemark.llm.bpe import encoder, load_merges

#: Where the public vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes needn't be empty
        column = column.fill_null(b"")
        return _texts(column)
    return text[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``out``, the list of ids of each text."""
    path = vocabulary or os.path.join(TOKENIZERS, BYTE_BPE)
    merges = load_merges(path)
    keep = [c for c in keep if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(merges, path)
        for batch in batches:
            data, offsets = _texts(batch.column(0))
            ids, places = own.encode(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*keep, out])

    kinds = dict(df.dtypes)
    return df.select(F.col(text).alias(fresh([*keep, out], "_text")), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` array<int>"]))


def count_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``out``, the number of tokens of each text (0 for null)."""
    path = vocabulary or os.path.join(TOKENIZERS, BYTE_BPE)
    merges = load_merges(path)
    keep = [c for c in keep if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(merges, path)
        for batch in batches:
            _, places = own.encode(*_texts(batch.column(0)), ids=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(places), pa.int64())], names=[*keep, out])

    kinds = dict(df.dtypes)
    return df.select(F.col(text).alias(fresh([*keep, out], "_text")), *keep).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` bigint"]))

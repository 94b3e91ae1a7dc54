"""Token ids of a whole collection by a public tokenizer (problem 7). The transducer is in bpe.py.

Defined results: null and empty texts have an empty list; blank texts have the tokens of their white space. Every row has
its own result, repeated ones too; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.bpe import tokenizer

#: Ids that a batch of results holds at most, but for a single longer text.
BATCH_IDS = 1 << 21


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "") -> DataFrame:
    """key and ids (array<int>) of each row. path: another tokenizer file of the same kind."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_bytes
        for batch in batches:
            keys, parts, start, held = batch.column(0), [], 0, 0
            for row, value in enumerate(batch.column(1)):
                parts.append(encode(value.as_py()))
                held += len(parts[-1]) >> 2
                if held >= BATCH_IDS or row + 1 == batch.num_rows:
                    ends = np.cumsum([0, *(len(p) >> 2 for p in parts)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(parts)), ids], [key, "ids"])
                    parts, start, held = [], row + 1, 0

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", name: str = "n_tokens", path: str = "") -> DataFrame:
    """docs with the number of tokens in place of the text."""
    rest = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(path).count
        for batch in batches:
            n = pa.array([count(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*(f.name for f in rest), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"{name} bigint"])
    return docs.select(*(F.col(f.name) for f in rest), text).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, key: str = "doc_id", path: str = "") -> DataFrame:
    """key and text of each row of (key, ids), by the incremental decoder."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(path).decode
        for batch in batches:
            texts = [decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")

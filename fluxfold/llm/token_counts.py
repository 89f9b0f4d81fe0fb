"""Operator 5: token counts of texts, without keeping the ids.

Texts are cut at safe boundaries (``tokenizing``) and encoded in batches of about equal bytes
inside an Arrow function that returns lengths only; no shuffle. A null text counts as empty, an
empty one has 0 tokens, repeated rows are counted each, an empty table gives an empty result, and
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import text_slices

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def count_tokens(
    docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fluxfold.llm.tokenizing import encoder

        encode = encoder(tokenizer)
        for batch in text_slices(batches, "text"):
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = encode.count(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(counts, pa.int64()), pa.array(counts > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"],
            )

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(lengths, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("key", key)
    )

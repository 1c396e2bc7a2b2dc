"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

One narrow map over the input partitions, without a shuffle. Batches are cut by bytes, so a batch of
very long texts takes no more memory than one of short texts, and within a batch every text is split
at boundaries that no pre-token spans (see unit_encoder).

Null or empty text: 0 bytes, 0 tokens. Repeated rows each get their own row; an empty table gives an
empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, output, text_sizes
from .unit_encoder import encoder

BATCH_BYTES = 8_000_000


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; tokenizer: path of a tokenizers file on every worker."""
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def lengths(batches):
        import numpy as np

        for batch in by_bytes(batches, "text", batch_bytes):
            _, ends = encoder(tokenizer).encode(batch.column("text"))
            n = np.diff(ends)
            yield output(schema, [batch.column("key"), text_sizes(batch.column("text")), n, n > limit])

    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(lengths, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", id_col)

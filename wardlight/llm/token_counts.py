"""Token counts of whole texts, with a shortcut for words that are one token."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.bpe import ENCODED_BYTES, Encoder, tables
from wardlight.llm.words import sliced


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """A row (key, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    The table of strings that encode alone as one token is proved on the driver (see
    ``bpe.tables``) and sent to the tasks; it is as large as the vocabulary.  A
    pre-token in the table counts 1; the rest is merged once for each task and slice
    that meets it (see ``bpe.Encoder``).  Map-only.

    A null or empty text has 0 bytes and 0 tokens; a null key stays null; repeated
    rows give repeated results; other columns of ``docs`` are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(tables(tokenizer))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(given.value)
        for batch in sliced(batches, most=ENCODED_BYTES):
            per_row, lengths, _, _ = encode(batch["text"])
            upto = np.append(0, np.cumsum(lengths))
            ends = np.append(0, np.cumsum(per_row))
            tokens = upto[ends[1:]] - upto[ends[:-1]]
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("key", key))

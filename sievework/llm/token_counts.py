"""Token counts (operator 1): batch encoding in an Arrow function that returns lengths only.

Each Arrow batch is cut into slices of about `slice_bytes` of text. The units of a slice, cut at safe boundaries (see
`bpe`), are looked up in a bounded table of lengths; those it lacks go to the library's batch encoder in one call, of whose
result only lengths are kept. A very long text is taken in stretches that end at safe boundaries. No
shuffle: the scan's partitions are the work units. Memory of a worker: one Arrow batch, one slice as Python strings and
the bounded table.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids stay as rows of their own;
columns of the input named like a result are replaced, all others pass through.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import by_bytes, trimming, without


def token_length(path: str, slice_bytes: int = 1 << 20):
    """An Arrow function: the number of tokens of each text (null: 0)."""

    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = encoder(path).counts
        for texts in trimming(batches):
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            out: list[int] = []
            for a, b in by_bytes(sizes, slice_bytes):
                out += counts([x or "" for x in texts.slice(a, b - a).to_pylist()])
            yield pa.array(out, pa.int64())

    return F.arrow_udf(lengths, "bigint")


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    out = without(docs, "n_bytes", "n_tokens", "over_limit") if text.lower() not in {"n_bytes", "n_tokens", "over_limit"} else docs
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = out.withColumn("n_bytes", F.octet_length(body).cast("long")).withColumn("n_tokens", token_length(tokenizer)(body))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

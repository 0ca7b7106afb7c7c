"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit.

With h(L) documents of L ids: documents of at least L ids are a suffix sum of h, ids in documents of at least L are a
suffix sum of L*h(L), and the ids that remain when each document is cut at L are the prefix sum of ids below L plus
L times the suffix count. The histogram has a row for each distinct length, whatever the number of documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .common import materialize

#: Lengths are summed in blocks of so many, so that no task holds all of them.
BLOCK = 256


def count_ids(batches, path: str):
    enc = pieces.encoder(path)
    for batch in pieces.released(batches):
        texts = pieces.filled(batch.column(0))
        for a, b in pieces.chunks(texts):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(enc.encode(texts.slice(a, b - a))[1]))], names=["n_tokens"])


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens, n_docs): documents by exact encoded length. Null and empty texts have length 0; an empty table gives no rows."""
    lengths = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(count_ids, path=tokenizer), "n_tokens bigint")
    # Written, since the sums read it twice and its rows cost an encoding of all texts.
    return materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: n_docs, docs_at_least, tokens_at_least, tokens_total, truncated_total (ids kept under limit L), quantile (share of documents of at most L ids)."""
    rows = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_ids", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_ids").alias("_i"))
    later, every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_d", "_i")], F.sum("_d").over(every).alias("_d_all"), F.sum("_i").over(every).alias("tokens_total"))
    within = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(F.broadcast(blocks), "_block").withColumns(
        {"docs_at_least": F.sum("n_docs").over(within) + F.col("_d_after"), "tokens_at_least": F.sum("_ids").over(within) + F.col("_i_after")}
    )
    return sums.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("_d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_d_all")).alias("quantile"),
    )


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents does not exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Ids that remain when each document is cut at any limit, from the next longer and the suffix sums."""
    over = F.col("n_tokens") > limit
    return sums.agg(F.sum(F.when(over, F.lit(limit) * F.col("n_docs")).otherwise(F.col("n_tokens") * F.col("n_docs"))).alias("kept"))

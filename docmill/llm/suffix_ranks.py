"""Prefix doubling in its plain form, over all positions: what operator 5 computes, by the method as it is written down.

A row is a position and its rank among the strings of some length that start at positions. Spark joins each position with the one
``step`` further, sorts the pairs of ranks, and numbers those that occur twice or more in that order; positions whose pair is
unique drop out, for no longer string from there can repeat. After the last round the positions that are left begin a repeated
string of ``length`` bytes.

Every round moves a row of some 30 bytes for each byte of text that isn't unique yet, several times. ``remove_repeats`` therefore
doubles names in arrays and lets only sampled and open positions travel; this form is what tests hold it against, and its
figures are in the README.

Defined cases: null and empty texts and texts under ``length`` bytes have no positions; repeated rows are texts of their own;
an empty table gives an empty result; other columns are ignored. ``row`` numbers the rows of ``docs`` in the order they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import discard, stash, text_of


def positions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row, pos, rank: every position that eight bytes follow; the rank is those bytes as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.bytes_of(batch.column(1))
            for i, j, part, at in tb.blocks(data, offs):
                count = np.maximum(0, np.diff(at) - 7)
                pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = pos + np.repeat(at[:-1], count)
                rank = tb.loads(part)[start].byteswap().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).slice(i, j - i).to_numpy(), count)), pa.array(pos), pa.array(rank)], names=["row", "pos", "rank"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    return numbered.mapInArrow(run, "row long, pos long, rank long")


def repeated_positions(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """row, pos: where a string of ``length`` bytes (8 at least) begins that begins anywhere else, too."""
    ranks, size = stash(positions(docs, text_col), "ranks"), 8
    while size < length:
        step = min(size, length - size)
        further = ranks.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = stash(ranks.join(further, ["row", "pos"]), "rank-pairs")
        twice = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        numbered = stash(twice.orderBy("rank", "next").withColumn("new", F.monotonically_increasing_id()).select("rank", "next", "new"), "new-ranks")
        old, ranks = ranks, stash(pairs.join(numbered, ["rank", "next"]).select("row", "pos", F.col("new").alias("rank")), "ranks")
        for used in (old, pairs, numbered):
            discard(used)
        size += step
    return ranks.join(ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "rank").select("row", "pos")

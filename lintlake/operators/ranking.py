"""Ranks within a key that stay parallel when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def rank_within(df: DataFrame, keys: Sequence[str], blocks: Sequence[tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """Adds ``rank``: the row's place within ``keys`` by ``blocks`` (ascending), then ``order``.

    Rows are numbered inside a (keys, block) piece; the sizes of the earlier pieces are added.
    """
    names = [name for name, _ in blocks]
    pieces = df.withColumns(dict(blocks))
    local = pieces.withColumn("_here", F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order)))
    sizes = pieces.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *names, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return local.join(offsets, [*keys, *names]).select(*df.columns, (F.col("_here") + F.col("_before")).alias("rank"))

"""Connected components of link tables, by alternating star contraction in joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfence.llm.common import stored


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star: nodes move to the smallest id among their neighbours, components stay as they are."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    low = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # m <= a < b
    least = low.groupBy("a").agg(F.min("b").alias("m"))
    moved = low.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _spanned(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, of each task's rows: every node of a part to the smallest there, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_inverse=True)
            a, b = at[: batch.num_rows], at[batch.num_rows :]
            root = np.arange(len(ids))
            while True:  # hook the larger root below the smaller, then shorten the paths
                x, y = root[a], root[b]
                if (x == y).all():
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
            moved = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    return edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).mapInArrow(run, "a bigint, b bigint")


def _ended(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars: each node has one edge down or edges up, not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: numbers) that is not the smallest of its component; root is the smallest.

    Tasks shorten their own rows first; then each round is written to the shared folder. The number of rounds grows as the logarithm
    of the longest chain; the loop ends when all that is left are stars and raises if it does not.
    """
    now = stored(_spanned(edges.where("a <> b")).distinct(), "links")
    for _ in range(most_rounds):
        if _ended(now):
            break
        now = stored(_stars(now), "links")
    else:
        raise RuntimeError("star contraction did not end")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

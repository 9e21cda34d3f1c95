"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type); root is the least node.

    Each round hangs the larger neighbours of a node on its least one, then flattens what hangs below, until every node
    hangs on a root directly; the number of rounds is logarithmic in practice. Least neighbours are pre-aggregated, and
    each round is written to the shared folder. Loops and repeated edges do no harm.
    """
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _flat(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are dealt anew and a busy node's neighbours can be split
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").filter("u <> v").distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _flat(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on anything."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count("*").alias("n"))
    return nodes.filter("ups > 1 or (ups = 1 and n > 1)").isEmpty()

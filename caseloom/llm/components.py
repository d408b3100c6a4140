"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links`` (``u long, v long``) to ``node, root``: every linked node with its component's smallest node.

    Alternates two steps until nothing changes: larger neighbours of a node move to the smallest node it
    sees; then a node and its smaller neighbours move to the smallest of those.  The number of
    rounds grows with the logarithm of a component's diameter.  Minima are partial aggregates and a
    centre with very many neighbours only meets its own minimum in a join that can be split.
    """
    edges = keep(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        # now u > v in every row
        floor = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(floor, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = keep(small.unionByName(floor.select("u", F.col("low").alias("v"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

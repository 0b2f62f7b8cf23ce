"""Connected components of a large edge table by alternating star contractions.

A large-star round links every larger neighbour of a node to the node's smallest
neighbour; a small-star round does the same for the smaller neighbours.  Both keep the
components, and the edges end as one star per component around its smallest node.
Every round is written to the shared folder, so a lost executor costs one round at most.
The minima are partial aggregates, and they are joined back from a written table: a
node with very many neighbours is split by the engine's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import discard, stored


def _star(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """(u, v, least v of u and u itself) of directed links; paths of the scratch tables."""
    least, path = stored(links.groupBy("u").agg(F.min("v").alias("m")), "star_min")
    return links.join(least, "u").select("u", "v", F.least("m", "u").alias("m")), [path]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str]:
    """(node, component) for every node of an edge, component being its smallest node; and the
    scratch path of that table.

    Edges have no direction.  Repeated edges count once; loops and edges with a null end
    are dropped, so nodes without another edge do not appear.  No edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"),
                        (F.col(a).isNull() | F.col(b).isNull()).alias("odd"))
    now, path = stored(ends.where("not odd and u <> v").select("u", "v").distinct(), "star_edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, scratch = _star(both)
        mid, mid_path = stored(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                               .where("u <> v").distinct(), "star_large")
        small, more = _star(mid)
        pairs = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                               F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        done, done_path = stored(pairs.select("e.*").where("u <> v").distinct(), "star_edges")
        discard(spark, path, mid_path, *scratch, *more)
        now, path = done, done_path
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    labels, out = stored(nodes, "components")
    discard(spark, path)
    return labels, out

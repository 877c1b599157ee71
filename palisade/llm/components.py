"""Connected components of a link table, by contraction, without collecting links.

Each round points every vertex at its smallest neighbour, rewrites links to those parents and
drops what became a loop. Vertices are compared by a mixed id (XXH64 of eight bytes is a
bijection), so that chains of neighbouring ids shrink as fast as random ones. Minima are
combined map-side; the joins are plain equi-joins, which adaptive execution splits where a
vertex has very many links.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``links (u, v)`` of longs to ``(vertex, root)``: one row per linked vertex; ``root`` is
    the same for all vertices that links connect. Loops and repeats are allowed, nulls are
    not; no links give no rows."""
    links = saved(links)
    edges = saved(links.select(
        F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b")).where("a <> b").distinct())
    names = saved(
        links.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
        .withColumn("mixed", F.xxhash64("vertex")))
    labels = names.select("vertex", F.col("mixed").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = saved(both.groupBy("a").agg(F.min("b").alias("_m")).select(
            F.col("a").alias("_of"), F.least("a", "_m").alias("_parent")))
        labels = saved(labels.join(parents, labels["root"] == parents["_of"], "left").select(
            "vertex", F.coalesce("_parent", "root").alias("root")))
        at_b = parents.withColumnsRenamed({"_of": "_of_b", "_parent": "_parent_b"})
        edges = saved(
            edges.join(parents, F.col("a") == F.col("_of"))
            .join(at_b, F.col("b") == F.col("_of_b"))
            .select(F.col("_parent").alias("a"), F.col("_parent_b").alias("b"))
            .where("a <> b").distinct())
    return labels

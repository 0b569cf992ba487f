"""Connected components of an edge table, without gathering a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folio_spark.llm.common import salted_join, written


def star(rows: DataFrame) -> DataFrame:
    """``u, v`` rows joined to the least node of each ``u`` and its neighbours."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(rows, least, "u", "v")


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the ``u, v`` edges; the root is the component's least node.

    Alternates two steps until nothing changes: every node's larger neighbours move to its least
    neighbour, then its smaller ones do. The number of rounds grows with the logarithm of the
    component size. Every round is a table in the shared folder; only a digest reaches the driver.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = digest(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = star(down)
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(joined.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, digest(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

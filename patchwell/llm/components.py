"""Connected components as repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` to ``(node, comp)``, comp being the smallest node reachable.

    Each pass points every node to its smallest neighbour, doubles those
    pointers twice, and contracts the edges to what is still apart. All
    aggregates are minima, so a node with very many links is combined before
    the shuffle. An empty table gives an empty table.
    """
    edges = store(edges.filter("a != b").distinct(), "edges")
    ups = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "up")
        for _ in range(2):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("to")), "up").select("node", F.col("to").alias("up"))
        up = store(up, "up")
        ups.append(up)
        ua, ub = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = store(
            edges.join(ua, "a").join(ub, "b").filter("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(),
            "edges",
        )
    if not ups:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    comp = ups[0].select("node", F.col("up").alias("comp"))
    for up in ups[1:]:
        comp = comp.join(up.select(F.col("node").alias("comp"), "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return store(comp, "comp")

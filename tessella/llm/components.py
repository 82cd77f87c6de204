"""Union-find grouping as rounds of joins: no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def _roots(parents: Stash) -> Stash:
    """Pointer jumping over (node, p) until every p is a root."""
    while True:
        up = parents.df.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        jumped = Stash(parents.df.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("moved")), "roots")
        moved = not jumped.df.where("moved").isEmpty()
        parents.drop()
        parents = jumped
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b) of longs: comp is the least node reachable.

    Each round hangs every node below its least neighbour, follows the pointers to the roots
    and contracts the edges to their roots; what is left at least halves per round. A node
    with very many links is one partially aggregated row when grouped, and on the large side
    of the joins, whose other side has one row per node and can be split.
    """
    left = Stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels: Stash | None = None
    while not left.df.isEmpty():
        both = left.df.unionAll(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        roots = _roots(Stash(near, "parents"))
        to = roots.df.select("node", "p")
        if labels is None:
            new = Stash(to.withColumnRenamed("p", "comp"), "labels")
        else:
            new = Stash(labels.df.join(to.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
            labels.drop()
        labels = new
        a = left.df.join(to.select(F.col("node").alias("a"), F.col("p").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("p").alias("rb")), "b")
        rest = Stash(a.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        left.drop()
        roots.drop()
        left = rest
    if labels:
        left.drop()
        return labels.df
    return left.df.select(F.col("a").alias("node"), F.col("b").alias("comp"))

"""Connected components of links between 64-bit vertices, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, root for every vertex of a link; the root is the least vertex of its component.

    Each round hooks every vertex to its least neighbour, shortens the chains twice by
    pointer jumping, and contracts the links; what is left shrinks fast, and a vertex
    with very many links is one aggregate that is combined before the shuffle. Rounds
    are written to the shared folder, so a lost executor costs no more than its round.
    Links of a vertex to itself are ignored; no links give no rows."""
    edges = materialise(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "links")
    known = before = None
    while edges.head(1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("v"), F.least("a", "n").alias("p")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            shorter = materialise(hook.join(up, "p").select("v", F.col("pp").alias("p")), "hooks")
            discard(hook)
            hook = shorter
        if known is None:
            known = hook.select("v", F.col("p").alias("root"))
        else:
            known = known.join(hook.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        known = materialise(known, "roots")
        if before is not None:
            discard(before)
        before = known
        left = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        pairs = edges.join(left, "a").join(right, "b").where("pa <> pb")
        fewer = materialise(pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        discard(edges, hook)
        edges = fewer
    if known is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return known

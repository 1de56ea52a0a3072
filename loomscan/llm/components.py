"""Connected components by alternating star contractions: joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.plans.shared import shared_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours point to the least node of its neighbourhood. edges: u > v."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    # dealt anew, so that adaptive execution can split the rows of a hub in the join below
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")).repartition("u")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label of each node: the least of itself and its neighbours; the edges that are left between labels, once each)."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    label = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")).checkpoint()
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    moved = edges.join(of("u"), "u").join(of("v"), "v").where("label_u <> label_v")
    return label, moved.select(F.greatest("label_u", "label_v").alias("u"), F.least("label_u", "label_v").alias("v")).distinct().checkpoint()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs to (node, component), component the least node reachable; every node of a pair has a row.

    Null ends and self-loops are dropped. No pairs give no rows. One step to the least neighbour first folds dense groups to
    the few edges between their labels. Hot nodes are met by partial aggregates and by joins that adaptive execution can
    split. Each round is cut by a checkpoint in the shared folder; only a count and a sum come to the driver.
    """
    shared_dir(edges.sparkSession)
    given = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    label, now = _contracted(given)
    before = None
    for _ in range(max_rounds):
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before or not after[0]:
            break
        before = after
        now = _star(_star(now, True), False).checkpoint()
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    found = now.select(F.col("u").alias("label"), F.col("v").alias("component"))
    return label.join(found, "label", "left").select("node", F.coalesce("component", "label").alias("component"))

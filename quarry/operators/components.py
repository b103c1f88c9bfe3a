"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges`; the component is its least node.

    Each round takes the least label among a node's neighbours, then follows that label's own
    label once, so the rounds needed grow with the logarithm of a chain's length. Labels are
    aggregated before they are shuffled; nothing but one count of changes reaches the driver.
    Null ends are ignored, loops and repeated edges are harmless, an empty table gives an empty one.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    both = cut(e.union(e.select("b", "a")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = cut(stepped.join(roots, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        changed = jumped.where("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.withColumnRenamed("label", "component")

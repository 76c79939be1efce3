"""Connected components of a large graph by labels that are passed and halved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the smallest node it is connected to.

    Each round sends every edge (u, v) with labels l(u) > l(v) to the root l(u), which takes the least label it is
    offered; labels then jump to their label's label. Sizes of components don't matter: a star of a third of all rows
    is combined before the shuffle, as only minima travel. Self loops make nodes of their own; null ends are left out;
    no edges give no rows. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    labels = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    live = edges.where("u <> v")
    # while an edge joins two labels, the larger label points to the smallest one it meets
    for _ in range(most_rounds):
        hooks = live.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        hooks = cut(hooks, "hooks")
        if hooks.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        # pointers only go down, so they are a forest: jump until each is at its root
        while True:
            second = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = cut(hooks.join(second, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = cut(labels.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        side = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        live = live.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v")).where("u <> v").distinct()
        live = cut(live, "live")
    raise RuntimeError("the components didn't settle")

"""Connected components of a graph given by its links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.llm.shared import cut, drop_cut


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component), as a written table: the smallest node that each node with a link reaches.

    Each round takes the least label among a node's neighbours, hooks every old label to the least
    label that its members have seen, and follows the hooks once more; chains halve their length, so
    rounds grow with the logarithm of the longest path. Null ends and links of a node to itself are
    ignored; an empty graph gives an empty result.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    both = cut(ends.union(ends.select("b", "a")).distinct(), "links")
    now = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node").withColumn("moved", F.lit(True)), "labels")
    for _ in range(most_rounds):
        if now.where("moved").isEmpty():
            break
        seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = now.select("node", "label").join(seen, "node", "left").withColumn("new", F.least("label", "near"))
        hooks = new.groupBy("label").agg(F.min("new").alias("hook"))
        after = new.join(hooks, "label").join(hooks.select(F.col("label").alias("new"), F.col("hook").alias("further")), "new", "left")
        best = F.least("hook", "further", "new")
        out = cut(after.select("node", best.alias("label"), (best < F.col("label")).alias("moved")), "labels")
        drop_cut(now)
        now = out
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    drop_cut(both)
    out = now.select("node", F.col("label").alias("component"))
    out._staged = now._staged
    return out

"""Connected components by label minima and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.llm.shared import discard, written

#: Edges of one node that may meet in one task.
HUB = 2000


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, comp) for the nodes of edges(a, b): comp is the smallest node reachable.

    Each round a node takes the smallest label among its own and its neighbours', then that
    label's own label, so paths shorten by powers of two; rounds go on until nothing changes.
    The edges of a hub are dealt over parts of at most about `hub`, each of which gets the
    hub's label; minima are formed before and after the exchange.  No edges: no rows.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    degree = both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least"))
    nodes = written(degree.select(F.col("a").alias("node"), F.ceil(F.col("n") / hub).cast("int").alias("parts"), F.least("a", "least").alias("comp")), "labels")
    hubs = nodes.where("parts > 1").select(F.col("node").alias("_h"), "parts")
    dealt = written(
        both.join(hubs, F.col("b") == F.col("_h"), "left")
        .select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "dealt",
    )
    discard(both)
    labels = nodes

    def spread(value: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), value - 1))

    while True:
        sent = labels.select(F.col("node").alias("_n"), "comp", spread(F.col("parts")).alias("_part"))
        near = dealt.join(sent, (F.col("b") == F.col("_n")) & (F.col("part") == F.col("_part"))).groupBy("a").agg(F.min("comp").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", "parts", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        tops = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        # Many nodes point at one label: that side is the large one, which a skewed join may split.
        step = written(
            nearer.join(tops, F.col("via") == F.col("up"), "left").select("node", "parts", "old", F.least("via", F.coalesce("top", "via")).alias("comp")), "labels"
        )
        discard(labels)
        labels = step
        if step.where("comp <> old").limit(1).count() == 0:
            discard(dealt)
            out = step.select("node", "comp")
            out.folder = step.folder
            return out

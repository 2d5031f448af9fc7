"""Connected components of links by label hooking and pointer jumping, in joins and aggregates only.

Defined results: links may come in either direction and more than once; a link of a node with itself, or with null, is none; no
links give no rows; columns other than the two are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node that links reach.

    Each round a node takes the smallest label among its neighbours, then that label's own label. No list of neighbours is
    built: a hub is a skewed side of a join, which adaptive execution splits, and a minimum that is combined before the
    shuffle. Labels are written to the shared folder each round, so lineage stays short and a lost executor costs a round.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("to")).where("node != to")
    both = materialize(both.unionByName(both.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), "labels-0")
    turn, n = 0, labels.count()
    while True:
        turn += 1
        near = both.join(sized(labels.select(F.col("node").alias("to"), F.col("root").alias("near")), rows=n), "to").groupBy("node").agg(F.min("near").alias("near"))
        hooked = materialize(labels.join(sized(near, rows=n), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"hooked-{turn}", rows=n)
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(hooked.join(sized(above, rows=n), "root").select("node", "old", F.least("root", "above").alias("root")), f"labels-{turn}", rows=n)
        labels = jumped.select("node", "root")
        if jumped.where("root != old").isEmpty():
            return labels

"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b); equal labels mean connected.

    Each round hooks every node onto its smallest neighbour (a min aggregate, so a hub with many
    links is combined on the map side), follows that pointer once more and contracts the links. At
    least half of the linked nodes vanish per round, so the number of rounds is logarithmic.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        hook = materialize(near.select("node", F.least("node", "m").alias("parent")), "cc-hooks")
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        hook = materialize(hook.join(up, "parent").select("node", F.col("top").alias("parent")), "cc-hooks")
        if labels is None:
            labels = hook.select("node", F.col("parent").alias("label"))
        else:
            step = hook.select(F.col("node").alias("label"), "parent")
            labels = materialize(labels.join(step, "label", "left")
                                 .select("node", F.coalesce("parent", "label").alias("label")), "cc-labels")
        to_a = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
                            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                            "cc-edges")
        if not edges.take(1):
            return labels

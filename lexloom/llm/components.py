"""Connected components of a table of links, by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, s: Scratch, tag: str = "cc") -> DataFrame:
    """links(a, b), long ids, to (id, comp): comp is the smallest id reachable. Only ids that have links are listed.

    Each round gives a node the least label among its neighbours', then that label's own label, so labels spread over
    twice the distance of the round before. A round's tables are written, so no lineage grows.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = s.cut(both, f"{tag}-edges")
    label = s.cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), f"{tag}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(label, edges.b == label.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = s.cut(label.join(near, label.id == near.a).select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("to")), f"{tag}-step{turn}")
        hop = step.select(F.col("id").alias("at"), F.col("to").alias("then"))
        new = s.cut(step.join(hop, step["to"] == F.col("at")).select("id", "was", F.least("to", "then").alias("comp")), f"{tag}-{turn}")
        done = new.filter("comp <> was").isEmpty()
        s.drop(f"{tag}-step{turn}", f"{tag}-{turn - 1}")
        label = new.select("id", "comp")
        if done:
            s.drop(f"{tag}-edges")
            return label

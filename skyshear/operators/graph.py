"""Connected components by least labels, with a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyshear.sources.store import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the least id that is reached) of every node of ``links`` (a, b).

    A round takes the least label among neighbours, then the label of that label,
    so the number of rounds grows with the logarithm of a path's length.
    """
    both = stored(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        better = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        hop = labels.select(F.col("id").alias("at"), F.col("component").alias("further"))
        new = stored(better.join(hop, better["component"] == hop["at"], "left").select("id", F.least("component", "further").alias("component"), "was"), "labels")
        discard(labels)
        labels = new.select("id", "component")
        if new.filter("component < was").isEmpty():
            discard(both)
            return labels

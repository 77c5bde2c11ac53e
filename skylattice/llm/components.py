"""Connected components of a link table, in rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for each id that has a link; links of a
    null id or of an id with itself do not count, repeated ones count once, and no links give no rows.

    Each round every id takes the smallest label among its own, its neighbours' and its label's
    label. Minima are combined before they are shuffled, so a hub with very many links costs
    little, and labels halve their distance to the smallest id from round to round."""
    edges = tk.materialize(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = tk.materialize(spark, edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    before = labels
    while True:
        offered = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("offer"))
        taken = labels.join(offered, labels.id == offered.a, "left").select("id", F.col("component").alias("before"), F.least("component", "offer").alias("now"))
        above = labels.select(F.col("id").alias("above"), F.col("component").alias("jump"))
        jumped = taken.join(above, taken.now == above.above, "left").select("id", "before", F.least("now", F.coalesce("jump", "now")).alias("component"))
        jumped = tk.materialize(spark, jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.where("component <> before").isEmpty():
            tk.discard(spark, edges, before)
            labels.written_to = jumped.written_to
            return labels
        tk.discard(spark, before)
        before = jumped


def joined_components(spark: SparkSession, component: DataFrame, links: DataFrame) -> DataFrame:
    """component (id, component) after further links (a, b): only what they join is worked on."""
    if links.isEmpty():
        return component
    sides = (component.select(F.col("id").alias(f"id_{k}"), F.col("component").alias(f"component_{k}")) for k in "ab")
    mapped = links.select("a", "b")
    for k, side in zip("ab", sides, strict=True):
        mapped = mapped.join(side, F.col(k) == F.col(f"id_{k}"), "left").withColumn(f"component_{k}", F.coalesce(f"component_{k}", k))
    mapped = tk.materialize(spark, mapped.select("a", "b", "component_a", "component_b"), "mapped")
    new = connected_components(spark, mapped.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    new = new.select(F.col("id").alias("component"), F.col("component").alias("joined"))
    ids = mapped.select(F.col("a").alias("id"), F.col("component_a").alias("component")).unionByName(mapped.select(F.col("b").alias("id"), F.col("component_b").alias("component")))
    ids = component.unionByName(ids).distinct().join(new, "component", "left")
    out = tk.materialize(spark, ids.select("id", F.coalesce("joined", "component").alias("component")), "components")
    tk.discard(spark, mapped, component)
    return out

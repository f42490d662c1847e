"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

ROUNDS = 60
#: A node with more than a 1 / HUBS share of all link ends, of which there can't be more than so many, gets its neighbours by broadcast.
HUBS = 100_000


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b): ``comp`` is the smallest node that can be reached.

    Hubs' links are not shuffled by the hub. Each round takes the smallest label among neighbours and then the label of the label, so a path of n links
    needs about log n rounds. Links stay a distributed table; only the number of changed labels comes to the driver.
    """
    spark = links.sparkSession
    both = store.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-links")
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    most = both.count() / HUBS
    hubs = store.written(degree.filter(F.col("n") > max(most, 1000)).select("b"), f"{name}-hubs")
    rest = both
    if hubs.limit(1).count():
        rest, of_hubs = store.written(both.join(F.broadcast(hubs), "b", "left_anti"), f"{name}-links"), store.written(both.join(F.broadcast(hubs), "b"), f"{name}-links")
    label = store.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), name)
    for _ in range(ROUNDS):
        of = label.withColumnRenamed("node", "b")
        met = rest.join(of, "b")
        if rest is not both:
            met = met.unionByName(of_hubs.join(F.broadcast(of.join(F.broadcast(hubs), "b")), "b"))
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("to"))
        up = label.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        new = store.written(step.join(up, "to", "left").select("node", "was", F.least("to", F.coalesce("up", "to")).alias("comp")), name)
        changed = new.filter("was <> comp").limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            return label
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")

"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, hot_limit, join_hot, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two id columns (long, not null), in either direction.  Returns (id, component) for
    the ids that some link has, component being the smallest id that can be reached.

    Each round hooks every node to its smallest neighbour, follows these pointers to their roots, and
    replaces links by links between roots, of which there are at most half as many nodes.  Only
    minima are taken over a node's links, and joins leave the rows of hot nodes and roots where they
    are, so one with very many needs no one task.
    """
    a, b = links.columns
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    labels = None
    while n := edges.count():
        both = edges.union(edges.select("v", "u"))
        parent = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("root")), "roots")
        limit = hot_limit(parent.count())
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("_up"))
            nearer = materialize(join_hot(parent, up, ["root"], limit).select("id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "roots")
            moved = not nearer.filter("_moved").isEmpty()
            done, parent = parent, nearer.select("id", "root")
            forget(done)
            if not moved:
                break
        if labels is None:
            labels = parent.withColumnRenamed("root", "component")
        else:
            moved_on = parent.withColumnRenamed("id", "component")
            labels = join_hot(labels, moved_on, ["component"], hot_limit(labels.count()), "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = materialize(labels, "labels")
        limit = hot_limit(n)
        left = join_hot(join_hot(edges, parent.select(F.col("id").alias("u"), F.col("root").alias("_u")), ["u"], limit), parent.select(F.col("id").alias("v"), F.col("root").alias("_v")), ["v"], limit)
        left = left.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).filter("u <> v").distinct()
        done, edges = edges, materialize(left, "links")
        forget(done)
    if labels is None:
        labels = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels

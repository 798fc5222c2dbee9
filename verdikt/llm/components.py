"""Connected components of an edge table, by hooking and pointer jumping.

In each round every node hooks onto its least smaller neighbour, the trees that
come of it are flattened by doubling, and the edges are contracted to the trees'
roots; edges inside a tree vanish. Rounds go on until no edge is left. Links
and labels stay in tables in the shared scratch folder; the driver only learns
whether rows are left. A node with very many neighbours is met by map-side
minima and by joins that Spark may split, as either side is read from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the least id that it can reach.

    Edges may be repeated, reversed or loops; null ends are dropped. An empty
    table gives no rows.
    """
    saved: list[str] = []

    def save(df: DataFrame, what: str) -> DataFrame:
        saved.append(f"{name}-{what}-{len(saved)}")
        return scratch.save(df, saved[-1])

    def empty(df: DataFrame) -> bool:
        return not df.head(1)

    known = edges.where("a is not null and b is not null and a <> b")
    left = save(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not empty(left):
        parent = save(left.groupBy("a").agg(F.min("b").alias("root")), "parent")
        while True:
            up = parent.select(F.col("a").alias("root"), F.col("root").alias("above"))
            jumped = save(parent.join(up, "root", "left").select("a", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parent")
            parent = jumped.select("a", "root")
            if empty(jumped.where("moved")):
                break
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("a").alias("root"), F.col("root").alias("above"))
            old = labels.join(up, "root", "left").select("a", F.coalesce("above", "root").alias("root"))
            labels = save(old.unionByName(parent.join(labels, "a", "left_anti")), "labels")
        to = parent.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        moved = save(left.join(parent, "a").select(F.col("root").alias("ra"), "b"), "half").join(to, "b", "left").select("ra", F.coalesce("rb", "b").alias("rb"))
        left = save(moved.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = labels.select(F.col("root").alias("a")).distinct().withColumn("root", F.col("a"))
    found = save(labels.unionByName(roots), "labels")
    for table in saved[:-1]:
        scratch.drop(table)
    return found.withColumnRenamed("a", "id")

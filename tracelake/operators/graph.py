"""Walks over trees of parent pointers: closures, chains, depths.

Pointers are doubled: after k rounds each row points 2^k steps up, or at the root of its tree, so that the number of
rounds, each a join of narrow rows, is the logarithm of the depth. Rounds cut their lineage by checkpoint() where a folder
is set. Every node has one parent; rows of a cycle never reach a root and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 40


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def rooted(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node, root, depth (steps to the root) of everything that has a parent; roots are parents that are no one's child."""
    up = edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("up")).distinct()
    up = up.select("node", "up", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done"))
    n = up.count()
    for _ in range(ROUNDS):
        far = up.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("done").alias("__done"))
        up = up.join(far, up["up"] == far["__n"], "left").select("node", F.coalesce("__up", "up").alias("up"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("__n").isNull() | F.col("__done")).alias("done"))
        up = _cut(up)
        # a row is done when the node that it points at has no parent; one that went more steps than there are rows never is
        if not up.filter(~F.col("done") & (F.col("steps") <= n)).limit(1).count():
            break
    return up.filter("done").select("node", F.col("up").alias("root"), F.col("steps").alias("depth"))


def closure(edges: DataFrame, seeds: list[str], child: str = "child", parent: str = "parent") -> DataFrame:
    """Everything below the seeds: node, depth below the nearest seed."""
    # the seeds become roots
    below = rooted(edges.filter(~F.col(child).isin(seeds)), child, parent)
    return below.filter(F.col("root").isin(seeds)).select("node", F.col("depth").cast("int").alias("depth"))


def walk_up(edges: DataFrame, start: str, child: str = "child", parent: str = "parent") -> DataFrame:
    """The chain above a node: node, step. The chain's rows are gathered by doubling: those that 1, 2, 4, .. steps lead to."""
    up = edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("up")).distinct()
    chain = edges.sparkSession.createDataFrame([(start, 0)], "node string, step long")
    jump = up
    for k in range(ROUNDS):
        reached = chain.join(jump, "node").select(F.col("up").alias("node"), (F.col("step") + F.lit(1 << k)).alias("step"))
        if reached.isEmpty():
            break
        chain = _cut(chain.unionByName(reached))
        far = jump.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
        jump = _cut(jump.join(far, jump["up"] == far["__n"]).select("node", F.col("__up").alias("up")))
    return chain.filter("step > 0").select("node", F.col("step").cast("int").alias("step"))


def depths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node, depth from the roots (parents that are no one's child), which are in it with 0."""
    below = rooted(edges, child, parent)
    roots = below.select(F.col("root").alias("node")).distinct().select("node", F.lit(0).alias("depth"))
    return roots.unionByName(below.select("node", F.col("depth").cast("int").alias("depth")))


def preorder(edges: DataFrame, child: str = "child", parent: str = "parent", order: str = "child") -> DataFrame:
    """node, depth, rank: nodes as a tree is printed, each followed by what is below it, children in order. A tree has to
    fit in a group; the path of each node is its ancestors' names, so it is meant for trees that people read."""
    paths = edges.select(F.col(child).alias("node"), F.col(parent).alias("up"), F.array(F.col(order).cast("string")).alias("path"))
    for _ in range(ROUNDS):
        far = paths.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("path").alias("__p"))
        paths = paths.join(far, paths["up"] == far["__n"], "left").select("node", F.when(F.col("__n").isNotNull(), F.col("__up")).otherwise(F.col("up")).alias("up"), F.concat(F.coalesce("__p", F.array().cast("array<string>")), "path").alias("path"), F.col("__n").isNull().alias("done"))
        if paths.filter(~F.col("done")).isEmpty():
            break
        paths = paths.drop("done")
    return paths.select("node", F.size("path").alias("depth"), F.row_number().over(Window.partitionBy("up").orderBy("path")).alias("rank"), F.col("up").alias("root"))

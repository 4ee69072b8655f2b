"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylake.llm.common import written


def forest_roots(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent`` with one smaller parent a node; nodes that are parents only are left out.

    Every round halves the way to the root, so their number grows with the
    logarithm of the deepest tree. Each is written, so a lost executor costs one
    round at most.
    """
    now = written(parents.select("node", F.col("parent").alias("root")), "forest")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(now.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forest")
        now = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return now


def merge_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` after joining the classes of ``roots`` that the links ``a, b`` connect.

    ``roots`` names the least node of each class (nodes alone may be left out).
    In a round every class that is linked to a smaller one is hooked to the
    least of those; rounds go on until no link runs between classes.
    """
    while True:
        if roots is None:
            apart = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
        else:
            of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
            apart = ends.where("x <> y").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("parent"))
        hooks = written(apart.groupBy("node").agg(F.min("parent").alias("parent")), "hooks")
        if hooks.isEmpty():
            return roots if roots is not None else hooks.select("node", F.col("parent").alias("root"))
        hooked = forest_roots(hooks)
        if roots is None:
            roots = hooked
        else:
            moved = roots.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            roots = written(moved.unionByName(hooked.join(roots.select("node"), "node", "left_anti")), "roots")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; ``root`` is the least node of its component.

    No edges give no rows; edges from a node to itself are left out.
    """
    roots = merge_roots(None, edges)
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()

"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long): the root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends, and replaces the links
    by those between ends. The smallest node of a component never hooks away, and every round at least halves the nodes
    that still have links, so a few rounds do. All steps are joins and partially aggregated groupings on tables
    written to shared storage; only the question whether links remain reaches the driver.
    """
    links = keep(links.select("a", "b").filter("a <> b"), "links")
    found = links.selectExpr("a as node").unionByName(links.selectExpr("b as node")).distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        both = links.unionByName(links.selectExpr("b as a", "a as b"))
        hooks = keep(both.groupBy("a").agg(F.min("b").alias("least")).selectExpr("a as node", "least(a, least) as up"), "hooks")
        while True:
            ends = hooks.selectExpr("node as up", "up as further")
            longer = keep(hooks.join(ends, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "hooks")
            hooks = longer.select("node", "up")
            if longer.filter("moved").isEmpty():
                break
        found = keep(
            found.join(hooks.selectExpr("node as root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")),
            "roots",
        )
        a = hooks.selectExpr("node as a", "up as up_a")
        b = hooks.selectExpr("node as b", "up as up_b")
        links = keep(links.join(a, "a").join(b, "b").filter("up_a <> up_b").selectExpr("up_a as a", "up_b as b").distinct(), "links")
    return found

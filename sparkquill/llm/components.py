"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected(links: DataFrame) -> DataFrame:
    """id and the smallest id reachable, for each id of links (u, v: long); ids without a link are absent.

    Every round writes its links to the shared folder and deletes those before; nothing but two sums comes to the driver.
    """
    scratch, n = Scratch(links.sparkSession), 0
    edges = links.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct()
    edges = scratch.stage(edges, "links-0")
    mark = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").where("v > u and v <> m").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(u as u, m as v), struct(v as u, m as v)))").where("u <> v").distinct()
        edges, n = scratch.stage(small, f"links-{n + 1}"), n + 1
        scratch.drop(f"links-{n - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.groupBy("u").agg(F.min("v").alias("component")).unionByName(edges.selectExpr("v u", "v component").distinct()).selectExpr("u id", "component")
        mark = now

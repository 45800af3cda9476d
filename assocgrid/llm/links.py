"""Connected groups from candidate links, without listing all pairs of a group.

Nodes meet under keys. In a star round every node is compared with one hub only: of the smallest
nodes under its keys, the one that it meets most often. Groups found so far make most meetings
needless; what is left, meetings of nodes of different groups, is compared pair by pair. A link
between different groups is thus never lost, and a key that thousands of linked nodes share costs
one comparison for each of them.

A key that more than ``POPULAR`` groups share then, as a passage quoted in many texts, would cost the
square of their number. Where the caller can name other keys of such nodes they meet under these
instead, and under the popular key only if one of them has too few others or popular keys are most
of what they have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assocgrid.storage import materialize

#: Most ids or numbers in a table that is broadcast (up to some 50 MB); larger ones are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Most groups of a key whose nodes are all compared where they can meet under other keys.
POPULAR = 16


def few(table: DataFrame, weight: Column | None = None, bound: int = BROADCAST_IDS) -> DataFrame:
    """``table``, marked for broadcast if its rows, counted by ``weight``, are at most ``bound``."""
    total = table.agg(F.sum(F.lit(1) if weight is None else weight + 1).alias("n")).first()["n"]
    return F.broadcast(table) if (total or 0) <= bound else table


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) of every node of ``edges(a, b)``.

    Every node moves to its smallest neighbour and the graph is contracted, until no edge is left.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(both.filter(F.col("a") != F.col("b")).distinct(), "edges")
    placed = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "placed")
    while not left.isEmpty():
        step = materialize(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).filter(F.col("to") < F.col("a")), "steps")
        # one jump further, where the neighbour moves too
        jump = step.alias("s").join(step.select(F.col("a").alias("via"), F.col("to").alias("end")).alias("t"), F.col("s.to") == F.col("via"), "left")
        step = materialize(jump.select("a", F.coalesce("end", "to").alias("to")), "steps")

        def moved(table: DataFrame, column: str, step: DataFrame = step) -> DataFrame:
            there = step.select(F.col("a").alias("_from"), F.col("to").alias("_to"))
            return table.join(there, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

        placed = materialize(moved(placed, "component"), "placed")
        left = materialize(moved(moved(left, "a"), "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    return placed


def connect(
    spark: SparkSession,
    meetings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    facts: list[str],
    others: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]] | None = None,
    least: int = 1,
    many: int = 1,
    popular: int = POPULAR,
) -> DataFrame:
    """node, component for the nodes of ``meetings(key, node, *facts)`` that have a link.

    ``condition(x, y)`` states from the facts of both sides whether a meeting can be a link;
    ``verify(pairs(a, b))`` returns the pairs that are. ``others(rows)`` returns further meetings of
    the nodes in the rows of popular keys, or those that two nodes share and how many keys ``n`` each ``node`` has in all. Under a popular key two nodes are compared if one of them is
    left with fewer than ``least`` further keys that are not popular, or if both together have ``many``
    popular ones or more. Without ``others`` all rows of a key are compared.
    """
    links = None
    for order in (F.col("node"), F.xxhash64("node")):
        if links is None:
            now = meetings.withColumn("component", F.col("node"))
        else:
            now = located(meetings, components(links))
        hub = F.min_by(F.struct("node", "component", *facts), F.struct(order, F.col("node"))).alias("hub")
        hubs = now.groupBy("key").agg(hub, F.min("component").alias("_low"), F.max("component").alias("_high")).filter(F.col("_low") < F.col("_high"))
        met = now.join(hubs.select(F.col("key").alias("_key"), "hub"), F.col("key") == F.col("_key"))
        met = met.filter((F.col("component") != F.col("hub.component")) & condition(lambda c: F.col(c), lambda c: F.col(f"hub.{c}")))
        shared = met.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        best = shared.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
        found = materialize(verify(materialize(best, "pairs")).select("a", "b"), "links")
        links = found if links is None else materialize(links.union(found), "links")
    grouped = components(links)
    now = materialize(located(meetings, grouped), "meetings")
    open_keys = few(materialize(key_groups(now).filter(F.col("_groups") > 1).select("key", F.col("_groups").alias("groups")), "open-keys"))
    rest = materialize(now.join(open_keys, "key"), "meetings")
    possible = condition(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))

    def across(x: DataFrame, y: DataFrame, apart: Column) -> DataFrame:
        cross = (F.col("x.key") == F.col("y.key")) & apart & possible
        return x.alias("x").join(y.alias("y"), cross).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    lower, apart = F.col("x.component") < F.col("y.component"), F.col("x.component") != F.col("y.component")
    common = None if others is None else materialize(rest.filter(F.col("groups") > popular), "popular")
    if common is None or common.isEmpty():
        pairs = across(rest, rest, lower)
    else:
        names = ["key", "node", *facts, "component"]
        given = others(common)
        further, totals = given if isinstance(given, tuple) else (given, None)
        further = materialize(further.select("key", "node", *facts), "further")
        if totals is None:
            totals = further.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        usual = rest.filter(F.col("groups") <= popular).select(*names)
        usual = materialize(usual.union(located(further, grouped).select(*names)).dropDuplicates(["key", "node"]), "meetings")
        shared = few(materialize(key_groups(usual).filter(F.col("_groups") > 1).withColumnRenamed("_groups", "groups"), "shared-keys"))
        usual = materialize(usual.join(shared, "key"), "meetings")
        again = few(materialize(shared.filter(F.col("groups") > popular).select("key"), "popular-keys"))
        spoilt = further.join(again, "key", "left_semi").groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_spoilt"))
        enough = totals.join(spoilt, F.col("node") == F.col("_node"), "left").filter(F.col("n") - F.coalesce("_spoilt", F.lit(0)) >= least).select("node", F.lit(True).alias("_enough"))
        # how many popular keys a node has, or as many as suffice if it has too few others
        weight = common.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).join(enough, "node", "left")
        weight = weight.select("node", F.when(F.col("_enough"), F.col("_n")).otherwise(F.lit(many)).alias("weight"))
        every = common.select(*names).union(usual.filter(F.col("groups") > popular).select(*names))
        every = materialize(every.join(few(materialize(weight, "weights")), "node", "left").fillna(0, ["weight"]), "popular")
        usual = usual.filter(F.col("groups") <= popular).select(*names)
        heavy = across(every.filter(2 * F.col("weight") >= many), every, apart & (F.col("x.weight") + F.col("y.weight") >= many))
        pairs = across(usual, usual, lower).union(heavy)
    found = verify(materialize(pairs.distinct(), "pairs")).select("a", "b")
    return components(materialize(links.union(found), "links"))


def key_groups(meetings: DataFrame) -> DataFrame:
    """key and the number of components that share it."""
    return meetings.select("key", "component").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_groups")).select("key", "_groups")


def located(meetings: DataFrame, groups: DataFrame) -> DataFrame:
    """``meetings`` with each node's component so far, itself if it has none."""
    there = few(groups.select(F.col("node").alias("_node"), F.col("component").alias("_component")))
    joined = meetings.join(there, F.col("node") == F.col("_node"), "left")
    return joined.withColumn("component", F.coalesce("_component", "node")).drop("_node", "_component")

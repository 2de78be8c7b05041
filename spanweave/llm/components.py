"""Connected components of an edge table, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, staged

#: Tables of two numbers a row are sent to all tasks up to so many rows; beyond that both sides of a join are shuffled.
BROADCAST_ROWS = 500_000


def sent(rows: DataFrame, count: int) -> DataFrame:
    """`rows`, which are `count` at most, for a join: sent to all tasks if they are few."""
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """`rows` with the component of `column` by `names` (node, component), where it has one."""
    found = names.select(F.col("node").alias(column), F.col("component").alias("_component"))
    return rows.join(found, column, "left").withColumn(column, F.coalesce("_component", column)).select(rows.columns)


def _followed(hooks: DataFrame, count: int, label: str) -> DataFrame:
    """`hooks` (node, component) with the end of each node's chain in place of its next node."""
    moved = count
    while moved:
        step = renamed(hooks.select("node", "component", F.col("component").alias("before")), "component", sent(hooks, count))
        step = staged(step.select("node", "component", (F.col("component") < F.col("before")).alias("moved")), label)
        moved = step.filter("moved").count()
        hooks = step.select("node", "component")
    return hooks


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node of `edges` (a, b).

    Each round hooks every node to its smallest neighbour, if that is smaller,
    and follows the hooks to their ends, by jumps that double; the edges then
    join what is left, the nodes without a smaller neighbour, until no edge is
    left.  A round shuffles once, for the smallest neighbours, which are
    aggregated before they are sent, so a hub is never gathered in one task;
    joins shuffle only where the hooks are many.  Null ends, loops and repeated
    edges are ignored; nodes without an edge do not appear.  An empty table
    gives an empty table.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    current, names = staged(ends, label), None
    while True:
        both = current.union(current.select("b", "a"))
        least = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), label)
        hooked = least.filter("component < node").count()
        if not hooked:
            return least if names is None else names
        roots = sent(_followed(least.filter("component < node"), hooked, label), hooked)
        following = staged(renamed(renamed(current, "a", roots), "b", roots).filter("a <> b"), label)
        names = staged(renamed(least.select("node", F.col("node").alias("component")) if names is None else names, "component", roots), label)
        discard(current), discard(least)
        if following.isEmpty():
            return names
        current = following

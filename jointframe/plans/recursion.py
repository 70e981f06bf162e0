"""Walks over trees by pointer doubling.

Recursive SQL is capped in levels and rows per query, and one join per level
takes as many jobs as the deepest tree has levels. Here each round joins a table
with itself and doubles the distance covered, so a chain of a thousand links
takes about ten joins. Rounds are written tables: lineage stays short, and a
lost executor costs one round. Only counts reach the driver.

Nodes are rows of (keys…, node, up); a node has one row inside its keys. ``up``
is the node above, or null below a root.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.plans.ordered import ranked
from jointframe.session import durable


def below_roots(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with ``up`` set to null where it is no node itself."""
    nodes = rows.select(*keys, F.col("node").alias("up"), F.lit(True).alias("_is"))
    return rows.join(nodes, [*keys, "up"], "left").withColumn("up", F.when(F.col("_is"), F.col("up"))).drop("_is")


def _rounds(rows: DataFrame, keys: Sequence[str], above: Mapping[str, str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Double until every walk has come to a root; ``above`` names the columns that are read from the row above.

    A walk of d links ends in round log2(d). As long as some walk will end, the
    nearest of them does so in this round, so a round that ends none leaves only
    cycles and what hangs below them; these have no result.
    """
    table = durable(rows)
    ended, open_ = [table.where("up IS NULL")], table.where("up IS NOT NULL")
    left = open_.count()
    while left:
        everything = reduce(DataFrame.unionByName, [*ended, open_])
        upper = everything.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"), *[F.col(c).alias(a) for c, a in above.items()])
        table = durable(step(open_.join(upper, [*keys, "up"]).drop("up").withColumnRenamed("_next", "up")).select(*rows.columns))
        ended, open_ = [*ended, table.where("up IS NULL")], table.where("up IS NOT NULL")
        before, left = left, open_.count()
        if left == before:
            break
    return reduce(DataFrame.unionByName, ended).drop("up")


def fold_down(rows: DataFrame, keys: Sequence[str], state: Sequence[str], compose: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Column]]) -> DataFrame:
    """(keys…, node, state…) with the states of all nodes from the root down to each node folded into one.

    ``compose(upper, lower)`` gets two functions from a column of the state to
    its value and returns the folded columns; it must be associative.
    """
    def step(joined: DataFrame) -> DataFrame:
        folded = compose(lambda c: F.col(f"_up_{c}"), F.col)
        return joined.select(*keys, "node", "up", *[c.alias(s) for c, s in zip(folded, state, strict=True)])

    return _rounds(rows.select(*keys, "node", "up", *state), keys, {s: f"_up_{s}" for s in state}, step)


def depths(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, node, depth): 1 below a root."""
    counted = rows.select(*keys, "node", "up", F.lit(1).cast("bigint").alias("depth"))
    return fold_down(counted, keys, ["depth"], lambda a, b: [a("depth") + b("depth")])


def path_order(rows: DataFrame, keys: Sequence[str], sibling: str) -> DataFrame:
    """(keys…, node, depth, name): names order nodes of one depth by the siblings on their way down, root first.

    A name stands for the last 2^k siblings; two names in a row, upper first,
    are ranked into the name of twice as many. Nodes of one depth end in the
    same round, so their names can be compared.
    """
    named = rows.join(depths(rows, keys), [*keys, "node"]).select(*keys, "node", "up", "depth", F.col(sibling).cast("bigint").alias("name"))

    def step(joined: DataFrame) -> DataFrame:
        both = durable(joined)
        pairs = both.select(*keys, "depth", "_name", "name").distinct()
        places = ranked(pairs, [*keys, "depth"], ["_name", "name"], "_place")
        return both.join(places, [*keys, "depth", "_name", "name"]).drop("name").withColumnRenamed("_place", "name")

    return _rounds(named, keys, {"name": "_name"}, step)


def all_above(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, node, ancestor, dist) of all strict ancestors of the children of (keys…, parent, child).

    Pairs up to a distance of 2^k, met by the pairs at exactly that distance,
    give those up to twice as far. Nodes on or below a cycle have each ancestor
    once, at the least distance, and never themselves.
    """
    pairs = durable(edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("dist")))
    found, jumps, reach = pairs, pairs, 1
    left = None
    while True:
        farther = found.select(*keys, F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("dist").alias("_more"))
        new = durable(jumps.join(farther, [*keys, "ancestor"]).select(*keys, "node", F.col("_next").alias("ancestor"), (F.col("dist") + F.col("_more")).alias("dist")))
        found, reach = found.unionByName(new), 2 * reach
        jumps = new.where(F.col("dist") == reach)
        before, left = left, jumps.count()
        if not left:
            return found
        if left == before:
            break
    endless = jumps.select(*keys, "node").distinct()
    on_cycles = found.join(endless, [*keys, "node"], "left_semi")
    count = None
    while True:
        once = on_cycles.where("node <> ancestor").groupBy(*keys, "node", "ancestor").agg(F.min("dist").alias("dist"))
        on_cycles = durable(once)
        before, count = count, on_cycles.count()
        if count == before:
            return found.join(endless, [*keys, "node"], "left_anti").unionByName(on_cycles)
        farther = on_cycles.select(*keys, F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("dist").alias("_more"))
        on_cycles = on_cycles.unionByName(on_cycles.join(farther, [*keys, "ancestor"]).select(
            *keys, "node", F.col("_next").alias("ancestor"), (F.col("dist") + F.col("_more")).alias("dist")))

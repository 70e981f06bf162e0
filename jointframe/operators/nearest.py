"""Nearest partners by a pyramid of cells, and boxes that meet by size classes.

Items are axis-aligned boxes, points being boxes without extent. Nothing here
depends on how they are spread: cells halve the ranks of the coordinates, not
their range, so an outlier or two far clusters cost no more than an even field.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.plans.ordered import ranked
from jointframe.session import durable

#: Two cells are compared item by item once they make at most so many pairs.
PAIRS = 1 << 14
#: Bounds are taken this much wider, so that rounding loses no tie.
SLACK = 1e-8


def _cells(items: DataFrame, keys: Sequence[str], side: str, dims: Sequence[str], level: int) -> DataFrame:
    """(keys…, cell, parent, count, bounds of the members) of one level; names end in the side."""
    bounds = [f(f"{side}{p}_{d}").alias(f"{side}{p}_{d}") for p, f in (("lo", F.min), ("hi", F.max)) for d in dims]
    held = items.groupBy(*keys, *_code(side, level)).agg(F.count("*").alias(f"{side}n"), *bounds)
    return held.withColumns({f"{side}pi": F.shiftright(f"{side}i", 1), f"{side}pj": F.shiftright(f"{side}j", 1)})


def _code(side: str, level: int) -> list[Column]:
    """The cell of an item at a level: its ranks along both axes, halved that often."""
    return [F.expr(f"({side}r{x} * {1 << level}L) div _n{side}").alias(f"{side}{c}") for x, c in ((0, "i"), (1, "j"))]


def _apart(dims: Sequence[str], farthest: bool) -> Column:
    """Least distance of two bounds, or the greatest of points in them."""
    total = F.lit(0.0)
    for d in dims:
        ab, ba = F.col(f"ahi_{d}") - F.col(f"blo_{d}"), F.col(f"bhi_{d}") - F.col(f"alo_{d}")
        g = F.greatest(ab, ba) if farthest else F.greatest(-ab, -ba, F.lit(0.0))
        total = total + g * g
    return F.sqrt(total)


def closest(left: DataFrame, right: DataFrame, keys: Sequence[str], dims: Sequence[str], gap: Column, order: Sequence[str], each: bool = True, distinct: bool = False) -> DataFrame:
    """The best pairs (keys…, columns of left and right, dist): of each row of left, or with ``each`` false of each key.

    ``left`` has (keys…, a, alo_<dim>, ahi_<dim>, …), ``right`` the same with b;
    ``gap`` is the distance of a pair of rows, at least that of their boxes and
    at most the greatest of points in them. ``order`` breaks ties among the
    columns of right. With ``distinct`` rows with a = b don't meet.

    Both sides are halved along the ranks of their first two dimensions, level
    by level. A pair of cells whose least distance exceeds what another cell is
    sure to offer is dropped; pairs of few items are compared in full. A key
    whose items make few pairs is one such pair from the start.
    """
    keys, dims = list(keys), list(dims)
    counts = [df.groupBy(*keys).agg(F.count("*").alias(f"_n{s}")) for df, s in ((left, "a"), (right, "b"))]
    sizes = durable(counts[0].join(counts[1], keys))
    few = F.col("_na") * F.col("_nb") <= PAIRS
    small = sizes.where(few).select(*keys)
    leaves = [left.join(small, keys).join(right, keys)]
    large = sizes.where(~few)
    if not large.isEmpty():
        leaves += _descend(left, right, large, keys, dims, each, distinct)
    met = reduce(DataFrame.unionByName, leaves)
    met = met.where("a <> b") if distinct else met
    per = [*keys, "a"] if each else keys
    best = met.withColumn("dist", gap).where("dist IS NOT NULL").groupBy(*per).agg(F.min_by(F.struct(*[c for c in met.columns if c not in per], "dist"), F.struct("dist", *order)).alias("_m"))
    kept = [c for c in [*left.columns, *right.columns] if c not in per]
    return best.select(*per, *[F.col(f"_m.{c}").alias(c) for c in dict.fromkeys(kept)], "_m.dist")


def _descend(left: DataFrame, right: DataFrame, large: DataFrame, keys: list[str], dims: list[str], each: bool, distinct: bool) -> list[DataFrame]:
    """Rows of left and right that are to be compared, one frame for each level that has leaves."""
    sides = {}
    for s, df in (("a", left), ("b", right)):
        rows = df.join(large, keys)
        own = [c for c in df.columns if c not in keys]
        # Rows may repeat an id; all their columns make the order total.
        for x in (0, 1):
            rows = ranked(rows, keys, [f"{s}lo_{dims[x]}", *own], f"{s}r{x}").withColumn(f"{s}r{x}", F.col(f"{s}r{x}") - 1)
        sides[s] = durable(rows)
    cell = {s: [f"{s}i", f"{s}j"] for s in "ab"}
    parent = {s: [F.col(f"{s}pi").alias(f"{s}i"), F.col(f"{s}pj").alias(f"{s}j")] for s in "ab"}
    names = [c for s in "ab" for c in cell[s]]
    open_ = large.select(*keys, *[F.lit(0).cast("long").alias(c) for c in names])
    level, out = 0, []
    while not open_.isEmpty():
        level += 1
        pairs = open_
        for s in "ab":
            below = _cells(sides[s], keys, s, dims, level)
            below = below.select(*keys, *parent[s], *[F.col(c).alias(f"_{c}") for c in cell[s]], *[c for c in below.columns if c not in (*keys, *cell[s], f"{s}pi", f"{s}pj")])
            pairs = pairs.join(below, [*keys, *cell[s]]).drop(*cell[s]).withColumnsRenamed({f"_{c}": c for c in cell[s]})
        sure = F.col("bn") > 1 if each else F.col("an") * F.col("bn") > 1
        most = _apart(dims, True)
        pairs = durable(pairs.select(*keys, *names, (F.col("an") * F.col("bn")).alias("_work"), _apart(dims, False).alias("_lb"), (F.when(sure, most) if distinct else most).alias("_ub")))
        per = [*keys, *cell["a"]] if each else keys
        bound = pairs.groupBy(*per).agg(F.min("_ub").alias("_best"))
        kept = durable(pairs.join(bound, per).where(F.col("_best").isNull() | (F.col("_lb") <= F.col("_best") * (1 + SLACK) + SLACK)).select(*keys, *names, "_work"))
        leaf = kept.where(F.col("_work") <= PAIRS).select(*keys, *names)
        if not leaf.isEmpty():
            a, b = [sides[s].select("*", *_code(s, level)).drop(f"{s}r0", f"{s}r1", "_na", "_nb") for s in "ab"]
            out.append(leaf.join(a, [*keys, *cell["a"]]).join(b, [*keys, *cell["b"]]).drop(*names))
        open_ = kept.where(F.col("_work") > PAIRS).select(*keys, *names)
    return out


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Touching boxes (keys…, a, b, a_/b_ box ends); a box does not meet itself.

    Boxes are (keys…, obj, lo_<axis>, hi_<axis>). The size class of a box is the
    power of two above its floor extent, its cells are as wide, so it covers at
    most four. Boxes of one class meet in these; a box also looks into the cells
    it covers of each coarser class that the other side has. So a giant box
    meets all others once and does not widen their cells. A pair is kept in the
    cell of the low corner of its overlap only.
    """
    keys, x, y = list(keys), *axes[:2]
    ends = [f"{p}_{c}" for p in ("lo", "hi") for c in axes]

    def classed(df: DataFrame, tag: str) -> DataFrame:
        size = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in (x, y)], F.lit(1e-6))
        return df.select(*keys, F.col("obj").alias(tag), *[F.col(e).alias(f"{tag}_{e}") for e in ends], F.ceil(F.log2(size)).cast("int").alias("_own"))

    def celled(df: DataFrame, tag: str) -> DataFrame:
        def span(c: str) -> Column:
            return F.sequence(*[F.floor(F.col(f"{tag}_{p}_{c}") / F.pow(F.lit(2.0), "_level")) for p in ("lo", "hi")])
        return df.withColumn("_i", F.explode(span(x))).withColumn("_j", F.explode(span(y))).drop("_own")

    def looking(df: DataFrame, other: DataFrame, tag: str) -> DataFrame:
        """Boxes in their coarser classes, as far as the other side has them; the classes of a key are a few dozen at most."""
        classes = other.groupBy(*keys).agg(F.collect_set("_own").alias("_classes"))
        up = df.join(classes, keys).withColumn("_level", F.explode(F.filter("_classes", lambda c: c > F.col("_own"))))
        return celled(up.drop("_classes"), tag)

    a, b = classed(left, "a"), classed(right, "b")
    own = {t: celled(df.withColumn("_level", F.col("_own")), t) for t, df in (("a", a), ("b", b))}
    # Of two that both only look into a cell, neither may meet the other there: owners of b stand in both rounds, each looker in its own.
    lefts = own["a"].withColumn("_round", F.lit(0)).unionByName(looking(a, b, "a").withColumn("_round", F.lit(1)))
    rights = own["b"].withColumn("_round", F.explode(F.array(F.lit(0), F.lit(1)))).unionByName(looking(b, a, "b").withColumn("_round", F.lit(0)))
    met = lefts.join(rights, [*keys, "_round", "_level", "_i", "_j"])
    close = F.col("a") != F.col("b")
    for c, i in ((x, "_i"), (y, "_j")):
        close = close & (F.col(i) == F.floor(F.greatest(f"a_lo_{c}", f"b_lo_{c}") / F.pow(F.lit(2.0), "_level")))
    for c in axes:
        close = close & (F.col(f"a_lo_{c}") <= F.col(f"b_hi_{c}")) & (F.col(f"b_lo_{c}") <= F.col(f"a_hi_{c}"))
    return met.where(close).select(*keys, "a", "b", *[f"{t}_{e}" for t in "ab" for e in ends])

"""Vertex aggregates, boxes, normalisation, placement and proximity.

Vertex tables are rows (keys…, x, y, z). Per-group facts are aggregated before
the shuffle and joined back as one row per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.functions import points as pts
from jointframe.functions import scalar as sc
from jointframe.session import durable

AXES = ["x", "y", "z"]
#: Tags of the two draws of a point on a triangle.
DRAWS = ("a", "b")


def xyz(prefix: str = "") -> la.Vec:
    return [F.col(f"{prefix}{a}") for a in AXES]


def centroids(vertices: DataFrame, keys: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """Mean vertex cx, cy, cz per key; listed groups without vertices get the origin."""
    out = vertices.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    if groups is None:
        return out
    return groups.join(out, list(keys), "left").na.fill(0.0, [f"c{a}" for a in AXES])


def boxes(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axis-aligned box lo_x.. hi_z per key."""
    return vertices.groupBy(*keys).agg(
        *[F.min(a).alias(f"lo_{a}") for a in AXES], *[F.max(a).alias(f"hi_{a}") for a in AXES])


def corners(box: DataFrame) -> DataFrame:
    """Eight rows per box: corner number and x, y, z. Bit i of the number picks the high end of axis i."""
    out = box.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return out.withColumns({
        a: F.when(F.shiftright(F.col("corner"), i) % 2 == 1, F.col(f"hi_{a}")).otherwise(F.col(f"lo_{a}"))
        for i, a in enumerate(AXES)
    }).withColumn("corner", F.col("corner").cast("bigint"))


def instance_boxes(vertices: DataFrame, instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box over all placed instances of a mesh.

    ``instances`` has one row per instance with rotation r0..r8 and translation
    t0..t2. Only the eight corners of the mesh box are transformed.
    """
    placed = corners(boxes(vertices, keys)).join(instances, list(keys))
    moved = la.add(la.matvec(la.fields("r", 9), xyz()), la.fields("t", 3))
    return boxes(placed.select(*keys, *[c.alias(a) for c, a in zip(moved, AXES)]), keys)


def normal_frames(vertices: DataFrame, keys: Sequence[str], bound: float = fixed.NORMAL_BOUND) -> DataFrame:
    """Centre mx, my, mz and scale that fit a whole object into ±bound; flat objects keep scale 1 and no shift."""
    box = boxes(vertices, keys)
    extent = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES])
    flat = extent < 1e-8
    return box.select(
        *keys, *[((F.col(f"hi_{a}") + F.col(f"lo_{a}")) / 2).alias(f"m{a}") for a in AXES],
        F.when(flat, 1.0).otherwise(2.0 * bound / extent).alias("scale"), flat.alias("flat"),
    )


#: Columns of a normalisation frame.
FRAME = [*[f"m{a}" for a in AXES], "scale", "flat"]


def normalise(vertices: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    return in_frame(vertices.join(frames, list(keys)), [c for c in vertices.columns if c not in AXES])


def in_frame(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns and x, y, z of rows that carry their frame, in normalised space."""
    return rows.select(*keep, *[
        F.when(F.col("flat"), F.col(a)).otherwise((F.col(a) - F.col(f"m{a}")) * F.col("scale")).alias(a) for a in AXES])


def place(vertices: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices shifted by the visual offset v0..v2, then turned and moved by the link pose.

    Parts without a pose are skipped.
    """
    local = la.add(xyz(), la.fields("v", 3))
    moved = la.add(la.matvec(la.fields("r", 9), local), la.fields("t", 3))
    return vertices.join(poses, list(keys)).select(
        *[c for c in vertices.columns if c not in AXES], *[c.alias(a) for c, a in zip(moved, AXES)])


def recentre(vertices: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices relative to their part centroid, and the centroids as part origins."""
    origin = centroids(vertices, keys)
    shifted = vertices.join(origin, list(keys)).select(
        *[c for c in vertices.columns if c not in AXES], *[(F.col(a) - F.col(f"c{a}")).alias(a) for a in AXES])
    return shifted, origin


def axis_distance(point: la.Vec, origin: la.Vec, direction: la.Vec) -> Column:
    """Distance of a point from a line with unit direction."""
    off = la.sub(point, origin)
    return la.norm(la.sub(off, la.scale(direction, la.dot(off, direction))))


def axis_radius(vertices: DataFrame, moved: DataFrame, axes: DataFrame) -> DataFrame:
    """(obj, joint, radius): farthest vertex of a joint's parts from its axis.

    ``moved`` is (obj, joint, label), ``axes`` has wo0..2, wd0..2 per (obj, joint).
    """
    lines = moved.join(axes, ["obj", "joint"])
    rows = vertices.withColumnRenamed("part", "label").join(lines, ["obj", "label"])
    d = axis_distance(xyz(), la.fields("wo", 3), la.fields("wd", 3))
    return rows.groupBy("obj", "joint").agg(F.max(d).alias("radius"))


def moving_enough(joints: DataFrame, radius: DataFrame, frames: DataFrame,
                  least: float = fixed.MIN_NORMALISED_MOTION) -> DataFrame:
    """Joints whose slide or swept arc in normalised units reaches ``least``.

    The radius is in object units; scaling it is the same as measuring it after normalisation.
    """
    span = F.abs(F.col("upper") - F.col("lower"))
    arc = span * F.coalesce("radius", F.lit(0.0)) * F.col("scale")
    motion = F.when(F.col("type") == "prismatic", span * F.col("scale")).otherwise(arc)
    return (joints.join(radius, ["obj", "joint"], "left").join(frames.select("obj", "scale"), "obj")
            .withColumn("motion", motion).where(F.col("motion") >= least))


def hinge_points(box: DataFrame, kind: str = "rule") -> DataFrame:
    """Hinge hx, hy, hz of a box by its ``rule``: bottom (low z), side or back (high y), else the centre."""
    mid = {a: (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in AXES}
    rule = F.col(kind)
    return box.withColumns({
        "hx": mid["x"],
        "hy": F.when(rule.isin("side", "back"), F.col("hi_y")).otherwise(mid["y"]),
        "hz": F.when(rule == "bottom", F.col("lo_z")).otherwise(mid["z"]),
    })


def sample_counts(triangles: DataFrame, keys: Sequence[str], face: str, most: int | None = None, least: int = 1_000) -> DataFrame:
    """The triangles that ``surface_samples`` puts points on, with their number ``_n``."""
    p, q, s = la.fields("p", 3), la.fields("q", 3), la.fields("s", 3)
    area = la.norm(la.cross(la.sub(q, p), la.sub(s, p))) / 2
    sized = triangles.withColumn("_area", area)
    total = sized.groupBy(*keys).agg(F.sum("_area").alias("_sum"), F.count("*").alias("_faces"))
    ident = [F.col(k) for k in [*keys, face]]
    points = F.greatest(F.col("_faces"), F.lit(least))
    want = (points if most is None else F.least(F.lit(most), points)) * F.try_divide(F.col("_area"), F.col("_sum"))
    n = (F.floor(want) + F.when(sc.uniform(*ident) < want - F.floor(want), 1).otherwise(0)).cast("int")
    return sized.join(total, list(keys)).withColumn("_n", n).where("_n > 0").drop("_area", "_sum", "_faces")


def surface_samples(triangles: DataFrame, keys: Sequence[str], face: str, most: int | None = None,
                    least: int = 1_000, carry: Sequence[str] = ()) -> DataFrame:
    """Points spread over the triangles of each part in proportion to area.

    n = max(faces, least) per part, no more than ``most`` if given. A face gets the whole part of its
    share plus one more with the chance of the fraction; draws are keyed, so
    reruns give the same points. Triangle corners are p0..2, q0..2, s0..2. The points keep the columns ``carry``.
    """
    return drawn_points(sample_counts(triangles, keys, face, most, least), keys, face, carry)


def drawn_points(counted: DataFrame, keys: Sequence[str], face: str, carry: Sequence[str] = ()) -> DataFrame:
    """The points on triangles that carry their number."""
    p, q, s = la.fields("p", 3), la.fields("q", 3), la.fields("s", 3)
    # A face makes many points, so tasks are not to be joined to few by the bytes of the faces.
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counted.repartition(tasks, *keys, face).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    u, v = [sc.uniform(*[F.col(k) for k in [*keys, face]], F.col("_i"), F.lit(t)) for t in DRAWS]
    a, b = F.when(u + v > 1, 1 - u).otherwise(u), F.when(u + v > 1, 1 - v).otherwise(v)
    point = la.add(p, la.add(la.scale(la.sub(q, p), a), la.scale(la.sub(s, p), b)))
    return rows.select(*keys, *carry, *[c.alias(n) for c, n in zip(point, AXES)])


def drawn_in_frame(counted: pa.Table, idents: pa.Array, frame: dict) -> tuple[np.ndarray, np.ndarray]:
    """``in_frame`` of ``drawn_points`` inside a task, of triangles with the texts of their keys in one frame: each point's triangle, and x, y, z as rows of an array."""
    row, (u, v) = pts.uniforms(idents, counted.column("_n").to_numpy().astype(np.int64), DRAWS)
    over = u + v > 1
    a, b = np.where(over, 1 - u, u), np.where(over, 1 - v, v)
    out = np.empty((3, len(row)))
    for i, axis in enumerate(AXES):
        p, q, s = [counted.column(f"{c}{i}").to_numpy() for c in "pqs"]
        out[i] = p[row] + ((q - p)[row] * a + (s - p)[row] * b)
        if not frame["flat"]:
            out[i] = (out[i] - frame[f"m{axis}"]) * frame["scale"]
    return row, out


def _cells(points: DataFrame, size: float, names: Sequence[str]) -> DataFrame:
    return points.withColumns({n: F.floor(F.col(a) / size) for n, a in zip(names, AXES)})


#: Keys with at most so many points on the right are met point by point.
FEW = 1 << 10


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, threshold: float, only: str = "true") -> DataFrame:
    """Distinct (keys…, a, b) with some points of a and b closer than the threshold; ``only`` is a condition on keys, a and b.

    Points of keys with few points meet in slabs along x, by one exchange of
    each side; a point then meets ``FEW`` others at most. Keys with more
    points meet as cells first.
    """
    left, right = left.select(*keys, a, *AXES), durable(right.select(*keys, b, *AXES).distinct())
    large = durable(right.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*keys))
    if large.isEmpty():
        return _near_in_slabs(left, right, keys, a, b, threshold, only)
    left = durable(left)
    few, many = [[df.join(large, list(keys), kind) for df in (left, right)] for kind in ("left_anti", "left_semi")]
    return _near_in_slabs(*few, keys, a, b, threshold, only).unionByName(near_in_cells(*many, keys, a, b, threshold, only))


def _touched(c: str, threshold: float) -> Column:
    """The slabs of twice the threshold that a ball of it touches, two at most."""
    return F.explode(F.sequence(*[F.floor((F.col(c) + s * threshold) / (2 * threshold)) for s in (-1, 1)]))


def _near_in_slabs(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, threshold: float, only: str) -> DataFrame:
    spread = right.select(*keys, b, *[F.col(x).alias(f"r{x}") for x in AXES]).withColumn("_i", _touched("rx", threshold))
    gap = la.sub(xyz(), xyz("r"))
    met = _cells(left, 2 * threshold, ["_i"]).join(spread, [*keys, "_i"])
    return met.where(F.expr(only) & (la.dot(gap, gap) < threshold * threshold)).select(*keys, a, b).distinct()


def near_in_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, threshold: float, only: str = "true",
                  among: DataFrame | None = None) -> DataFrame:
    """The pairs of ``near_pairs``, or those of (keys…, a, b) in ``among``.

    Points that share a cell with a diagonal below the threshold settle their
    pair: there only cell occupancies meet, never points. All other pairs are
    compared over cells of twice the threshold, each right point in the few
    cells its ball touches: occupancies of these cells meet first and leave out
    what is settled, then points of the open pairs meet in their shared cells.
    Right points are dealt to several cells, so the right side should be the small one.
    """
    fine = threshold / math.sqrt(3) * (1 - 1e-9)
    cell = ["_i", "_j", "_k"]
    settled = (
        _cells(left, fine, cell).select(*keys, a, *cell).distinct()
        .join(_cells(right, fine, cell).select(*keys, b, *cell).distinct(), [*keys, *cell])
        .where(only).select(*keys, a, b).distinct()
    )
    open_ = among
    if among is not None:
        settled = durable(among.join(settled, [*keys, a, b], "left_semi"))
        open_ = durable(among.join(settled, [*keys, a, b], "left_anti"))
    # A ball of the threshold around a right point touches at most two cells of twice its width per axis.
    wide, spread = 2 * threshold, right.select(*keys, b, *[F.col(x).alias(f"r{x}") for x in AXES])
    for x, c in zip(AXES, cell):
        spread = spread.withColumn(c, _touched(f"r{x}", threshold))
    near, far = _cells(left, wide, cell), spread
    unsettled = (
        near.select(*keys, a, *cell).distinct()
        .join(far.select(*keys, b, *cell).distinct(), [*keys, *cell]).where(only)
    )
    unsettled = unsettled.join(settled, [*keys, a, b], "left_anti") if open_ is None else unsettled.join(open_, [*keys, a, b], "left_semi")
    gap = la.sub(xyz(), xyz("r"))
    checked = (
        near.join(unsettled, [*keys, a, *cell]).join(far, [*keys, b, *cell])
        .where(la.dot(gap, gap) < threshold * threshold)
        .select(*keys, a, b).distinct()
    )
    return settled.unionByName(checked)


def stride_sample(points: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Every (n // most)-th point of a group that has more than ``most`` points."""
    from jointframe.plans.ordered import ranked

    numbered = ranked(points, keys, order, "_rn")
    size = numbered.groupBy(*keys).agg(F.max("_rn").alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    return numbered.join(size, list(keys)).where(
        (F.col("_n") <= most) | ((F.col("_rn") - 1) % step == 0)).drop("_rn", "_n")

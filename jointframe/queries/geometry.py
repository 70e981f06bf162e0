"""Geometry queries over vertices, boxes and joints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe.functions import linalg as la
from jointframe.operators import geometry as geo
from jointframe.operators import kinematics as kin
from jointframe.queries import sqltext as sx
from jointframe.queries.kinematics import _POSE_CTE, _R, _T, CLOSURE_SQL
from jointframe.registry import query
from jointframe.session import Tables

V, J, P = ad.vertices.sql, ad.joints.sql, ad.parts.sql
PART = ["obj", "part"]


def rounded(cols, digits: int = 5):
    return [(F.round(c, digits) + 0.0).alias(c) for c in cols]


def rsql(exprs, names, digits: int = 5) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in zip(exprs, names))


@query("A01", f"""
WITH c AS (SELECT obj, part, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {V} GROUP BY obj, part)
SELECT p.obj, p.label AS part, {rsql([f"coalesce({c}, 0)" for c in ("cx", "cy", "cz")], ("cx", "cy", "cz"))}
FROM {P} p LEFT JOIN c ON c.obj = p.obj AND c.part = p.label""")
def part_centroid(t: Tables) -> DataFrame:
    groups = ad.parts(t).select("obj", F.col("label").alias("part"))
    return geo.centroids(ad.vertices(t), PART, groups).select(*PART, *rounded(["cx", "cy", "cz"]))


BOX_SQL = ", ".join(f"{f}({a}) AS {p}_{a}" for p, f in (("lo", "min"), ("hi", "max")) for a in geo.AXES)


@query("A02", f"SELECT obj, part, {BOX_SQL} FROM {V} GROUP BY obj, part")
def part_bbox(t: Tables) -> DataFrame:
    return geo.boxes(ad.vertices(t), PART)


@query("A02 X23", f"""
WITH b AS (SELECT obj, {BOX_SQL} FROM {V} GROUP BY obj)
SELECT obj, CAST(c AS BIGINT) AS corner, {", ".join(f"CASE WHEN (c >> {i}) & 1 = 1 THEN hi_{a} ELSE lo_{a} END AS {a}" for i, a in enumerate(geo.AXES))}
FROM b, range(8) r(c)""")
def bbox_corners(t: Tables) -> DataFrame:
    return geo.corners(geo.boxes(ad.vertices(t), ["obj"])).select("obj", "corner", "x", "y", "z")


_FRAME_SQL = f"""
fb AS (SELECT obj, {BOX_SQL} FROM {V} GROUP BY obj),
fe AS (SELECT *, greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z) AS ext FROM fb),
f AS (SELECT obj, (hi_x + lo_x) / 2 AS mx, (hi_y + lo_y) / 2 AS my, (hi_z + lo_z) / 2 AS mz, ext < 1e-8 AS flat,
  CASE WHEN ext < 1e-8 THEN 1.0 ELSE 2.0 * 0.95 / ext END AS scale FROM fe)"""


@query("A03", f"WITH {_FRAME_SQL} SELECT obj, mx, my, mz, round(scale, 8) AS scale, flat FROM f")
def normal_frame(t: Tables) -> DataFrame:
    return geo.normal_frames(ad.vertices(t), ["obj"]).withColumn("scale", F.round("scale", 8))


@query("A03", f"""WITH {_FRAME_SQL}
SELECT v.obj, v.part, v.ord1, v.ord2, v.ord3, v.ord4,
  {rsql([f"CASE WHEN flat THEN v.{a} ELSE (v.{a} - m{a}) * scale END" for a in geo.AXES], geo.AXES, 6)}
FROM {V} v JOIN f USING (obj)""")
def normalise_object(t: Tables) -> DataFrame:
    v = ad.vertices(t)
    out = geo.normalise(v, geo.normal_frames(v, ["obj"]), ["obj"])
    return out.select(*PART, "ord1", "ord2", "ord3", "ord4", *rounded(geo.AXES, 6))


INSTANCES = ("obj", "part", "r", "t")


@query("A04", f"""
WITH b AS (SELECT obj, part, {BOX_SQL} FROM {V} GROUP BY obj, part),
c AS (SELECT obj, part, {", ".join(f"CASE WHEN (c >> {i}) & 1 = 1 THEN hi_{a} ELSE lo_{a} END AS {a}" for i, a in enumerate(geo.AXES))}
      FROM b, range(8) r(c)),
i AS (SELECT DISTINCT obj, label AS part, k, k * 0.5 AS ang FROM {J}, range(3) q(k)),
m AS (SELECT c.obj, c.part, cos(ang) * x - sin(ang) * y + k AS x, sin(ang) * x + cos(ang) * y - k AS y, z + 2 * k AS z
      FROM c JOIN i USING (obj, part))
SELECT obj, part, {rsql([f"{f}({a})" for f in ("min", "max") for a in geo.AXES], [f"{p}_{a}" for p in ("lo", "hi") for a in geo.AXES])}
FROM m GROUP BY obj, part""")
def instance_bbox(t: Tables) -> DataFrame:
    """Boxes over three turned and shifted instances per part."""
    k = F.col("k").cast("double")
    turn = [F.cos(k * 0.5), -F.sin(k * 0.5), F.lit(0.0), F.sin(k * 0.5), F.cos(k * 0.5), F.lit(0.0),
            F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    inst = ad.parts(t).select("obj", F.col("label").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    inst = inst.select(*PART, *[c.alias(f"r{i}") for i, c in enumerate(turn)],
                       *[c.alias(f"t{i}") for i, c in enumerate([k, -k, 2 * k])])
    return geo.instance_boxes(ad.vertices(t), inst, PART).select(
        *PART, *rounded([f"{p}_{a}" for p in ("lo", "hi") for a in geo.AXES]))


_AXIS_SQL = f"""
ax AS (SELECT j.obj, j.joint, j.type, j.lower, j.upper,
  {sx.named(sx.add([f"coalesce(w.t{i}, 0)" for i in range(3)], sx.matvec([f"coalesce(w.r{i}, {v})" for i, v in enumerate(la.IDENTITY)], sx.of("j", ["o0", "o1", "o2"]))), ["wo0", "wo1", "wo2"])},
  {sx.named(sx.matvec([f"coalesce(w.r{i}, {v})" for i, v in enumerate(la.IDENTITY)], sx.of("j", ["ax0", "ax1", "ax2"])), ["wd0", "wd1", "wd2"])}
 FROM {J} j LEFT JOIN w ON w.obj = j.obj AND w.link = j.parent)"""
# CLOSURE_SQL and _POSE_CTE both open with WITH RECURSIVE; the second continues the first list.
GEOMETRY_CTE = CLOSURE_SQL + ", " + _POSE_CTE.replace("WITH RECURSIVE", "") + ", " + _AXIS_SQL
_RAD = """
rad AS (SELECT m.obj, m.joint, max(sqrt(greatest(
    (v.x-wo0)*(v.x-wo0) + (v.y-wo1)*(v.y-wo1) + (v.z-wo2)*(v.z-wo2)
    - ((v.x-wo0)*wd0 + (v.y-wo1)*wd1 + (v.z-wo2)*wd2) * ((v.x-wo0)*wd0 + (v.y-wo1)*wd1 + (v.z-wo2)*wd2), 0))) AS radius
  FROM moved m JOIN ax ON ax.obj = m.obj AND ax.joint = m.joint JOIN {V} v ON v.obj = m.obj AND v.part = m.label
  GROUP BY m.obj, m.joint)""".replace("{V}", V)


def joint_axes(t: Tables) -> DataFrame:
    joints = ad.joints(t)
    return kin.world_axes(joints, kin.world_transforms(joints, ["obj"]), ["obj"])


@query("A05", f"{GEOMETRY_CTE}, {_RAD} SELECT obj, joint, round(radius, 5) AS radius FROM rad")
def axis_radius(t: Tables) -> DataFrame:
    moved = kin.descendant_parts(ad.joints(t), ["obj"])
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    return geo.axis_radius(ad.vertices(t), moved, axes).withColumn("radius", F.round("radius", 5))


@query("P08", f"""{GEOMETRY_CTE}, {_RAD}, {_FRAME_SQL}
SELECT j.obj, j.joint, round(CASE WHEN j.type = 'prismatic' THEN (j.upper - j.lower) * scale
   ELSE (j.upper - j.lower) * coalesce(radius, 0) * scale END, 5) AS motion
FROM {J} j JOIN f USING (obj) LEFT JOIN rad ON rad.obj = j.obj AND rad.joint = j.joint
WHERE j.type <> 'fixed' AND abs(j.upper - j.lower) >= 1e-6
  AND CASE WHEN j.type = 'prismatic' THEN abs(j.upper - j.lower) * scale ELSE abs(j.upper - j.lower) * coalesce(radius, 0) * scale END >= 0.1""")
def normalised_motion(t: Tables) -> DataFrame:
    v, joints = ad.vertices(t), ad.joints(t)
    moved = kin.descendant_parts(joints, ["obj"])
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    radius = geo.axis_radius(v, moved, axes)
    out = geo.moving_enough(kin.movable(joints, ["obj"]), radius, geo.normal_frames(v, ["obj"]))
    return out.select("obj", "joint", F.round("motion", 5).alias("motion"))


@query("A01b X03", f"""{_POSE_CTE},
pl AS (SELECT v.obj, v.part, v.ord1, v.ord2, v.ord3, v.ord4,
  {sx.named(sx.add(sx.matvec(sx.of("w", _R), ["(v.x + 0.5)", "(v.y - 0.25)", "v.z"]), sx.of("w", _T)), geo.AXES)}
  FROM {V} v JOIN w ON w.obj = v.obj AND w.link = concat('l_', CAST(v.part AS STRING))),
c AS (SELECT obj, part, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pl GROUP BY obj, part)
SELECT obj, part, ord1, ord2, ord3, ord4, {rsql(["x - cx", "y - cy", "z - cz"], geo.AXES, 4)} FROM pl JOIN c USING (obj, part)""")
def place_and_recentre(t: Tables) -> DataFrame:
    poses = kin.world_transforms(ad.joints(t), ["obj"]).withColumn("part", F.regexp_extract("link", "([0-9]+)$", 1).cast("bigint")).drop("link")
    poses = poses.withColumns({"v0": F.lit(0.5), "v1": F.lit(-0.25), "v2": F.lit(0.0)})
    shifted, _ = geo.recentre(geo.place(ad.vertices(t), poses, PART), PART)
    return shifted.select(*PART, "ord1", "ord2", "ord3", "ord4", *rounded(geo.AXES, 4))


@query("X09", f"""
WITH b AS (SELECT obj, part, {BOX_SQL} FROM {V} GROUP BY obj, part)
SELECT obj, part, (lo_x + hi_x) / 2 AS hx,
  CASE WHEN part % 4 IN (1, 2) THEN hi_y ELSE (lo_y + hi_y) / 2 END AS hy, CASE part % 4 WHEN 0 THEN lo_z ELSE (lo_z + hi_z) / 2 END AS hz FROM b""")
def hinge_points(t: Tables) -> DataFrame:
    rule = F.element_at(F.array(*[F.lit(r) for r in ("bottom", "side", "back", "centre")]), (F.col("part") % 4 + 1).cast("int"))
    return geo.hinge_points(geo.boxes(ad.vertices(t), PART).withColumn("rule", rule)).select(*PART, "hx", "hy", "hz")


@query("J12", f"""
SELECT DISTINCT a.obj, a.part AS a, b.part AS b FROM {V} a JOIN {V} b
  ON a.obj = b.obj AND a.part < b.part AND abs(a.x - b.x) < 1.5
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1.5 * 1.5""")
def proximity_pairs(t: Tables) -> DataFrame:
    """Parts of an object with points closer than 1.5."""
    v = ad.vertices(t).select("obj", "part", *geo.AXES).distinct()
    left = v.select("obj", F.col("part").alias("a"), *geo.AXES)
    right = v.select("obj", F.col("part").alias("b"), *geo.AXES)
    return geo.near_pairs(left, right, ["obj"], "a", "b", 1.5, "a < b")


@query("O09", f"""
WITH r AS (SELECT obj, part, ord1, ord2, ord3, ord4, row_number() OVER (PARTITION BY obj ORDER BY ord1, ord2, ord3, ord4, ord5, x, y, z) AS rn,
  count(*) OVER (PARTITION BY obj) AS n FROM {V})
SELECT obj, part, ord1, ord2, ord3, ord4 FROM r WHERE n <= 50 OR (rn - 1) % greatest(CAST(floor(n / 50) AS BIGINT), 1) = 0""")
def stride_subsample(t: Tables) -> DataFrame:
    out = geo.stride_sample(ad.vertices(t), ["obj"], ad.VERTEX_ORDER, 50)
    return out.select("obj", "part", "ord1", "ord2", "ord3", "ord4")


@query("P36", f"""
SELECT obj, part, 'mesh_without_part' AS problem FROM (SELECT DISTINCT obj, part FROM {V}) v
  WHERE NOT EXISTS (SELECT 1 FROM {P} p WHERE p.obj = v.obj AND p.label = v.part AND NOT contains(p.movement, 'frame'))
UNION ALL
SELECT obj, label, 'part_without_mesh' FROM {P} p WHERE NOT contains(movement, 'frame')
  AND NOT EXISTS (SELECT 1 FROM {V} v WHERE v.obj = p.obj AND v.part = p.label)""")
def orphan_parts(t: Tables) -> DataFrame:
    """Meshes whose part is not described (frame parts are left out of the description), and the reverse."""
    described = ad.parts(t).where("NOT contains(movement, 'frame')").select("obj", F.col("label").alias("part"))
    meshes = ad.vertices(t).select("obj", "part").distinct()
    return meshes.join(described, PART, "left_anti").withColumn("problem", F.lit("mesh_without_part")).unionByName(
        described.join(meshes, PART, "left_anti").withColumn("problem", F.lit("part_without_mesh")))

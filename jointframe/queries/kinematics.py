"""Kinematic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe.functions import linalg as la
from jointframe.operators import kinematics as kin
from jointframe.queries import sqltext as sx
from jointframe.registry import query
from jointframe.session import Tables

KEYS = ["obj"]

# Parts under each joint, as SQL over the heap of every object.
CLOSURE_SQL = f"""
WITH RECURSIVE e AS (SELECT * FROM {ad.joints.sql}),
up(obj, node, anc, dist) AS (
  SELECT obj, child, parent, 1 FROM e
  UNION ALL SELECT up.obj, up.node, e.parent, up.dist + 1 FROM up JOIN e ON e.obj = up.obj AND e.child = up.anc),
own AS (SELECT obj, child AS node, child AS link FROM e UNION ALL SELECT obj, node, anc FROM up),
moved AS (SELECT e.obj, e.joint, e.type, e.lower, e.upper, CAST(substr(own.node, 3) AS BIGINT) AS label
          FROM e JOIN own ON own.obj = e.obj AND own.link = e.child)
"""

GEO_EDGES_SQL = """(
  SELECT concat('R', CAST(r_regionkey AS STRING)) AS child, 'world' AS parent FROM region
  UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)) FROM nation
  UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)) FROM supplier
  UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), concat('N', CAST(c_nationkey AS STRING)) FROM customer)"""


def geo_edges(t: Tables) -> DataFrame:
    """One tree over all regions, nations, suppliers and customers: few, very hot inner nodes."""
    def name(letter: str, col: str):
        return F.concat(F.lit(letter), F.col(col).cast("string"))

    return (
        t.region.select(name("R", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
        .union(t.nation.select(name("N", "n_nationkey"), name("R", "n_regionkey")))
        .union(t.supplier.select(name("S", "s_suppkey"), name("N", "s_nationkey")))
        .union(t.customer.select(name("C", "c_custkey"), name("N", "c_nationkey")))
    )


@query("J02 J03 A28", f"""
WITH RECURSIVE e AS (SELECT * FROM {GEO_EDGES_SQL}),
up(node, anc, dist) AS (
  SELECT child, parent, 1 FROM e
  UNION ALL SELECT up.node, e.parent, up.dist + 1 FROM up JOIN e ON e.child = up.anc)
SELECT anc AS link, CAST(count(*) AS BIGINT) AS n_below, CAST(max(dist) AS BIGINT) AS height FROM up GROUP BY anc
""")
def kinematic_closure(t: Tables) -> DataFrame:
    """Descendants and height of every inner node."""
    return kin.ancestor_pairs(geo_edges(t), []).groupBy(F.col("ancestor").alias("link")).agg(
        F.count("*").alias("n_below"), F.max("dist").alias("height"))


@query("J02", f"""
SELECT DISTINCT e.parent AS link FROM {GEO_EDGES_SQL} e
WHERE NOT EXISTS (SELECT 1 FROM {GEO_EDGES_SQL} c WHERE c.child = e.parent)
""")
def tree_roots(t: Tables) -> DataFrame:
    return kin.roots(geo_edges(t), [])


@query("J02", f"""
SELECT e.child, e.parent, coalesce(g.parent, '-') AS grandparent
FROM {GEO_EDGES_SQL} e LEFT JOIN {GEO_EDGES_SQL} g ON g.child = e.parent
""")
def edge_self_join(t: Tables) -> DataFrame:
    return kin.edge_pairs(geo_edges(t), []).select(
        "child", "parent", F.coalesce("grandparent", F.lit("-")).alias("grandparent"))


@query("J03 P06", f"""{CLOSURE_SQL}
SELECT obj, joint, CAST(count(*) AS BIGINT) AS n_parts, CAST(sum(label) AS BIGINT) AS label_sum FROM moved
WHERE type <> 'fixed' AND abs(upper - lower) >= 1e-6 GROUP BY obj, joint
""")
def joint_parts(t: Tables) -> DataFrame:
    """Parts under every movable joint."""
    joints = ad.joints(t)
    under = kin.descendant_parts(joints, KEYS)
    keep = joints.where(F.col("type").isin("revolute", "prismatic", "continuous")
                        & (F.abs(F.col("upper") - F.col("lower")) >= 1e-6))
    return under.join(keep.select("obj", "joint"), ["obj", "joint"], "left_semi").groupBy("obj", "joint").agg(
        F.count("*").alias("n_parts"), F.sum("label").alias("label_sum"))


@query("P06", f"""
SELECT obj, joint, type, upper - lower AS span FROM {ad.joints.sql}
WHERE type <> 'fixed' AND abs(upper - lower) >= 1e-6""")
def movable_joints(t: Tables) -> DataFrame:
    return kin.movable(ad.joints(t), KEYS).select("obj", "joint", "type", (F.col("upper") - F.col("lower")).alias("span"))


@query("P07", f"""
SELECT obj, joint, type FROM {ad.joints.sql}
WHERE (type = 'prismatic' AND abs(upper - lower) >= 0.005)
   OR (type IN ('revolute', 'continuous') AND abs(upper - lower) >= 0.05)""")
def significant_joints(t: Tables) -> DataFrame:
    return kin.significant(ad.joints(t)).select("obj", "joint", "type")


@query("J04", f"""
WITH RECURSIVE e AS (SELECT * FROM {ad.joints.sql}),
up(obj, node, anc, dist) AS (
  SELECT obj, child, parent, 1 FROM e
  UNION ALL SELECT up.obj, up.node, e.parent, up.dist + 1 FROM up JOIN e ON e.obj = up.obj AND e.child = up.anc)
SELECT obj, node, CAST(max(dist) AS BIGINT) AS depth FROM up GROUP BY obj, node""")
def ancestor_depth(t: Tables) -> DataFrame:
    return kin.link_depth(ad.joints(t).select("obj", "parent", "child"), KEYS)


@query("J04", f"""
WITH RECURSIVE e AS (SELECT * FROM {ad.joints.sql}),
up(obj, node, anc) AS (
  SELECT obj, child, parent FROM e
  UNION ALL SELECT up.obj, up.node, e.parent FROM up JOIN e ON e.obj = up.obj AND e.child = up.anc)
SELECT DISTINCT up.obj, up.node AS link FROM up
JOIN e ON e.obj = up.obj AND e.child = up.anc AND e.type = 'revolute'""")
def frozen_descendants(t: Tables) -> DataFrame:
    """Links below a revolute joint."""
    joints = ad.joints(t)
    return kin.frozen_links(joints.select("obj", "parent", "child"), joints.where("type = 'revolute'"), KEYS)


_R, _T = [f"r{i}" for i in range(9)], [f"t{i}" for i in range(3)]
_LOCAL = sx.rpy(["rpy0", "rpy1", "rpy2"])
_POSE_CTE = f"""
WITH RECURSIVE l AS (
  SELECT obj, parent, child, {sx.named(_LOCAL, _R)}, o0 AS t0, o1 AS t1, o2 AS t2 FROM {ad.joints.sql}),
w(obj, link, {", ".join(_R + _T)}) AS (
  SELECT obj, child, {", ".join(_R + _T)} FROM l WHERE parent = 'world'
  UNION ALL
  SELECT w.obj, l.child, {", ".join(sx.matmul(sx.of("w", _R), sx.of("l", _R)))},
         {", ".join(sx.add(sx.matvec(sx.of("w", _R), sx.of("l", _T)), sx.of("w", _T)))}
  FROM w JOIN l ON l.obj = w.obj AND l.parent = w.link)"""


@query("J05 X01 X02", f"""{_POSE_CTE}
SELECT obj, link, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _R + _T)} FROM w""")
def world_poses(t: Tables) -> DataFrame:
    poses = kin.world_transforms(ad.joints(t), KEYS)
    return poses.select("obj", "link", *[(F.round(c, 5) + 0.0).alias(c) for c in _R + _T])


_AX = sx.of("j", ["ax0", "ax1", "ax2"])
_PR = [f"coalesce(w.r{i}, {float(v)})" for i, v in enumerate(la.IDENTITY)]
_PT = [f"coalesce(w.t{i}, 0.0)" for i in range(3)]


@query("S05 J05", f"""{_POSE_CTE}
SELECT j.obj, j.joint,
  {", ".join(f"round({e}, 5) + 0.0 AS wo{i}" for i, e in enumerate(sx.add(_PT, sx.matvec(_PR, sx.of("j", ["o0", "o1", "o2"])))))},
  {", ".join(f"round({e}, 5) + 0.0 AS wd{i}" for i, e in enumerate(sx.matvec(_PR, _AX)))}
FROM {ad.joints.sql} j LEFT JOIN w ON w.obj = j.obj AND w.link = j.parent""")
def world_joint_axes(t: Tables) -> DataFrame:
    joints = ad.joints(t)
    out = kin.world_axes(joints, kin.world_transforms(joints, KEYS), KEYS)
    return out.select("obj", "joint", *[(F.round(f"{p}{i}", 5) + 0.0).alias(f"{p}{i}") for p in ("wo", "wd") for i in range(3)])


#: Frames of the reference clip.
FRAMES = 120
_LOCAL_R = sx.axis_angle(["ax0", "ax1", "ax2"], "turn")


_Q = f"sin((frame - 1) / {float(FRAMES - 1)} * pi()) * target"
_POSES_SQL = f"""
WITH RECURSIVE f AS (SELECT CAST(unnest(range(1, {FRAMES + 1})) AS BIGINT) AS frame),
a AS (SELECT *, CASE WHEN type = 'fixed' THEN 0.0 WHEN type = 'continuous' AND abs(upper - lower) <= 1e-6 THEN 1.0
        WHEN abs(upper) >= abs(lower) THEN upper ELSE lower END AS target FROM {ad.joints.sql}, f),
q AS (SELECT *, CASE WHEN type IN ('revolute', 'continuous') THEN {_Q} ELSE 0.0 END AS turn,
        CASE WHEN type = 'prismatic' THEN {_Q} ELSE 0.0 END AS slide FROM a),
l AS (SELECT obj, frame, parent, child, {sx.named(_LOCAL_R, _R)},
        o0 + ax0 * slide AS t0, o1 + ax1 * slide AS t1, o2 + ax2 * slide AS t2 FROM q),
w(obj, frame, link, {", ".join(_R + _T)}) AS (
  SELECT obj, frame, child, {", ".join(_R + _T)} FROM l WHERE parent = 'world'
  UNION ALL
  SELECT w.obj, w.frame, l.child, {", ".join(sx.matmul(sx.of("w", _R), sx.of("l", _R)))},
         {", ".join(sx.add(sx.matvec(sx.of("w", _R), sx.of("l", _T)), sx.of("w", _T)))}
  FROM w JOIN l ON l.obj = w.obj AND l.frame = w.frame AND l.parent = w.link)
SELECT obj, link, frame, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _R + _T)} FROM w"""


@query("J06 X04 X06 F04", _POSES_SQL)
def forward_kinematics(t: Tables) -> DataFrame:
    """Every frame of the clip."""
    out = kin.forward_kinematics(ad.joints(t), KEYS, FRAMES)
    return out.select("obj", "link", "frame", *[(F.round(c, 5) + 0.0).alias(c) for c in _R + _T])


@query("W17", f"""
WITH d AS (SELECT obj, child AS link, label, CAST(floor(log2(label + 1)) AS BIGINT) + 1 AS depth FROM {ad.joints.sql})
SELECT obj, link, depth, CAST(row_number() OVER (PARTITION BY obj ORDER BY depth, label) AS BIGINT) - 1 AS number FROM d""")
def link_numbering(t: Tables) -> DataFrame:
    """In a heap, breadth-first order is label order."""
    return kin.breadth_first_numbers(ad.joints(t).select("obj", "parent", "child", "label"), KEYS, "label")

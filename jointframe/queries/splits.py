"""Split queries: body / moving sets, promotion, tensors, text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import fixed
from jointframe.operators import catalog as cat
from jointframe.operators import geometry as geo
from jointframe.operators import kinematics as kin
from jointframe.operators import splits as sp
from jointframe.queries import sqltext as sx
from jointframe.queries.geometry import _FRAME_SQL, GEOMETRY_CTE, joint_axes, rounded, rsql
from jointframe.queries.kinematics import CLOSURE_SQL
from jointframe.registry import query
from jointframe.session import Tables, durable

V, J, P = ad.vertices.sql, ad.joints.sql, ad.parts.sql


def movable_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Ordered movable joints and the parts under them, both written once: splits read them several times."""
    joints = ad.joints(t)
    under = kin.descendant_parts(joints, ["obj"])
    moving = joints.where(F.col("type").isin(*fixed.MOVABLE) & (F.abs(F.col("upper") - F.col("lower")) >= 1e-6))
    ordered = sp.joint_ordinals(moving)
    return durable(ordered), durable(under.join(moving.select("obj", "joint"), ["obj", "joint"], "left_semi"))


SPLIT_SQL = """
mv AS (SELECT * FROM moved WHERE type <> 'fixed' AND abs(upper - lower) >= 1e-6),
jo AS (SELECT obj, joint, type, row_number() OVER (PARTITION BY obj ORDER BY joint) - 1 AS ord, count(*) OVER (PARTITION BY obj) AS nj
       FROM (SELECT DISTINCT obj, joint, type FROM mv)),
ck AS (SELECT obj, joint, 'default' AS key, 0 AS prio FROM jo
  UNION ALL SELECT obj, joint, CASE type WHEN 'revolute' THEN 'anim0' WHEN 'prismatic' THEN 'anim1' ELSE 'anim2' END,
     CASE type WHEN 'revolute' THEN 1 WHEN 'prismatic' THEN 2 ELSE 3 END FROM jo
  UNION ALL SELECT obj, joint, concat('anim', CAST(10 + ord AS STRING)), 10 + ord FROM jo WHERE nj > 1),
cs AS (SELECT ck.obj, ck.key, ck.prio, list_sort(list(DISTINCT mv.label)) AS labels FROM ck JOIN mv ON mv.obj = ck.obj AND mv.joint = ck.joint
       GROUP BY ck.obj, ck.key, ck.prio),
kept AS (SELECT obj, key, labels FROM (SELECT *, row_number() OVER (PARTITION BY obj, labels ORDER BY prio) AS rn FROM cs) WHERE rn = 1),
roles AS (SELECT k.obj, k.key, p.label, CASE WHEN list_contains(k.labels, p.label) THEN 'moving' ELSE 'body' END AS role
          FROM kept k JOIN (SELECT obj, label FROM {P}) p USING (obj)),
act AS (SELECT k.obj, k.key, ck.joint FROM kept k JOIN ck ON ck.obj = k.obj AND ck.key = k.key)""".replace("{P}", P)


@query("A06 U01", f"{CLOSURE_SQL}, {SPLIT_SQL} SELECT obj, key, label, role FROM roles")
def split_dedup(t: Tables) -> DataFrame:
    moving, _ = sp.build_splits(*movable_parts(t))
    return sp.split_roles(moving, ad.parts(t))


@query("A06", f"{CLOSURE_SQL}, {SPLIT_SQL} SELECT obj, key, joint FROM act")
def split_active_joints(t: Tables) -> DataFrame:
    return sp.build_splits(*movable_parts(t))[1]


@query("U02", f"""{CLOSURE_SQL}, {SPLIT_SQL}
SELECT obj, key, CAST(nullif(count(*) FILTER (role = 'body'), 0) AS BIGINT) AS n_movers FROM roles GROUP BY obj, key""")
def complement_movers(t: Tables) -> DataFrame:
    """Size of the complement; null where the split has no body."""
    moving, _ = sp.build_splits(*movable_parts(t))
    body = F.count_if(F.col("role") == "body")
    return sp.split_roles(moving, ad.parts(t)).groupBy("obj", "key").agg(F.nullif(body, F.lit(0)).alias("n_movers"))


THRESHOLD = 0.01
_ROT = sx.axis_angle(["wd0", "wd1", "wd2"], "q")
_OFF = [f"({a} - o{a})" for a in geo.AXES]
_TURNED = sx.add(sx.matvec(_ROT, _OFF), ["ox", "oy", "oz"])
PROMOTE_SQL = f"""
nv AS (SELECT v.obj, v.part AS label, {", ".join(f"CASE WHEN flat THEN v.{a} ELSE (v.{a} - m{a}) * scale END AS {a}" for a in geo.AXES)}
       FROM {V} v JOIN f USING (obj)),
dv AS (SELECT DISTINCT * FROM nv),
pq AS (SELECT ax.obj, ax.joint, ax.type, dv.label, dv.x, dv.y, dv.z, wd0, wd1, wd2, scale, abs(ax.upper - ax.lower) * fr AS q,
   (wo0 - mx) * scale AS ox, (wo1 - my) * scale AS oy, (wo2 - mz) * scale AS oz
   FROM mv JOIN ax ON ax.obj = mv.obj AND ax.joint = mv.joint JOIN f ON f.obj = mv.obj
   JOIN dv ON dv.obj = mv.obj AND dv.label = mv.label, (VALUES (0.5), (0.75), (1.0)) q(fr)),
pp AS (SELECT obj, joint, {", ".join(f"CASE WHEN type = 'prismatic' THEN {a} + wd{i} * q * scale ELSE {_TURNED[i]} END AS {a}" for i, a in enumerate(geo.AXES))} FROM pq),
hit AS (SELECT DISTINCT pp.obj, pp.joint, dv.label FROM pp JOIN dv ON dv.obj = pp.obj AND floor(dv.z / 0.01) BETWEEN floor(pp.z / 0.01) - 1 AND floor(pp.z / 0.01) + 1
   WHERE (pp.x-dv.x)*(pp.x-dv.x) + (pp.y-dv.y)*(pp.y-dv.y) + (pp.z-dv.z)*(pp.z-dv.z) < {THRESHOLD} * {THRESHOLD}),
tch AS (SELECT DISTINCT a.obj, a.key, h.label FROM act a JOIN hit h ON h.obj = a.obj AND h.joint = a.joint
   JOIN roles r ON r.obj = a.obj AND r.key = a.key AND r.label = h.label AND r.role = 'body' WHERE a.key <> 'default'),
pas AS (SELECT DISTINCT t.obj, t.key, mv.joint FROM tch t JOIN mv ON mv.obj = t.obj AND mv.label = t.label
   WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.obj = t.obj AND a.key = t.key AND a.joint = mv.joint)),
gain AS (SELECT DISTINCT p.obj, p.key, mv.label FROM pas p JOIN mv ON mv.obj = p.obj AND mv.joint = p.joint)"""


def promoted(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles, active joints after promotion, and the joints with axes and frames."""
    v = ad.vertices(t)
    ordered, moved = movable_parts(t)
    moving, active = sp.build_splits(ordered, moved)
    roles, active = durable(sp.split_roles(moving, ad.parts(t))), durable(active)
    frames = durable(geo.normal_frames(v, ["obj"]))
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    joints = ordered.join(axes, ["obj", "joint"]).join(frames.drop("flat"), "obj")
    rest = geo.normalise(v, frames, ["obj"]).select("obj", "part", *geo.AXES).distinct()
    lines = joints.select("obj", "joint", "type", "lower", "upper", "mx", "my", "mz", "scale", *[f"w{p}{i}" for p in "od" for i in range(3)])
    posed = sp.posed_points(rest, moved, lines)
    hits = geo.near_pairs(posed, rest.withColumnRenamed("part", "label"), ["obj"], "joint", "label", THRESHOLD)
    roles, active = sp.promote(roles, active, moved, hits)
    return roles, active, joints


@query("A07 J12 U08 X05", f"""{GEOMETRY_CTE}, {SPLIT_SQL}, {_FRAME_SQL}, {PROMOTE_SQL}
SELECT r.obj, r.key, r.label, CASE WHEN g.label IS NOT NULL THEN 'moving' ELSE r.role END AS role
FROM roles r LEFT JOIN gain g ON g.obj = r.obj AND g.key = r.key AND g.label = r.label""")
def proximity_promote(t: Tables) -> DataFrame:
    return promoted(t)[0]


_CELLS = ["(wo0 - mx) * scale", "(wo1 - my) * scale", "(wo2 - mz) * scale", "wd0", "wd1", "wd2",
          *[f"CASE WHEN type = '{k}' THEN 1.0 ELSE 0.0 END" for k in fixed.MOVABLE], "0.0", "abs(upper - lower)", "1.0"]
_NAMES = [f"c{i}" for i in range(12)]


@query("A08 K05", f"""{GEOMETRY_CTE}, {SPLIT_SQL}, {_FRAME_SQL},
s AS (SELECT act.obj, act.key, row_number() OVER (PARTITION BY act.obj, act.key ORDER BY act.joint) - 1 AS slot, ax.*, mx, my, mz, scale
  FROM act JOIN ax ON ax.obj = act.obj AND ax.joint = act.joint JOIN f ON f.obj = act.obj)
SELECT obj, key, CAST(slot AS BIGINT) AS slot, {rsql(_CELLS, _NAMES)} FROM s""")
def joint_tensor_rows(t: Tables) -> DataFrame:
    ordered, moved = movable_parts(t)
    _, active = sp.build_splits(ordered, moved)
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    joints = ordered.join(axes, ["obj", "joint"]).join(geo.normal_frames(ad.vertices(t), ["obj"]).drop("flat"), "obj")
    return sp.tensor_rows(active, joints).select("obj", "key", "slot", *rounded(_NAMES))


@query("K05", f"""{CLOSURE_SQL}, {SPLIT_SQL}
SELECT obj, key, CAST(8 AS BIGINT) AS n_rows, CAST(12 AS BIGINT) AS n_cols, CAST(least(count(*), 8) AS BIGINT) AS n_used FROM act GROUP BY obj, key""")
def joint_tensors(t: Tables) -> DataFrame:
    """Padded tensors, described by their shape and number of used rows."""
    ordered, moved = movable_parts(t)
    _, active = sp.build_splits(ordered, moved)
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    joints = ordered.join(axes, ["obj", "joint"]).join(geo.normal_frames(ad.vertices(t), ["obj"]).drop("flat"), "obj")
    out = sp.tensors(sp.tensor_rows(active, joints))
    used = F.aggregate("tensor", F.lit(0.0), lambda s, r: s + r[11].cast("double"))
    return out.select("obj", "key", F.size("tensor").cast("bigint").alias("n_rows"),
                      F.size(F.col("tensor")[0]).cast("bigint").alias("n_cols"), used.cast("bigint").alias("n_used"))


@query("K05", f"""{CLOSURE_SQL}, {SPLIT_SQL}, s AS (SELECT obj, key, row_number() OVER (PARTITION BY obj, key ORDER BY joint) - 1 AS slot FROM act)
SELECT obj, key, CAST(slot AS BIGINT) AS slot FROM s WHERE slot >= 4""")
def tensor_overflow(t: Tables) -> DataFrame:
    """What tensors of four rows leave out."""
    ordered, moved = movable_parts(t)
    _, active = sp.build_splits(ordered, moved)
    axes = joint_axes(t).select("obj", "joint", *[f"w{p}{i}" for p in "od" for i in range(3)])
    joints = ordered.join(axes, ["obj", "joint"]).join(geo.normal_frames(ad.vertices(t), ["obj"]).drop("flat"), "obj")
    return sp.tensor_rejects(sp.tensor_rows(active, joints), 4).select("obj", "key", "slot")


@query("J18", f"""{CLOSURE_SQL}, {SPLIT_SQL},
t AS (SELECT obj, label, regexp_matches(lower(movement), '{"|".join(fixed.MOVE_STEMS)}')
  AND NOT regexp_matches(lower(movement), '{"|".join(fixed.ANCHOR_PHRASES)}') AS mvt FROM {P})
SELECT r.obj, r.label, CASE WHEN r.role = 'moving' THEN 'moving_but_text_static' ELSE 'static_but_text_moving' END AS kind
FROM roles r JOIN t ON t.obj = r.obj AND t.label = r.label WHERE r.key = 'default' AND (r.role = 'moving') <> t.mvt""")
def split_text_mismatch(t: Tables) -> DataFrame:
    moving, _ = sp.build_splits(*movable_parts(t))
    texts = ad.parts(t).select("obj", "label", cat.moves_by_text(F.col("movement")).alias("is_moving"))
    return sp.text_mismatches(sp.split_roles(moving, ad.parts(t)), texts)

"""Pixel, camera, tag and track queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.operators import catalog as cat
from jointframe.operators import geometry as geo
from jointframe.operators import pixels as px
from jointframe.plans.ordered import asof
from jointframe.queries.catalog import hash_sql, values
from jointframe.queries.geometry import BOX_SQL, rounded, rsql
from jointframe.registry import query
from jointframe.session import Tables

FR, P, V, J = ad.fragments.sql, ad.parts.sql, ad.vertices.sql, ad.joints.sql
SF = ["scene", "frame"]


def pixels(t: Tables) -> DataFrame:
    return px.nearest_fragment(ad.fragments(t), SF, ["object_id", "instance_id", "tag", "shade"], ["object_id", "instance_id", "tag", "shade"])


def depths(t: Tables) -> DataFrame:
    return px.nearest_depth(ad.fragments(t), SF)


PX = f"""(SELECT scene, frame, y, x, depth, object_id, instance_id, tag, shade FROM (SELECT *, row_number() OVER (PARTITION BY scene, frame, y, x
  ORDER BY depth, object_id, instance_id, tag, shade) AS rn FROM {FR}) WHERE rn = 1)"""


@query("J23 A25", f"SELECT scene, frame, y, x, depth, object_id, instance_id, tag, shade FROM {PX}")
def nearest_pixels(t: Tables) -> DataFrame:
    return pixels(t)


@query("P16", f"""
WITH p AS (SELECT scene, frame, y, x, CASE WHEN depth < 40 THEN 1.0 ELSE 0.0 END AS alpha, shade AS r, depth / 100 AS g FROM {PX}),
a AS (SELECT * FROM p WHERE frame = 1), b AS (SELECT * FROM p WHERE frame = 3),
m AS (SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.alpha, 0) > 0.5 AS ma, coalesce(b.alpha, 0) > 0.5 AS mb,
  (coalesce(a.r, 0) - coalesce(b.r, 0)) * (coalesce(a.r, 0) - coalesce(b.r, 0)) + (coalesce(a.g, 0) - coalesce(b.g, 0)) * (coalesce(a.g, 0) - coalesce(b.g, 0)) AS d
  FROM a FULL OUTER JOIN b ON a.scene = b.scene AND a.y = b.y AND a.x = b.x),
g AS (SELECT scene, count(*) FILTER (ma OR mb) AS u, count(*) FILTER (ma AND mb) AS i, sum(d) FILTER (ma OR mb) AS d FROM m GROUP BY scene)
SELECT scene, round(coalesce(i / nullif(u, 0), 1), 6) AS iou, round(coalesce(d / nullif(u * 2, 0), 0), 12) AS mse,
  CASE WHEN u = 0 THEN true WHEN i / u < 0.98 THEN false ELSE d / (u * 2) < 0.001 END AS static FROM g""")
def static_clip(t: Tables) -> DataFrame:
    rows = pixels(t).withColumns({"alpha": F.when(F.col("depth") < 40, 1.0).otherwise(0.0), "r": F.col("shade"), "g": F.col("depth") / 100})
    out = px.static_clips(rows, ["scene"], "frame", 6, ["r", "g"])
    return out.withColumns({"iou": F.round("iou", 6), "mse": F.round("mse", 12)})


@query("P17", f"SELECT scene, frame, round(avg(depth), 6) AS mean, avg(depth) < 20 AS rejected, avg(depth) * 100.0 / 255 < 5 AS flagged FROM {PX} GROUP BY scene, frame")
def dark_images(t: Tables) -> DataFrame:
    return px.dark_images(pixels(t), SF, "depth").withColumn("mean", F.round("mean", 6))


@query("P18", f"""
SELECT scene, frame, y, x, CASE WHEN object_id = 1 OR abs(depth * 30) > 1000 THEN -1.0 ELSE depth * 30 END AS flow, depth * 0.0005 > 1e-3 AND depth < 10000 AS valid FROM {PX}""")
def clean_values(t: Tables) -> DataFrame:
    raw = F.when(F.col("object_id") == 1, float("nan")).otherwise(F.col("depth") * 30)
    return pixels(t).select(*SF, "y", "x", px.clean_flow(raw).alias("flow"), px.depth_valid(F.col("depth") * 0.0005).alias("valid"))


@query("A47 X27", f"""
WITH p AS (SELECT scene, frame, y, x, CASE WHEN object_id = 2 THEN 20000.0 ELSE depth END AS depth FROM {PX}),
r AS (SELECT scene, frame, min(depth) FILTER (depth < 10000) AS low, max(depth) FILTER (depth < 10000) AS high FROM p GROUP BY scene, frame)
SELECT p.scene, p.frame, y, x, CAST(CASE WHEN depth >= 10000 THEN 255 ELSE floor(coalesce((depth - low) / nullif(high - low, 0), 0) * 255) END AS BIGINT) AS code
FROM p JOIN r ON p.scene = r.scene AND p.frame = r.frame""")
def depth_codes(t: Tables) -> DataFrame:
    rows = pixels(t).withColumn("depth", F.when(F.col("object_id") == 2, 20000.0).otherwise(F.col("depth")))
    return px.depth_codes(rows, px.depth_ranges(rows, SF), SF).select(*SF, "y", "x", "code")


@query("A24", f"""
WITH t AS (SELECT scene, frame, count(*) AS n FROM {FR} GROUP BY scene, frame), d AS (SELECT * FROM (VALUES ('A'), ('R'), ('Z'), ('untagged')) v(tag)),
c AS (SELECT scene, frame, CASE WHEN tag IN ('A', 'R', 'Z') THEN tag ELSE 'untagged' END AS tag, count(*) AS n FROM {FR} GROUP BY 1, 2, 3)
SELECT t.scene, t.frame, d.tag, round(100.0 * coalesce(c.n, 0) / t.n, 6) AS share FROM t CROSS JOIN d LEFT JOIN c ON c.scene = t.scene AND c.frame = t.frame AND c.tag = d.tag""")
def pixel_share(t: Tables) -> DataFrame:
    return px.shares(ad.fragments(t), SF, "tag", ["A", "R", "Z"]).withColumn("share", F.round("share", 6))


@query("A25", f"SELECT scene, frame, object_id, instance_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {FR} GROUP BY ALL")
def instance_boxes(t: Tables) -> DataFrame:
    return px.instance_boxes(ad.fragments(t), [*SF, "object_id", "instance_id"])


@query("A26", f"""
SELECT scene, frame, y, x, object_id, instance_id, CAST(dense_rank() OVER (PARTITION BY scene, frame ORDER BY object_id, instance_id) - 1 AS BIGINT) AS code FROM {PX}""")
def mask_dictionary(t: Tables) -> DataFrame:
    coded, _ = px.dictionary_codes(pixels(t), SF, ["object_id", "instance_id"])
    return coded.select(*SF, "y", "x", "object_id", "instance_id", "code")


@query("A26", f"""
WITH d AS (SELECT DISTINCT scene, depth FROM {PX})
SELECT scene, CAST(count(*) AS BIGINT) AS n, CAST(CASE WHEN count(*) <= 256 THEN 8 ELSE 16 END AS INTEGER) AS bits FROM d GROUP BY scene""")
def mask_code_width(t: Tables) -> DataFrame:
    _, words = px.dictionary_codes(pixels(t), ["scene"], ["depth"])
    return words.select("scene", "n", "bits").distinct()


@query("J23 P26", f"""
SELECT s.scene, s.obj, s.name FROM (SELECT s_suppkey AS scene, CAST(k AS BIGINT) AS obj, concat('Chair_', s_name, '_', CAST(k AS STRING)) AS name FROM supplier, range(1, 10) r(k)) s
WHERE EXISTS (SELECT 1 FROM {FR} f WHERE f.scene = s.scene AND f.object_id = s.obj) AND contains(lower(name), '_3')""")
def named_objects(t: Tables) -> DataFrame:
    objects = t.supplier.select(F.col("s_suppkey").alias("scene"), "s_name", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"))).alias("obj"))
    objects = objects.select("scene", "obj", F.concat(F.lit("Chair_"), "s_name", F.lit("_"), F.col("obj").cast("string")).alias("name"))
    return px.named_objects(objects, ad.fragments(t).withColumnRenamed("object_id", "obj"), ["scene", "obj"], "_3")


@query("P31", f"SELECT DISTINCT scene, frame, object_id AS cam, tag AS dtype FROM {FR} WHERE object_id = 0 OR tag IN ('A', 'R')")
def camera_modalities(t: Tables) -> DataFrame:
    files = ad.fragments(t).select(*SF, F.col("object_id").alias("cam"), F.col("tag").alias("dtype")).distinct()
    return px.modalities(files, ["A", "R"])


@query("J16 U07", f"""
WITH s AS (SELECT scene, min(frame) AS a, max(frame) AS b FROM {FR} GROUP BY scene),
w AS (SELECT scene, unnest(generate_series(a, b)) AS frame FROM s),
g AS (SELECT scene, frame, CAST(c AS BIGINT) AS cam, d AS dtype FROM w, range(1, 8) r(c), (VALUES ('A'), ('N')) v(d))
SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM {FR} f WHERE f.scene = g.scene AND f.frame = g.frame AND f.object_id = g.cam AND f.tag = g.dtype)""")
def missing_frames(t: Tables) -> DataFrame:
    files = ad.fragments(t).select(*SF, F.col("object_id").alias("cam"), F.col("tag").alias("dtype")).distinct()
    spans = files.groupBy("scene").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return px.missing_frames(files, spans, list(range(1, 8)), ["A", "N"])


@query("J14", """
SELECT e.event_id, coalesce((SELECT max_by(f.event_id, f.ts) FROM events f WHERE f.event_type = 'signup' AND f.user_id = e.user_id AND f.ts <= e.ts), -1) AS tag_event
FROM events e WHERE e.event_type <> 'signup'""")
def asof_tag(t: Tables) -> DataFrame:
    """Latest signup of the user at or before every other event."""
    facts = t.events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("tag_event"))
    probes = t.events.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    return asof(probes, facts, ["user_id"], "ts", "tag_event", "event_id").select("event_id", F.coalesce("tag_event", F.lit(-1)).alias("tag_event"))


# Cameras: one per (scene, frame), turned about y by 0.03 per frame and shifted along x.
CAM = "(SELECT DISTINCT scene, frame, 8.0 AS fx, 8.0 AS fy, 3.5 AS cx, 3.5 AS cy, cos(0.03 * frame) AS c, sin(0.03 * frame) AS s, 0.2 * frame AS tx, 0.5 AS ty, 0.0 AS tz FROM {FR})".replace("{FR}", FR)


def cameras(t: Tables) -> DataFrame:
    f = F.col("frame")
    c, s, zero, one = F.cos(0.03 * f), F.sin(0.03 * f), F.lit(0.0), F.lit(1.0)
    turn = [c, zero, s, zero, one, zero, -s, zero, c]
    return ad.fragments(t).select(*SF).distinct().select(
        *SF, *[F.lit(v).alias(n) for n, v in zip(("fx", "fy", "cx", "cy"), (8.0, 8.0, 3.5, 3.5))],
        *[e.alias(f"r{i}") for i, e in enumerate(turn)], (0.2 * f).alias("t0"), F.lit(0.5).alias("t1"), F.lit(0.0).alias("t2"))


FLOW_SQL = f"""
cam AS (SELECT * FROM {CAM}),
cp AS (SELECT p.scene, p.frame AS a_frame, b.frame AS b_frame, p.y, p.x, p.depth, (p.x - 3.5) / 8 * depth AS px, (p.y - 3.5) / 8 * depth AS py,
   a.c AS ac, a.s AS as_, a.tx AS atx, b.c AS bc, b.s AS bs, b.tx AS btx FROM {PX} p JOIN cam a ON a.scene = p.scene AND a.frame = p.frame
   JOIN cam b ON b.scene = p.scene AND b.frame <> p.frame),
wp AS (SELECT *, ac * px + as_ * depth + atx - btx AS wx, py AS wy, ac * depth - as_ * px AS wz FROM cp),
bp AS (SELECT *, bc * wx - bs * wz AS qx, wy AS qy, bs * wx + bc * wz AS qz FROM wp),
fl AS (SELECT scene, a_frame, b_frame, y, x, 8 * qx / qz + 3.5 AS u, 8 * qy / qz + 3.5 AS v FROM bp)"""


@query("X21 J11", f"WITH {FLOW_SQL} SELECT scene, a_frame, b_frame, y, x, round(u, 5) + 0.0 AS u, round(v, 5) + 0.0 AS v FROM fl")
def reprojection(t: Tables) -> DataFrame:
    flow = px.induced_flow(depths(t), px.view_pairs(cameras(t), ["scene"], "frame"), ["scene"], "frame")
    return flow.select("scene", "a_frame", "b_frame", "y", "x", *rounded(["u", "v"]))


@query("A27 J11 X21", f"""WITH {FLOW_SQL},
n AS (SELECT scene, a_frame, b_frame, y, x, u - x AS fu, v - y AS fv, floor(u) + dx AS nx, floor(v) + dy AS ny,
  (CASE dx WHEN 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE dy WHEN 1 THEN v - floor(v) ELSE 1 - v + floor(v) END) AS w FROM fl, range(2) q(dx), range(2) r(dy)),
s AS (SELECT n.scene, n.a_frame, n.b_frame, n.y, n.x, n.fu, n.fv, sum(coalesce(w * (g.u - g.x), 0)) AS gu, sum(coalesce(w * (g.v - g.y), 0)) AS gv
  FROM n LEFT JOIN fl g ON g.scene = n.scene AND g.a_frame = n.b_frame AND g.b_frame = n.a_frame AND g.x = n.nx AND g.y = n.ny GROUP BY ALL)
SELECT scene, a_frame, b_frame, round(avg(CASE WHEN sqrt((gu + fu) * (gu + fu) + (gv + fv) * (gv + fv)) < 1 THEN 1.0 ELSE 0.0 END), 6) AS score FROM s GROUP BY ALL""")
def covisibility(t: Tables) -> DataFrame:
    return px.covisibility(depths(t), cameras(t), ["scene"], "frame").withColumn("score", F.round("score", 6))


@query("X22 J15", f"""
WITH p AS (SELECT scene, frame, y, x, depth, (object_id % 3 - 1) / 4.0 AS f0, (instance_id - 1) / 8.0 AS f1, 1.0 AS f2 FROM {PX}),
s AS (SELECT scene, frame, max(x) AS w, max(y) AS h FROM p GROUP BY scene, frame),
m AS (SELECT p.scene, p.frame, p.y, p.x, depth + f2 AS target, x + f0 * 2 + dx AS u, y + f1 * 2 + dy AS v FROM p, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy)),
i AS (SELECT m.*, coalesce(u BETWEEN 0 AND w AND v BETWEEN 0 AND h, false) AS ins FROM m LEFT JOIN s ON s.scene = m.scene AND s.frame = m.frame + 1),
n AS (SELECT i.*, floor(u) + ex AS nx, floor(v) + ey AS ny, (CASE ex WHEN 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE ey WHEN 1 THEN v - floor(v) ELSE 1 - v + floor(v) END) AS wt
  FROM i, range(2) a(ex), range(2) b(ey)),
g AS (SELECT n.scene, n.frame, n.y, n.x, n.target, n.u, n.v, n.ins, sum(coalesce(wt * q.depth, 0)) AS nx_depth FROM n LEFT JOIN {PX} q ON q.scene = n.scene AND q.frame = n.frame + 1 AND q.x = n.nx AND q.y = n.ny GROUP BY ALL)
SELECT scene, frame, y, x, bool_or(target >= 0 AND target <= CASE WHEN ins THEN nx_depth ELSE 0 END) AS visible FROM g GROUP BY scene, frame, y, x""")
def flow_occlusion(t: Tables) -> DataFrame:
    """Flow towards the next frame tested against its depth."""
    rows = pixels(t)
    moved = rows.select(*SF, "y", "x", "depth", ((F.col("object_id") % 3 - 1) / 4.0).alias("f0"), ((F.col("instance_id") - 1) / 8.0).alias("f1"), F.lit(1.0).alias("f2"))
    following = rows.select("scene", (F.col("frame") - 1).alias("frame"), "y", "x", "depth")
    return px.occlusion(moved, following, SF)


@query("X20", f"""
WITH p AS (SELECT scene, frame, y, x, (x - 3.5) / 8 * depth AS px, (y - 3.5) / 8 * depth AS py, depth AS pz FROM {PX}),
d AS (SELECT p.scene, p.frame, p.y, p.x, a.px - p.px AS ax, a.py - p.py AS ay, a.pz - p.pz AS az, b.px - p.px AS bx, b.py - p.py AS by_, b.pz - p.pz AS bz FROM p
  JOIN p a ON a.scene = p.scene AND a.frame = p.frame AND a.y = p.y AND a.x = p.x + 1 JOIN p b ON b.scene = p.scene AND b.frame = p.frame AND b.y = p.y + 1 AND b.x = p.x),
c AS (SELECT scene, frame, y, x, ay * bz - az * by_ AS n0, az * bx - ax * bz AS n1, ax * by_ - ay * bx AS n2 FROM d),
l AS (SELECT *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS n FROM c)
SELECT scene, frame, y, x, {rsql(["n0 / n", "n1 / n", "n2 / n"], ["n0", "n1", "n2"])} FROM l""")
def depth_normals(t: Tables) -> DataFrame:
    cam = {n: F.lit(v) for n, v in zip(("fx", "fy", "cx", "cy"), (8.0, 8.0, 3.5, 3.5))}
    return px.depth_normals(pixels(t).withColumns(cam), SF).select(*SF, "y", "x", *rounded(["n0", "n1", "n2"]))


# Points: parts as points, seen by the cameras of a scene chosen by the object.
PT = f"(SELECT obj % (SELECT count(*) FROM supplier) + 1 AS scene, obj * 8 + label AS point, CAST(size AS DOUBLE) / 5 - 5 AS x, CAST(label AS DOUBLE) - 3 AS y, CAST(obj % 13 AS DOUBLE) - 2 AS z FROM {P})"
_VIEW = f"""
v AS (SELECT p.scene, p.point, c.frame, p.x, p.y, p.z, c.c, c.s, c.tx, c.c * (x - tx) - c.s * z AS qx, y - 0.5 AS qy, c.s * (x - tx) + c.c * z AS qz FROM {PT} p JOIN {CAM} c USING (scene)),
w AS (SELECT *, 8 * qx / nullif(qz, 0) + 3.5 AS u, 8 * qy / nullif(qz, 0) + 3.5 AS v_ FROM v)"""


def points(t: Tables) -> DataFrame:
    return ad.parts(t).selectExpr(f"obj % {t.supplier.count()} + 1 AS scene", "obj * 8 + label AS point", "CAST(size AS DOUBLE) / 5 - 5 AS x", "CAST(label AS DOUBLE) - 3 AS y", "CAST(obj % 13 AS DOUBLE) - 2 AS z")


@query("P19", f"""WITH {_VIEW}
SELECT scene, point, frame, round(qz, 5) + 0.0 AS d, coalesce(qz > 0 AND u >= 0 AND v_ >= 0 AND u < 8 AND v_ < 8, false) AS in_view FROM w""")
def points_in_view(t: Tables) -> DataFrame:
    return px.in_view(points(t), cameras(t), ["scene"], 8.0, 8.0).select("scene", "point", "frame", *rounded(["d"]), "in_view")


@query("P20", f"""WITH {_VIEW},
k AS (SELECT *, least(greatest(u, 0), 8) AS cu, least(greatest(v_, 0), 8) AS cv, greatest(qz, 0) AS cd FROM w WHERE u IS NOT NULL),
b AS (SELECT *, (cu - 3.5) / 8 * cd AS bx, (cv - 3.5) / 8 * cd AS by_ FROM k),
r AS (SELECT *, sqrt((x - (c * bx + s * cd + tx)) * (x - (c * bx + s * cd + tx)) + (y - (by_ + 0.5)) * (y - (by_ + 0.5)) + (z - (c * cd - s * bx)) * (z - (c * cd - s * bx))) AS vis FROM b)
SELECT scene, point, bool_or(qz < 8 AND vis < 1.53) AS mask, round(coalesce(min(qz) FILTER (qz < 8 AND vis < 1.53), 1e7), 5) + 0.0 AS min_dist,
  round(coalesce(min(vis) FILTER (qz < 8 AND vis < 1.53), 1e7), 5) + 0.0 AS min_vis FROM r GROUP BY scene, point""")
def view_distances(t: Tables) -> DataFrame:
    viewed = px.in_view(points(t), cameras(t), ["scene"], 8.0, 8.0)
    out = px.view_distances(viewed, ["scene", "point"], 8.0, 8.0, 8.0, 1.53)
    return out.select("scene", "point", "mask", *rounded(["min_dist", "min_vis"]))


@query("P21", f"""
WITH g AS (SELECT scene, frame, count(*) AS n, min(depth) AS mn, stddev_pop(depth) AS sd, count(*) FILTER (depth < 5) AS cl, count(*) FILTER (tag = 'A') AS a FROM {PX} GROUP BY scene, frame)
SELECT scene, frame, round(n / 64.0, 6) AS coverage, round(sd + 1.5 * mn, 5) AS score,
  n / 64.0 BETWEEN 0.5 AND 1 AND mn >= 2 AND cl / n <= 0.12 AND a / 64.0 BETWEEN 0.1 AND 0.6 AS keep FROM g""")
def camera_quality(t: Tables) -> DataFrame:
    hits = pixels(t).withColumn("dist", F.col("depth"))
    out = px.camera_quality(hits, SF, 64, (0.5, 1.0), {"A": (0.1, 0.6)}, 5.0, 0.12, 2.0)
    return out.withColumns({"coverage": F.round("coverage", 6), "score": F.round("score", 5)})


@query("X23", f"""
WITH b AS (SELECT obj, {BOX_SQL} FROM {V} GROUP BY obj),
c AS (SELECT obj % (SELECT count(*) FROM supplier) + 1 AS scene, obj, CAST(k AS BIGINT) AS corner, {", ".join(f"(CASE WHEN (k >> {i}) & 1 = 1 THEN hi_{a} ELSE lo_{a} END) / 10 + {2 * (a == 'z')} AS {a}" for i, a in enumerate(geo.AXES))} FROM b, range(8) r(k)),
v AS (SELECT q.scene, q.obj, q.corner, m.frame, c * (x - tx) - s * z AS qx, y - 0.5 AS qy, s * (x - tx) + c * z AS qz FROM c q JOIN {CAM} m USING (scene)),
n AS (SELECT *, min(qz) OVER (PARTITION BY scene, obj, frame) AS near FROM v)
SELECT scene, obj, corner, frame, round(8 * qx / qz + 3.5, 4) + 0.0 AS u, round(8 * qy / qz + 3.5, 4) + 0.0 AS v FROM n WHERE near > 0""")
def box_projection(t: Tables) -> DataFrame:
    box = geo.corners(geo.boxes(ad.vertices(t), ["obj"])).select((F.col("obj") % t.supplier.count() + 1).alias("scene"), "obj", "corner", *[(F.col(a) / 10 + 2 * (a == "z")).alias(a) for a in geo.AXES])
    out = px.box_views(box, cameras(t), ["scene"], ["obj", "frame"])
    return out.select("scene", "obj", "corner", "frame", *rounded(["u", "v"], 4))


@query("X23", f"""
WITH b AS (SELECT obj, {BOX_SQL} FROM {V} GROUP BY obj),
c AS (SELECT obj % (SELECT count(*) FROM supplier) + 1 AS scene, obj, CAST(k AS BIGINT) AS corner, {", ".join(f"(CASE WHEN (k >> {i}) & 1 = 1 THEN hi_{a} ELSE lo_{a} END) / 10 + {2 * (a == 'z')} AS {a}" for i, a in enumerate(geo.AXES))} FROM b, range(8) r(k)),
v AS (SELECT q.scene, q.obj, q.corner, m.frame, c * (x - tx) - s * z AS qx, y - 0.5 AS qy, s * (x - tx) + c * z AS qz FROM c q JOIN {CAM} m USING (scene)),
n AS (SELECT *, min(qz) OVER (PARTITION BY scene, obj, frame) AS near FROM v),
p AS (SELECT scene, obj, frame, corner, trunc(round(8 * qx / qz + 3.5, 4)) AS u, trunc(round(8 * qy / qz + 3.5, 4)) AS v FROM n WHERE near > 0),
f AS (SELECT * FROM (VALUES {values([(i, *face[:3], sign) for i, (face, sign) in enumerate(zip(fixed.BOX_FACES, fixed.BOX_SIGNS))])}) f(face, a, b, c, sign))
SELECT p.scene, p.obj, p.frame, CAST(face AS BIGINT) AS face, ((q.u - p.u) * (r.v - p.v) - (q.v - p.v) * (r.u - p.u)) * sign < 0 AS facing
FROM f JOIN p ON p.corner = a JOIN p q ON (q.scene, q.obj, q.frame, q.corner) = (p.scene, p.obj, p.frame, b) JOIN p r ON (r.scene, r.obj, r.frame, r.corner) = (p.scene, p.obj, p.frame, c)""")
def box_facing(t: Tables) -> DataFrame:
    """Which of the six faces of every projected box turn towards the camera."""
    box = geo.corners(geo.boxes(ad.vertices(t), ["obj"])).select((F.col("obj") % t.supplier.count() + 1).alias("scene"), "obj", "corner", *[(F.col(a) / 10 + 2 * (a == "z")).alias(a) for a in geo.AXES])
    views = px.box_views(box, cameras(t), ["scene"], ["obj", "frame"])
    return px.box_faces(views.withColumns({c: F.round(c, 4) for c in ("u", "v")}), ["scene", "obj", "frame"])


@query("X25 X26", f"""
WITH h AS (SELECT DISTINCT object_id, scene, ({hash_sql("scene * 10 + object_id")} % 360) / CAST(360 AS DOUBLE) AS h FROM {FR}),
k AS (SELECT *, h * 6 AS a, (5 + h * 6) - 6 * floor((5 + h * 6) / 6) AS k5, (3 + h * 6) - 6 * floor((3 + h * 6) / 6) AS k3, (1 + h * 6) - 6 * floor((1 + h * 6) / 6) AS k1 FROM h)
SELECT scene, object_id, {", ".join(f"round(1 - 0.75 * greatest(0, least({k}, 4 - {k}, 1)), 5) AS {n}" for n, k in (("r", "k5"), ("g", "k3"), ("b", "k1")))} FROM k""")
def label_colours(t: Tables) -> DataFrame:
    rows = ad.fragments(t).select("scene", "object_id").distinct()
    rgb = sc.label_colour(F.col("scene") * 10 + F.col("object_id"))
    return rows.select("scene", "object_id", *[F.round(c, 5).alias(n) for c, n in zip(rgb, "rgb")])


@query("X27", f"""
SELECT obj, joint, {", ".join(f"CAST(CASE WHEN type = 'fixed' THEN 0 ELSE round_even((ax{i} + 1) * 127.5, 0) END AS INTEGER) AS n{i}" for i in range(3))} FROM {J}""")
def normal_encoding(t: Tables) -> DataFrame:
    n = [F.when(F.col("type") == "fixed", 0.0).otherwise(F.col(f"ax{i}")) for i in range(3)]
    return ad.joints(t).select("obj", "joint", *[c.alias(f"n{i}") for i, c in enumerate(sc.encode_normal(n))])


@query("W10 S26", f"""
WITH f AS (SELECT name AS tag, min(obj * 8 + label) AS pos FROM {P} GROUP BY name UNION ALL SELECT concat(least(factory, brand), '.', greatest(factory, brand)), min(obj * 8 + label) FROM {P} GROUP BY 1)
SELECT tag, CAST(row_number() OVER (ORDER BY pos, tag) AS BIGINT) AS id FROM f""")
def tag_numbering(t: Tables) -> DataFrame:
    p = ad.parts(t).withColumn("at", F.col("obj") * 8 + F.col("label"))
    both = p.select(F.col("name").alias("tag"), "at").union(p.select(px.combined_tag(F.array("factory", "brand")), "at"))
    return px.tag_ids(both, ["at"])


@query("P25", f"""
SELECT obj, label FROM {P} WHERE contains(material, 'Oak') AND NOT contains(material, 'glass') AND factory = 'SMALL'""")
def tagged_faces(t: Tables) -> DataFrame:
    """Faces are parts; their tag is the set of words of the material and the type."""
    p = ad.parts(t).withColumn("tags", F.array_sort(F.array_distinct(F.array_append(F.split("material", " "), F.col("factory")))))
    words = p.select("tags").distinct().withColumn("id", F.xxhash64("tags"))
    faces = p.select("obj", "label", F.xxhash64("tags").alias("tag_id"))
    return px.faces_with_tags(faces, words, ["Oak", "SMALL"], ["glass"]).select("obj", "label")


@query("W11", f"""
WITH m AS (SELECT DISTINCT scene, frame, tag AS name, object_id AS instance FROM {FR}),
g AS (SELECT DISTINCT scene, frame, name FROM m),
l AS (SELECT DISTINCT a.scene, a.frame, a.name FROM m a JOIN m b ON a.scene = b.scene AND a.name = b.name AND a.instance = b.instance AND a.frame = b.frame + 1),
s AS (SELECT g.*, count(*) FILTER (l.frame IS NULL) OVER (PARTITION BY g.scene, g.name ORDER BY g.frame) AS grp
      FROM g LEFT JOIN l ON l.scene = g.scene AND l.frame = g.frame AND l.name = g.name)
SELECT scene, frame, name, min(frame) OVER (PARTITION BY scene, name, grp) AS first_frame FROM s""")
def mesh_identity(t: Tables) -> DataFrame:
    meshes = ad.fragments(t).select(*SF, F.col("tag").alias("name"), F.lit(8).cast("bigint").alias("n_verts"), F.col("object_id").alias("instance")).distinct()
    return px.mesh_identity(meshes).select(*SF, "name", "first_frame")


_KEYS = "(SELECT o_custkey AS obj, o_orderkey % 40 AS pos, CAST(min(o_orderkey % 11) AS DOUBLE) AS value, min(o_orderkey) % 2 AS c FROM orders GROUP BY 1, 2)"


@query("W12", f"""
WITH k AS (SELECT *, lead(pos) OVER (PARTITION BY obj ORDER BY pos) AS pos1, lead(value) OVER (PARTITION BY obj ORDER BY pos) AS v1, first_value(value) OVER (PARTITION BY obj ORDER BY pos) AS f FROM {_KEYS}),
g AS (SELECT DISTINCT obj, f, CAST(fr AS BIGINT) AS frame FROM k, range(0, 40) r(fr)),
h AS (SELECT g.obj, g.frame, g.f, k.* EXCLUDE (obj, f), row_number() OVER (PARTITION BY g.obj, g.frame ORDER BY k.pos DESC) AS rn FROM g LEFT JOIN k ON k.obj = g.obj AND k.pos <= g.frame)
SELECT obj, frame, round(CASE WHEN pos IS NULL THEN f WHEN pos1 IS NULL OR c = 0 THEN value ELSE value + (v1 - value) / (pos1 - pos) * (frame - pos) END, 6) AS value,
  round(CASE WHEN pos1 IS NULL OR c = 0 OR pos IS NULL THEN 0 ELSE (v1 - value) / (pos1 - pos) END, 6) AS slope FROM h WHERE rn = 1""")
def keyframe_interpolation(t: Tables) -> DataFrame:
    keys = t.orders.groupBy(F.col("o_custkey").alias("obj"), (F.col("o_orderkey") % 40).alias("at")).agg(
        F.min(F.col("o_orderkey") % 11).cast("double").alias("value"), F.min("o_orderkey").alias("m"))
    keys = keys.withColumn("interp", F.when(F.col("m") % 2 == 0, "CONSTANT").otherwise("LINEAR")).drop("m")
    keys = keys.withColumns({h: F.lit(0.0) for h in ("h1x", "h1y", "h2x", "h2y")})
    frames = keys.select("obj").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))))
    out = px.keyframe_values(keys, frames, ["obj"])
    return out.select("obj", "frame", F.round("value", 6).alias("value"), F.round("slope", 6).alias("slope"))


_X, _Y = [f"((1 - {{s}}) ** 3 * {a} + 3 * (1 - {{s}}) ** 2 * {{s}} * {b} + 3 * (1 - {{s}}) * {{s}} ** 2 * {c} + {{s}} ** 3 * {d})" for a, b, c, d in (
    ("pos", "(pos + 0.3)", "(pos + 0.6)", "pos1"), ("value", "(value + 2)", "(value - 1)", "v1"))]
_AT = f"list_reduce(list_prepend(0.0::DOUBLE, [2.0::DOUBLE ** -k FOR k IN range(1, 60)]), lambda r, h: CASE WHEN {_X.format(s='(r + h)')} <= frame THEN r + h ELSE r END)"


@query("W12", f"""
WITH o AS (SELECT o_custkey AS obj, o_orderkey % 40 AS pos, CAST(min(o_orderkey % 11) AS DOUBLE) AS value, min(o_orderkey) % 3 AS c FROM orders GROUP BY 1, 2),
k AS (SELECT *, lead(pos) OVER w AS pos1, lead(value) OVER w AS v1, first_value(value) OVER w AS f FROM o WINDOW w AS (PARTITION BY obj ORDER BY pos)),
g AS (SELECT DISTINCT obj, f, CAST(fr AS BIGINT) AS frame FROM k, range(0, 40) r(fr)),
h AS (SELECT g.obj, g.frame, g.f, k.* EXCLUDE (obj, f), row_number() OVER (PARTITION BY g.obj, g.frame ORDER BY k.pos DESC) AS rn FROM g LEFT JOIN k ON k.obj = g.obj AND k.pos <= g.frame),
s AS (SELECT *, CASE WHEN c = 2 AND pos1 IS NOT NULL THEN {_AT} END AS s FROM h WHERE rn = 1)
SELECT obj, frame, round(CASE WHEN pos IS NULL THEN f WHEN pos1 IS NULL OR c = 0 THEN value WHEN c = 1 THEN value + (v1 - value) / (pos1 - pos) * (frame - pos) ELSE {_Y.format(s='s')} END, 6) + 0.0 AS value FROM s""")
def bezier_channels(t: Tables) -> DataFrame:
    """Channels whose keys hold, go straight or follow a cubic, at every frame."""
    keys = t.orders.groupBy(F.col("o_custkey").alias("obj"), (F.col("o_orderkey") % 40).alias("at")).agg(
        F.min(F.col("o_orderkey") % 11).cast("double").alias("value"), (F.min("o_orderkey") % 3).alias("c"))
    keys = keys.withColumn("interp", F.when(F.col("c") == 0, "CONSTANT").when(F.col("c") == 1, "LINEAR").otherwise("BEZIER")).drop("c")
    keys = keys.withColumns({"h1x": F.col("at") + 0.3, "h1y": F.col("value") + 2, "h2x": F.col("at") + 0.6, "h2y": F.col("value") - 1})
    frames = keys.select("obj").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))))
    return px.keyframe_values(keys, frames, ["obj"]).select("obj", "frame", (F.round("value", 6) + 0.0).alias("value"))


@query("W13", """
SELECT user_id AS track, event_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)""")
def clean_tracks(t: Tables) -> DataFrame:
    """Tracks with a broken position are dropped whole."""
    bad = (F.col("event_type") == "error") & (F.col("value") > 60)
    rows = t.events.select(F.col("user_id").alias("track"), "event_id", F.when(bad, float("nan")).otherwise(F.col("value")).alias("value"))
    return px.clean_tracks(rows, ["track"], ["value"])


_STEP = """SELECT l_suppkey % 50 AS scene, CAST(l_linenumber AS BIGINT) AS frame, CAST(l_orderkey % 128 AS BIGINT) AS "row", CAST(l_partkey % 128 AS BIGINT) AS col,
  max(CASE WHEN l_quantity >= 49 THEN NULL ELSE CAST(l_quantity AS DOUBLE) / 8 END) AS dx, CAST(min(l_suppkey) AS DOUBLE) / 4 AS dy FROM lineitem GROUP BY 1, 2, 3, 4"""


@query("W13", f"""
WITH s AS ({_STEP}), g AS (SELECT DISTINCT CAST(trunc(8 + i / CAST(31 AS DOUBLE) * 48) AS BIGINT) AS at FROM range(32) r(i)),
p AS (SELECT scene, y.at AS gy, x.at AS gx, frame, x.at + dx AS x, y.at + dy AS y FROM s JOIN g y ON s."row" = 2 * y.at JOIN g x ON s.col = 2 * x.at)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.scene = p.scene AND q.gy = p.gy AND q.gx = p.gx AND q.x IS NULL)""")
def grid_tracks(t: Tables) -> DataFrame:
    """Tracks that start on the grid of 32 by 32 points and have a position in every frame."""
    steps = t.spark.sql(_STEP.replace('"row"', "`row`").replace("FROM lineitem", "FROM {lines}"), lines=t.lineitem)
    return px.grid_tracks(steps, ["scene"], 64, 64)


@query("W16", """
WITH d AS (SELECT DISTINCT o_custkey AS scene, o_orderkey AS frame FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame) AS rn FROM d)
SELECT scene, min(frame) AS first, max(frame) AS last, max(frame) FILTER (rn <= 2) - min(frame) AS block FROM r GROUP BY scene""")
def block_size(t: Tables) -> DataFrame:
    return px.block_size(t.orders.select(F.col("o_custkey").alias("scene"), F.col("o_orderkey").alias("frame")), ["scene"])


@query("A44", f"""
SELECT obj, CAST(round_even(ax0 * 100, 0) AS BIGINT) AS k0, CAST(round_even(ax1 * 100, 0) AS BIGINT) AS k1, CAST(round_even(ax2 * 100, 0) AS BIGINT) AS k2,
  CAST(round_even((ax0 * o0 + ax1 * o1 + ax2 * o2) * 100, 0) AS BIGINT) AS k3, min(label) AS face FROM {J} WHERE type <> 'fixed' GROUP BY ALL""")
def unique_planes(t: Tables) -> DataFrame:
    from jointframe.operators import scenes
    faces = ad.joints(t).select("obj", F.col("label").alias("face"), *[F.when(F.col("type") == "fixed", 0.0).otherwise(F.col(f"ax{i}")).alias(f"n{i}") for i in range(3)],
                                *[F.col(f"o{i}").alias(f"p{i}") for i in range(3)])
    return scenes.unique_planes(faces, ["obj"], 0.01)

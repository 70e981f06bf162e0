"""Corpus-level queries: metadata, converted documents, listings, palettes, table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from jointframe import adapters as ad

from jointframe.functions import scalar as sc
from jointframe.operators import catalog as cat
from jointframe.operators import geometry as geo
from jointframe.operators import splits as sp
from jointframe.plans import corpus
from jointframe.plans.ordered import neighbours
from jointframe.queries.catalog import uniform_sql
from jointframe.queries.geometry import _FRAME_SQL, _RAD, GEOMETRY_CTE, joint_axes, rounded, rsql
from jointframe.queries.kinematics import CLOSURE_SQL
from jointframe.queries.splits import PROMOTE_SQL, SPLIT_SQL, THRESHOLD, movable_parts
from jointframe.registry import query
from jointframe.session import Tables, durable
from jointframe.sinks import text as out
from jointframe.sources import assets, files

P, J, V = ad.parts.sql, ad.joints.sql, ad.vertices.sql


def _split_sizes(c: corpus.Corpus) -> DataFrame:
    n = c.active.groupBy("obj", "key").agg(F.count("*").alias("n_joints"))
    sizes = c.roles.groupBy("obj", "key").agg(F.count_if(F.col("role") == "moving").alias("n_moving"), F.count_if(F.col("role") == "body").alias("n_body"))
    return sizes.join(n, ["obj", "key"])


def strip_faces(t: Tables, vertices: DataFrame | None = None) -> DataFrame:
    """Each part as a strip of triangles over its vertices in order; ``vertices`` are those of the tables if they are written already."""
    written = vertices is not None
    rows = neighbours(vertices if written else ad.vertices(t), ["obj", "part"], ad.VERTEX_ORDER, {f"q{i}": a for i, a in enumerate(geo.AXES)}, ahead=True,
                      second={f"s{i}": f"q{i}" for i in range(3)}, reread=written).where("s0 is not null")
    face = (F.col("ord1") * 8 + F.col("ord2")).alias("face")
    return rows.select("obj", "part", face, *[F.col(a).alias(f"p{i}") for i, a in enumerate(geo.AXES)], *[f"{c}{i}" for c in "qs" for i in range(3)])


_STRIP = ", ".join(f"lead({a}, {k}) OVER o AS {c}{i}" for k, c in ((1, "q"), (2, "s")) for i, a in enumerate(geo.AXES))
_A, _B = [f"(q{i} - p{i})" for i in range(3)], [f"(s{i} - p{i})" for i in range(3)]
_CROSS = [f"({_A[(i + 1) % 3]} * {_B[(i + 2) % 3]} - {_A[(i + 2) % 3]} * {_B[(i + 1) % 3]})" for i in range(3)]
_DRAWN = [f"p{i} + {_A[i]} * a + {_B[i]} * b" for i in range(3)]
#: Area samples of the strips in normalised space.
SAMPLE_SQL = f"""
sf AS (SELECT * FROM (SELECT obj, part, ord1 * 8 + ord2 AS face, {", ".join(f"{a} AS p{i}" for i, a in enumerate(geo.AXES))}, {_STRIP} FROM {V} WINDOW o AS (PARTITION BY obj, part ORDER BY {", ".join(ad.VERTEX_ORDER)})) WHERE s0 IS NOT NULL),
sa AS (SELECT *, sqrt({" + ".join(f"{c} * {c}" for c in _CROSS)}) / 2 AS area FROM sf),
sw AS (SELECT *, greatest(count(*) OVER (PARTITION BY obj, part), 1000) * area / nullif(sum(area) OVER (PARTITION BY obj, part), 0) AS want FROM sa),
sn AS (SELECT *, CAST(floor(want) AS BIGINT) + CASE WHEN {uniform_sql("obj", "part", "face")} < want - floor(want) THEN 1 ELSE 0 END AS n FROM sw WHERE want IS NOT NULL),
si AS (SELECT *, unnest(range(1, n + 1)) AS i FROM sn),
su AS (SELECT *, {uniform_sql("obj", "part", "face", "i", "'a'")} AS u, {uniform_sql("obj", "part", "face", "i", "'b'")} AS v FROM si),
sb AS (SELECT *, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS a, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS b FROM su),
sx AS (SELECT obj, part, {", ".join(f"{e} AS {a}" for e, a in zip(_DRAWN, geo.AXES))} FROM sb),
dv AS MATERIALIZED (SELECT DISTINCT sx.obj, part AS label, {", ".join(f"CASE WHEN flat THEN sx.{a} ELSE (sx.{a} - m{a}) * scale END AS {a}" for a in geo.AXES)} FROM sx JOIN f USING (obj)),"""

_POSED_SQL = PROMOTE_SQL.split("dv AS (SELECT DISTINCT * FROM nv),", 1)[1].split("hit AS", 1)[0]
_GAIN_SQL = PROMOTE_SQL.split("tch AS", 1)[1]
#: Points meet in cells of the threshold and the cells around them.
HIT_SQL = f"""
dc AS (SELECT dv.*, {", ".join(f"CAST(floor({a} / {THRESHOLD}) AS BIGINT) + d{a} AS c{a}" for a in geo.AXES)} FROM dv, {", ".join(f"(VALUES (-1), (0), (1)) t{a}(d{a})" for a in geo.AXES)}),
pc AS (SELECT *, {", ".join(f"CAST(floor({a} / {THRESHOLD}) AS BIGINT) AS c{a}" for a in geo.AXES)} FROM pp),
hit AS MATERIALIZED (SELECT DISTINCT pc.obj, pc.joint, dc.label FROM pc JOIN dc ON dc.obj = pc.obj AND {" AND ".join(f"dc.c{a} = pc.c{a}" for a in geo.AXES)}
   WHERE {" + ".join(f"(pc.{a} - dc.{a}) * (pc.{a} - dc.{a})" for a in geo.AXES)} < {THRESHOLD} * {THRESHOLD}),"""


@query("P08 A06 A07 A08 K05 J12", f"""{GEOMETRY_CTE}, {_RAD}, {_FRAME_SQL},
mo AS (SELECT j.obj, j.joint FROM {J} j JOIN f USING (obj) LEFT JOIN rad ON rad.obj = j.obj AND rad.joint = j.joint WHERE j.type <> 'fixed' AND abs(j.upper - j.lower) >= 1e-6
  AND CASE WHEN j.type = 'prismatic' THEN abs(j.upper - j.lower) * scale ELSE abs(j.upper - j.lower) * coalesce(radius, 0) * scale END >= 0.1),
mv AS (SELECT m.* FROM moved m JOIN mo ON mo.obj = m.obj AND mo.joint = m.joint),
{SPLIT_SQL.split("AND abs(upper - lower) >= 1e-6),", 1)[1]}, {SAMPLE_SQL} {_POSED_SQL} {HIT_SQL} tch AS {_GAIN_SQL},
s AS (SELECT obj, key, count(*) AS n_joints FROM (SELECT obj, key, joint FROM act UNION ALL SELECT obj, key, joint FROM pas) GROUP BY obj, key),
rw AS (SELECT r.obj, r.key, r.role = 'moving' OR g.label IS NOT NULL AS moves FROM roles r LEFT JOIN gain g ON g.obj = r.obj AND g.key = r.key AND g.label = r.label)
SELECT rw.obj, rw.key, CAST(count(*) FILTER (moves) AS BIGINT) AS n_moving, CAST(count(*) FILTER (NOT moves) AS BIGINT) AS n_body, CAST(max(s.n_joints) AS BIGINT) AS n_joints
FROM rw JOIN s ON s.obj = rw.obj AND s.key = rw.key GROUP BY rw.obj, rw.key""")
def corpus_splits(t: Tables) -> DataFrame:
    """The whole corpus job with the motion filter and promotion over area samples of the faces, as split sizes."""
    vertices = durable(ad.vertices(t))
    c = corpus.build(ad.joints(t), ad.parts(t).select("obj", "label"), vertices, faces=strip_faces(t, vertices))
    return _split_sizes(c)


@query("K01", f"""{CLOSURE_SQL}, {SPLIT_SQL},
o AS (SELECT obj, min(factory) AS factory FROM {P} GROUP BY obj), k AS (SELECT obj, count(DISTINCT key) AS n FROM roles GROUP BY obj), j AS (SELECT obj, count(*) AS n FROM jo GROUP BY obj)
SELECT o.obj, o.factory, CAST(pp.n AS BIGINT) AS n_parts, CAST(coalesce(j.n, 0) AS BIGINT) AS n_joints, CAST(coalesce(k.n, 0) AS BIGINT) AS n_splits,
  CAST(coalesce((SELECT count(*) FROM roles r WHERE r.obj = o.obj AND r.key = 'default' AND r.role = 'moving'), 0) AS BIGINT) AS n_default
FROM o JOIN (SELECT obj, count(*) AS n FROM {P} GROUP BY obj) pp USING (obj) LEFT JOIN k USING (obj) LEFT JOIN j USING (obj)""")
def metadata_records(t: Tables) -> DataFrame:
    """Nested metadata documents, read back and counted."""
    ordered, moved = movable_parts(t)
    moving, _ = sp.build_splits(ordered, moved)
    parts = ad.parts(t).select("obj", "label", "name", "factory", "movement", cat.moves_by_text(F.col("movement")).alias("is_moving"))
    frames = geo.normal_frames(ad.vertices(t), ["obj"])
    objects = parts.groupBy("obj").agg(F.min("factory").alias("factory")).join(frames, "obj").withColumns({"source": F.lit("net"), "category": F.col("factory")})
    axes = joint_axes(t).select("obj", "joint", *[F.col(f"wo{i}").alias(f"o{i}") for i in range(3)], *[F.col(f"wd{i}").alias(f"d{i}") for i in range(3)])
    joints = ordered.select("obj", "joint", "type", (F.col("upper") - F.col("lower")).alias("span")).join(axes, ["obj", "joint"])
    docs = out.metadata_documents(objects, parts, joints, sp.split_roles(moving, parts))
    schema = "parts map<string,struct<name:string>>, joints array<struct<name:string>>, splits map<string,struct<moving:array<bigint>>>"
    d = docs.select("obj", "factory", F.from_json("text", schema).alias("d"))
    def size(c) -> Column:
        return F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0)).cast("bigint")
    return d.select("obj", "factory", size("d.parts").alias("n_parts"), size("d.joints").alias("n_joints"), size("d.splits").alias("n_splits"),
                    size(F.try_element_at("d.splits", F.lit("default"))["moving"]).alias("n_default"))


@query("K03", f"""{GEOMETRY_CTE}, {SPLIT_SQL}, {_FRAME_SQL},
s AS (SELECT act.obj, act.key, row_number() OVER (PARTITION BY act.obj, act.key ORDER BY act.joint) - 1 AS slot, ax.* FROM act JOIN ax ON ax.obj = act.obj AND ax.joint = act.joint)
SELECT concat(CAST(obj AS STRING), '/', key) AS path, concat('joint_', type, '_', CAST(slot AS STRING)) AS joint, type, concat('moving_link_', CAST(slot AS STRING)) AS child,
  true AS axis_given, type <> 'continuous' AS limit_given, CASE WHEN type = 'continuous' THEN 0.0 ELSE round(abs(upper - lower), 4) END AS upper FROM s""")
def verification_urdf(t: Tables) -> DataFrame:
    """Tensor rows written as verification documents and read back."""
    ordered, moved = movable_parts(t)
    _, active = sp.build_splits(ordered, moved)
    axes = joint_axes(t).select("obj", "joint", *corpus.AXIS)
    joints = ordered.join(axes, ["obj", "joint"]).join(geo.normal_frames(ad.vertices(t), ["obj"]).drop("flat"), "obj")
    rows = sp.tensor_rows(active, joints).withColumn("path", F.concat_ws("/", "obj", "key"))
    tj = out.tensor_joints(rows).withColumns({f"rpy{i}": F.lit(0.0) for i in range(3)})
    links = tj.select("path", "ord", F.col("child").alias("link"), F.lit("part1.obj").alias("mesh")).unionByName(
        tj.select("path").distinct().select("path", F.lit(-1).cast("bigint").alias("ord"), F.lit("base_link").alias("link"), F.lit("part0.obj").alias("mesh")))
    back = assets.joint_rows(assets.parse_urdf(out.urdf_documents(links, tj)))
    return back.select("path", "joint", "type", "child", "axis_given", "limit_given", F.round("upper", 4).alias("upper"))


@query("K02", f"""{GEOMETRY_CTE},
c AS (SELECT obj, part, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {V} GROUP BY obj, part)
SELECT j.obj, j.joint, concat('joint_', j.type) AS prefix, {rsql([f"ax.wo{i} - coalesce(c.c{a}, 0)" for i, a in enumerate("xyz")], ["o0", "o1", "o2"], 4)},
  CASE WHEN j.type = 'continuous' OR j.label % 4 = 1 THEN -1.0 ELSE least(j.lower, CASE WHEN j.label % 4 = 2 THEN -0.75 ELSE j.upper END) END AS lower,
  CASE WHEN j.type = 'continuous' THEN 1.0 ELSE greatest(CASE WHEN j.label % 4 = 1 THEN -1.0 ELSE j.lower END, CASE WHEN j.label % 4 = 2 THEN -0.75 ELSE j.upper END) END AS upper
FROM {J} j JOIN ax ON ax.obj = j.obj AND ax.joint = j.joint LEFT JOIN c ON c.obj = j.obj AND concat('l_', CAST(c.part AS STRING)) = j.parent""")
def converted_urdf(t: Tables) -> DataFrame:
    """Joints of converted documents; one label in four lacks its lower limit, another has a low upper one."""
    joints = ad.joints(t).withColumn("lower", F.when(F.col("label") % 4 != 1, F.col("lower"))).withColumn(
        "upper", F.when(F.col("label") % 4 == 2, -0.75).otherwise(F.col("upper")))
    axes = joint_axes(t).select("obj", "joint", *corpus.AXIS)
    centres = geo.centroids(ad.vertices(t), ["obj", "part"]).withColumnRenamed("part", "label")
    rows = out.converted_joints(joints.join(axes, ["obj", "joint"]), centres, ["obj"])
    return rows.select("obj", "joint", "prefix", *rounded(["o0", "o1", "o2"], 4), "lower", "upper")


# -- listings -----------------------------------------------------------------------------

@query("S02", """
WITH l AS (SELECT url AS path, max(page_id) AS modified FROM pages GROUP BY url) SELECT path, modified FROM l WHERE NOT starts_with(path, 'https') OR contains(path, '?')""")
def catalogue_refresh(t: Tables) -> DataFrame:
    """Plain http files were never loaded, those with a query part have changed since."""
    now = t.pages.groupBy(F.col("url").alias("path")).agg(F.max("page_id").alias("modified"))
    changed = F.col("path").contains("?").cast("int")
    loaded = now.where("startswith(path, 'https')").select("path", (F.col("modified") - changed).alias("modified"))
    return files.refresh(now, loaded)


@query("S03", f"""
SELECT factory AS category, CASE WHEN label % 4 = 0 THEN concat('d', CAST(obj * 8 + label AS STRING)) ELSE CAST(obj * 8 + label AS STRING) END AS model, concat('d', CAST(obj * 8 + label AS STRING)) AS folder
FROM {P} WHERE size % 9 <> 0""")
def model_catalogue(t: Tables) -> DataFrame:
    """Meta documents; one size in nine is broken, one label in four has no id."""
    key = (F.col("obj") * 8 + F.col("label")).cast("string")
    meta = F.to_json(F.struct(F.col("factory").alias("model_cat"), F.when(F.col("label") % 4 != 0, key).alias("anno_id")))
    text = F.when(F.col("size") % 9 == 0, F.concat(F.lit("{"), meta)).otherwise(meta)
    docs = ad.parts(t).select(F.concat(F.lit("/models/d"), key, F.lit("/meta.json")).alias("path"), text.alias("text"))
    return files.model_rows(docs)


@query("S11 A10", f"""
WITH k AS (SELECT DISTINCT factory AS category, brand AS set, CASE size % 4 WHEN 0 THEN 'color' WHEN 1 THEN 'roughness' WHEN 2 THEN 'normalgl' ELSE 'preview' END AS kind FROM {P})
SELECT category, set, kind FROM k WHERE kind <> 'preview' AND EXISTS (SELECT 1 FROM k c WHERE c.category = k.category AND c.set = k.set AND c.kind = 'color')""")
def texture_sets(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Color", "Roughness", "NormalGL", "Preview")]), (F.col("size") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/tex/"), "factory", F.lit("/"), "brand", F.lit("/x_2K_"), kind, F.lit(".jpg"))
    return files.texture_sets(ad.parts(t).select(path.alias("path")).distinct()).select("category", "set", "kind")


@query("S11", f"SELECT DISTINCT factory, CAST(obj AS STRING) AS seed, 'scene.urdf' AS file FROM {P} WHERE label = 0")
def scene_listing(t: Tables) -> DataFrame:
    """Factories and seeds that have a scene document, from a file listing."""
    name = F.when(F.col("label") == 0, "scene.urdf").otherwise("part.obj")
    path = F.concat_ws("/", F.lit("/out"), "factory", F.col("obj").cast("string"), name)
    listing = files.path_parts(ad.parts(t).select(path.alias("path")))
    return listing.where("file = 'scene.urdf'").select("factory", "seed", "file").distinct()


@query("S21", f"SELECT obj, label, o0 AS fx, o1 AS fy, 3.5 AS cx, 2.5 AS cy, ax0 AS r0, ax1 AS r4, upper AS t0, lower AS t2, CAST(480 AS BIGINT) AS height FROM {J}")
def camera_table(t: Tables) -> DataFrame:
    def arr(*v) -> Column:
        return F.array(*[c if isinstance(c, Column) else F.lit(float(c)) for c in v])
    c = F.col
    cams = ad.joints(t).select("obj", "label", arr(c("o0"), 0, 3.5, 0, c("o1"), 2.5, 0, 0, 1).alias("K"),
                               arr(c("ax0"), 0, 0, c("upper"), 0, c("ax1"), 0, 0, 0, 0, 1, c("lower"), 0, 0, 0, 1).alias("T"),
                               F.array(F.lit(480).cast("bigint"), F.lit(640).cast("bigint")).alias("hw"))
    return files.camera_rows(cams, ["obj", "label"]).select("obj", "label", "fx", "fy", "cx", "cy", "r0", "r4", "t0", "t2", "height")


# -- keyed draws --------------------------------------------------------------------------

_U = uniform_sql("o_orderkey")


@query("X32", f"""
SELECT o_orderkey, round({_U}, 8) AS u, round({_U} * 3 + 2, 8) AS rng, round(exp({_U} * (ln(100.0) - ln(0.1)) + ln(0.1)), 6) AS lg, CAST(floor({_U} * 6) + 5 AS BIGINT) AS i,
  CASE WHEN {_U} < 0.5 THEN 'a' WHEN {_U} < 0.75 THEN 'b' ELSE 'c' END AS w, round(degrees(asin({_U} * (1 - 0.5) + 0.5)), 6) AS elev, round(power(10.0, {_U} * 3 - 1), 6) AS p10,
  round(least(greatest(10 + 2 * sqrt(-2 * ln(greatest({uniform_sql("o_orderkey", "'u'")}, 1e-12))) * cos(2 * pi() * {uniform_sql("o_orderkey", "'v'")}), 8), 12), 6) AS cn FROM orders""")
def keyed_draws(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k, F.round(sc.uniform(k), 8).alias("u"), F.round(sc.uniform_between(2.0, 5.0, k), 8).alias("rng"), F.round(sc.log_uniform(0.1, 100.0, k), 6).alias("lg"),
        sc.integer_between(5, 10, k).alias("i"), sc.weighted_choice([("a", 2.0), ("b", 1.0), ("c", 1.0)], k).alias("w"), F.round(sc.sphere_elevation(30.0, 90.0, k), 6).alias("elev"),
        F.round(sc.power10(-1, 2, k), 6).alias("p10"), F.round(sc.clipped_normal(10.0, 2.0, 8.0, 12.0, k), 6).alias("cn"))


def _z(i: int) -> str:
    u, v = (uniform_sql("o_orderkey", f"'z{i}'", f"'{c}'") for c in "uv")
    return f"least(greatest(sqrt(-2 * ln(greatest({u}, 1e-12))) * cos(2 * pi() * {v}), -1), 1) AS z{i}"


_SHOWN = {n: f"least(greatest(v - v * s * greatest(0, least({k}, 4 - {k}, 1)), 0), 1)" for n, k in (("r", "k5"), ("g", "k3"), ("b", "k1"))}


@query("X33", f"""
WITH d AS (SELECT o_orderkey, {uniform_sql("o_orderkey", "'component'")} < 0.7 AS first, {", ".join(map(_z, range(3)))} FROM orders),
h AS (SELECT o_orderkey, CASE WHEN first THEN 0.1 + 0.02 * z0 ELSE 0.6 + 0.01 * z0 END AS h, CASE WHEN first THEN 0.5 + 0.01 * z0 + 0.05 * z1 ELSE 0.4 + 0.04 * z1 END AS s,
  least(greatest(CASE WHEN first THEN 0.6 + 0.02 * z1 + 0.1 * z2 ELSE 0.5 + 0.01 * z0 + 0.2 * z2 END, 0.1), 0.9) AS v FROM d),
w AS (SELECT o_orderkey, s, v, (h - floor(h)) * 6 AS h6 FROM h),
k AS (SELECT *, {", ".join(f"({n} + h6) - 6 * floor(({n} + h6) / 6) AS k{n}" for n in (1, 3, 5))} FROM w),
c AS (SELECT o_orderkey, {", ".join(f"{e} AS {n}" for n, e in _SHOWN.items())} FROM k)
SELECT o_orderkey, {", ".join(f"round(CASE WHEN {n} <= 0.04045 THEN {n} / 12.92 ELSE power(({n} + 0.055) / 1.055, 2.4) END, 6) AS {n}" for n in "rgb")} FROM c""")
def palette_samples(t: Tables) -> DataFrame:
    """One colour per order from a two-part palette."""
    comps = [(0.7, (0.1, 0.5, 0.6), (0.02, 0, 0, 0.01, 0.05, 0, 0, 0.02, 0.1)), (0.3, (0.6, 0.4, 0.5), (0.01, 0, 0, 0, 0.04, 0, 0.01, 0, 0.2))]
    rgb = sc.palette_colour(comps, F.col("o_orderkey"))
    return t.orders.select("o_orderkey", *[F.round(c, 6).alias(n) for c, n in zip(rgb, "rgb")])


@query("X25", f"""
WITH h AS (SELECT o_orderkey, o_orderkey % 256 AS r, o_orderkey * 7 % 256 AS g, o_orderkey * 13 % 256 AS b FROM orders)
SELECT o_orderkey, {", ".join(f"round({c} / 255.0, 8) AS {c}, round(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END, 6) AS l{c}" for c in "rgb")} FROM h""")
def colour_conversion(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.format_string("#%02x%02x%02x", k % 256, k * 7 % 256, k * 13 % 256)
    rgb = t.orders.select(k, *[c.alias(n) for c, n in zip(sc.hex_to_rgb(text), "rgb")])
    return rgb.select("o_orderkey", *[F.round(n, 8).alias(n) for n in "rgb"], *[F.round(sc.srgb_to_linear(F.col(n)), 6).alias(f"l{n}") for n in "rgb"])


@query("X36", f"SELECT obj, joint, CASE WHEN joint = 'j_1' THEN 2.5 ELSE 0.0 END AS stiffness, CASE joint WHEN 'j_1' THEN 0.5 WHEN 'j_2' THEN 0.25 ELSE 0.0 END AS damping, CAST(0 AS DOUBLE) AS friction FROM {J}")
def joint_dynamics(t: Tables) -> DataFrame:
    def entry(**v: float):
        return F.create_map(*[x for k, n in v.items() for x in (F.lit(k), F.lit(n))])
    params = F.create_map(F.lit("j_1"), entry(stiffness=2.5, damping=0.5), F.lit("j_2"), entry(damping=0.25))
    return ad.joints(t).select("obj", "joint", *sc.joint_dynamics(params, F.col("joint")))


# -- function surface ---------------------------------------------------------------------

@query("F06", f"SELECT obj, label, i, word FROM (SELECT obj, label, unnest(string_split(material, ' ')) AS word, unnest(range(1, len(string_split(material, ' ')) + 1)) AS i FROM {P})")
def table_function(t: Tables) -> DataFrame:
    """Text to rows by a native generator used like a table function."""
    return ad.parts(t).select("obj", "label", F.posexplode(F.split("material", " ")).alias("i", "word")).withColumn("i", (F.col("i") + 1).cast("bigint"))

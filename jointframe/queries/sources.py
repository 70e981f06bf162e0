"""Source and sink queries: text is rendered from the tables by Spark, parsed again and checked against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe.functions import scalar as sc
from jointframe.plans.ordered import ranked
from jointframe.queries.geometry import rounded
from jointframe.registry import query
from jointframe.session import Tables, durable, new_folder
from jointframe.sinks import text as out
from jointframe.sources import assets, files, logs

P, J, V = ad.parts.sql, ad.joints.sql, ad.vertices.sql


def as_lines(df: DataFrame, line, path=None) -> DataFrame:
    """Wrap an expression as scanned lines."""
    return df.select((F.lit("log") if path is None else path).alias("path"), F.lit(0).cast("bigint").alias("_blk"),
                     F.monotonically_increasing_id().alias("seq"), line.alias("line"))


# -- object JSON --------------------------------------------------------------------------

def object_texts(t: Tables) -> DataFrame:
    """One JSON document per object; one in eleven is cut off, one in seven has no category."""
    code = F.create_map(*[F.lit(x) for x in ("revolute", "A", "prismatic", "B", "continuous", "C")])[F.col("type")]
    joint = F.concat(F.lit("[["), F.col("label").cast("string"), F.lit('],"0",['), F.concat_ws(
        ",", *[F.col(c).cast("string") for c in ("ax0", "ax1", "ax2", "o0", "o1", "o2", "lower", "upper")]), F.lit('],"'), code, F.lit('"]'))
    static = F.concat(F.lit("["), F.col("label").cast("string"), F.lit("]"))
    group = F.concat(F.lit('"'), F.col("label").cast("string"), F.lit('":'), F.when(F.col("type") == "fixed", static).otherwise(joint))
    groups = ad.joints(t).groupBy("obj").agg(F.array_join(F.array_sort(F.collect_list(group)), ",").alias("g"))
    part = F.to_json(F.struct("label", "name", F.when(F.col("size") % 4 != 0, F.col("material")).alias("material"), F.col("movement").alias("Movement_description")))
    parts = ad.parts(t).groupBy("obj").agg(F.array_join(F.array_sort(F.collect_list(part)), ",").alias("p"), F.min("factory").alias("c"))
    head = F.when(F.col("obj") % 7 == 0, "").otherwise(F.concat(F.lit('"category":"'), "c", F.lit('",')))
    text = F.concat(F.lit("{"), head, F.lit('"object_name":"o'), F.col("obj").cast("string"), F.lit('","parts":['), "p", F.lit('],"group_info":{'), "g", F.lit("}}"))
    cut = F.when(F.col("obj") % 11 == 0, F.substring(text, 1, 40)).otherwise(text)
    return parts.join(groups, "obj").select(F.col("obj").cast("string").alias("path"), cut.alias("text"))


@query("S01", f"""
SELECT CAST(obj AS STRING) AS path, CASE WHEN obj % 7 = 0 THEN 'Unknown' ELSE min(factory) END AS category,
  concat('o', CAST(obj AS STRING)) AS object_name, CAST(count(*) AS BIGINT) AS n_parts FROM {P} WHERE obj % 11 <> 0 GROUP BY obj""")
def object_json_scan(t: Tables) -> DataFrame:
    return assets.object_rows(assets.parse_objects(object_texts(t)))


@query("S01", f"""
SELECT CAST(obj AS STRING) AS path, label, name, CASE WHEN size % 4 <> 0 THEN material ELSE 'Unknown' END AS material,
  '1.0 g/cm^3' AS density, CAST(1.0 AS DOUBLE) AS youngs, CAST(0.3 AS DOUBLE) AS poisson, movement FROM {P} WHERE obj % 11 <> 0""")
def part_json_scan(t: Tables) -> DataFrame:
    return assets.part_rows(assets.parse_objects(object_texts(t)))


@query("S01 P05", f"""
SELECT CAST(obj AS STRING) AS path, label AS gid, CASE WHEN type = 'fixed' THEN 'static' ELSE 'joint' END AS kind,
  CASE WHEN type = 'fixed' THEN '-' ELSE type END AS type, CAST(label AS STRING) AS labels,
  CASE WHEN type = 'fixed' THEN -1.0 ELSE upper END AS upper FROM {J} WHERE obj % 11 <> 0""")
def group_json_scan(t: Tables) -> DataFrame:
    g = assets.group_rows(assets.parse_objects(object_texts(t)))
    return g.select("path", "gid", "kind", F.coalesce("type", F.lit("-")).alias("type"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"),
                    F.coalesce(F.get("params", F.lit(7)), F.lit(-1.0)).alias("upper"))


@query("S01", f"SELECT DISTINCT CAST(obj AS STRING) AS path FROM {P} WHERE obj % 11 = 0")
def object_json_rejects(t: Tables) -> DataFrame:
    return assets.rejected_objects(object_texts(t))


# -- URDF ---------------------------------------------------------------------------------

def urdf_texts(t: Tables) -> DataFrame:
    path = F.col("obj").cast("string").alias("path")
    joints = ad.joints(t).withColumn("ord", F.col("label")).select(path, *[c for c in (*ad.joints.columns, "ord") if c != "obj"])
    links = ad.parts(t).select(path, F.col("label").alias("ord"), F.concat(F.lit("l_"), F.col("label").cast("string"),
                               F.when(F.col("size") % 10 == 0, "_helper").otherwise("")).alias("link"),
                               F.when(F.col("size") % 6 != 0, F.concat(F.lit("objs/"), "label", F.lit(".obj"))).alias("mesh"))
    return out.urdf_documents(links, joints)


@query("S04 K02", f"""
SELECT CAST(obj AS STRING) AS path, concat('l_', CAST(label AS STRING), CASE WHEN size % 10 = 0 THEN '_helper' ELSE '' END) AS link,
  size % 10 = 0 AS is_helper, label AS part, CAST(CASE WHEN size % 6 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_visuals,
  CASE WHEN size % 6 <> 0 THEN concat('objs/', CAST(label AS STRING), '.obj') ELSE '-' END AS mesh FROM {P}""")
def urdf_links(t: Tables) -> DataFrame:
    rows = assets.link_rows(assets.parse_urdf(urdf_texts(t)))
    return rows.select("path", "link", "is_helper", "part", "n_visuals", F.coalesce("mesh", F.lit("-")).alias("mesh"))


@query("S05 K02", f"""
SELECT CAST(obj AS STRING) AS path, joint, type, parent, child,
  CASE WHEN type = 'fixed' OR (type = 'continuous' AND abs(lower) <= 1e-6 AND abs(upper) <= 1e-6) THEN 0.0 ELSE lower END AS lower,
  CASE WHEN type = 'fixed' THEN 0.0 ELSE upper END AS upper, type <> 'fixed' AS axis_given,
  CASE WHEN type = 'fixed' THEN 1.0 ELSE ax0 END AS ax0, CASE WHEN type = 'fixed' THEN 0.0 ELSE ax1 END AS ax1,
  CASE WHEN type = 'fixed' THEN 0.0 ELSE ax2 END AS ax2, o0, o1, o2, rpy0, rpy1, rpy2 FROM {J}""")
def urdf_joints(t: Tables) -> DataFrame:
    return assets.joint_rows(assets.parse_urdf(urdf_texts(t))).drop("limit_given").select(
        "path", "joint", "type", "parent", "child", "lower", "upper", "axis_given", *[f"{p}{i}" for p in ("ax", "o", "rpy") for i in range(3)])


@query("K02", f"""
SELECT CAST(obj AS STRING) AS path, CASE WHEN type = 'fixed' THEN concat('joint_fixed_world_', CAST(label AS STRING))
   ELSE concat('joint_', type, '_l_world_abstract_0_', CAST(label AS STRING)) END AS joint, type,
  CASE WHEN type = 'fixed' THEN concat('l_', CAST(label AS STRING)) ELSE concat('abstract_0_', CAST(label AS STRING)) END AS child FROM {J} WHERE obj % 11 <> 0
UNION ALL SELECT CAST(obj AS STRING), concat('joint_fixed_abstract_0_', CAST(label AS STRING), '_', CAST(label AS STRING)), 'fixed',
  concat('l_', CAST(label AS STRING)) FROM {J} WHERE type <> 'fixed' AND obj % 11 <> 0""")
def urdf_from_groups(t: Tables) -> DataFrame:
    """Group records written as URDF and read back; joint groups are renumbered so that all hang on the world."""
    groups = assets.group_rows(assets.parse_objects(object_texts(t)))
    rooted = groups.withColumn("parent", F.when(F.col("kind") == "joint", F.lit(0).cast("bigint")))
    links, joints = out.group_links(rooted.where("kind = 'static'").unionByName(
        rooted.where("kind = 'joint'").withColumn("gid", F.col("gid") + 100).withColumn("parent", F.lit(0).cast("bigint"))))
    def plain(c: str):
        return F.regexp_replace(c, r"abstract_0_1(0[0-9])", r"abstract_0_$1").alias(c)
    numbered = joints.withColumn("ord", F.col("joint"))
    docs = out.urdf_documents(links.distinct().withColumn("ord", F.col("link")).withColumn("mesh", F.lit(None).cast("string")), numbered)
    rows = assets.joint_rows(assets.parse_urdf(docs)).select("path", plain("joint"), "type", plain("child"))
    return rows.select("path", F.regexp_replace("joint", "abstract_0_0", "abstract_0_").alias("joint"), "type",
                       F.regexp_replace("child", "abstract_0_0", "abstract_0_").alias("child"))


# -- OBJ and MTL --------------------------------------------------------------------------

def meshes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, faces and material lines of every part; one face per vertex in the four token forms."""
    numbered = ranked(ad.vertices(t), ["obj", "part"], ad.VERTEX_ORDER, "idx", reread=True).withColumn("path", F.concat_ws("/", "obj", "part"))
    # Four kinds of lines are made from these rows.
    v = durable(numbered.select("obj", "part", "path", "idx", *"xyz"))
    i = F.col("idx")
    zero = F.lit(0).cast("bigint")
    corner = F.struct(i.alias("v"), F.when(i % 2 == 0, i).otherwise(zero).alias("vt"), F.when(i % 4 >= 2, F.lit(1).cast("bigint")).otherwise(zero).alias("vn"))
    first = F.struct(F.lit(-1).cast("bigint").alias("v"), zero.alias("vt"), zero.alias("vn"))
    faces = v.select("path", "idx", F.array(corner, first, corner).alias("corners"))
    materials = v.where("idx % 3 = 1").select("path", (i - 1).alias("n_faces"), F.lit(0).alias("ord"), F.lit("usemtl").alias("directive"),
                                              F.concat(F.lit("m"), (i % 5).cast("string")).alias("value"))
    return v, faces, materials


def mesh_records(t: Tables) -> DataFrame:
    v, faces, materials = meshes(t)
    order = ["sec", "pos", "sub"]
    libraries = v.where("idx = 1").select("path", F.lit(1).alias("ord"), F.concat("obj", F.lit(".mtl")).alias("value"))
    lines = out.obj_lines(v.select("path", "idx", "x", "y", "z"), faces, materials=materials, libraries=libraries)
    return assets.obj_records(lines, order, blocked=False)


_IDX = f"""(SELECT concat(CAST(obj AS STRING), '/', CAST(part AS STRING)) AS path, x, y, z,
  CAST(row_number() OVER (PARTITION BY obj, part ORDER BY ord1, ord2, ord3, ord4, ord5, x, y, z) AS BIGINT) AS idx FROM {V})"""


@query("S06 K04", f"SELECT path, idx, x, y, z FROM {_IDX}")
def obj_vertices(t: Tables) -> DataFrame:
    return assets.obj_points(mesh_records(t))


@query("S06 K04", f"""
SELECT path, idx, CAST(3 AS BIGINT) AS n, idx AS v0, CASE WHEN idx % 2 = 0 THEN idx ELSE 0 END AS vt0, CAST(CASE WHEN idx % 4 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS vn0,
  CAST(-1 AS BIGINT) AS v1 FROM {_IDX}""")
def obj_faces(t: Tables) -> DataFrame:
    c = F.col("corners")
    return assets.obj_faces(mesh_records(t)).select("path", "idx", F.size(c).cast("bigint").alias("n"), c[0]["v"].alias("v0"), c[0]["vt"].alias("vt0"),
                                                    c[0]["vn"].alias("vn0"), c[1]["v"].alias("v1"))


@query("S06 K04", f"""
SELECT path, 'usemtl' AS directive, concat('m', CAST(idx % 5 AS STRING)) AS value, idx - 1 AS n_faces, CAST((idx + 2) // 3 + 1 AS BIGINT) AS ord FROM {_IDX} WHERE idx % 3 = 1
UNION ALL SELECT path, 'mtllib', concat(split_part(path, '/', 1), '.mtl'), CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM {_IDX} WHERE idx = 1""")
def obj_material_runs(t: Tables) -> DataFrame:
    return assets.obj_materials(mesh_records(t))


@query("W05", f"""
WITH n AS (SELECT obj, part, count(*) AS n FROM {V} GROUP BY obj, part),
o AS (SELECT obj, part, coalesce(sum(n) OVER (PARTITION BY obj ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
SELECT i.path, i.idx, CAST(i.idx + o.off AS BIGINT) AS v0, CAST(CASE WHEN i.idx % 2 = 0 THEN i.idx + o.off ELSE 0 END AS BIGINT) AS vt0, CAST(-1 AS BIGINT) AS v1
FROM {_IDX} i JOIN o ON i.path = concat(CAST(o.obj AS STRING), '/', CAST(o.part AS STRING))""")
def merged_faces(t: Tables) -> DataFrame:
    """Face indices after all parts of an object are merged into one mesh."""
    v, faces, _ = meshes(t)
    counts = v.groupBy("obj", "part", "path").agg(F.count("*").alias("v"))
    counts = counts.withColumns({"vt": F.col("v"), "vn": F.col("v")})
    offsets = assets.merge_offsets(counts, ["obj"], "part", ["v", "vt", "vn"]).select("path", "off_v", "off_vt", "off_vn")
    moved = assets.shift_corners(faces, offsets, ["path"])
    c = F.col("corners")
    return moved.select("path", "idx", c[0]["v"].alias("v0"), c[0]["vt"].alias("vt0"), c[1]["v"].alias("v1"))


@query("S07 A11", f"""
WITH k AS (SELECT obj, label, row_number() OVER (PARTITION BY obj ORDER BY label) AS rn, size / 64.0 AS r, label / 8.0 AS g FROM {P})
SELECT CAST(obj AS STRING) AS path, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(0.5 AS DOUBLE) AS b FROM k WHERE rn = 1""")
def mtl_colours(t: Tables) -> DataFrame:
    """First diffuse colour per material file."""
    line = F.concat_ws(" ", F.lit("  Kd"), (F.col("size") / 64.0).cast("string"), (F.col("label") / 8.0).cast("string"), F.lit("0.5"))
    rows = ad.parts(t).select(F.col("obj").cast("string").alias("path"), F.lit(0).alias("_blk"), F.col("label").alias("seq"), line.alias("line"))
    maps = rows.withColumn("line", F.lit("map_Kd wood.png"))
    return assets.material_colours(rows.unionByName(maps))


# -- small formats ------------------------------------------------------------------------

@query("S08", f"""
SELECT CAST(obj AS STRING) AS path, concat('link_', CAST(label AS STRING)) AS link, CASE WHEN size % 2 = 0 THEN 'hinge' ELSE 'slider' END AS motion,
  CASE WHEN size % 3 = 0 THEN 'unknown' ELSE brand END AS semantic FROM {P} WHERE size % 5 <> 0""")
def semantics_scan(t: Tables) -> DataFrame:
    """Lines of one token (one size in five) are skipped."""
    link = F.concat(F.lit("link_"), F.col("label").cast("string"))
    motion = F.when(F.col("size") % 2 == 0, "hinge").otherwise("slider")
    line = F.when(F.col("size") % 5 == 0, link).when(F.col("size") % 3 == 0, F.concat_ws("  ", link, motion)).otherwise(F.concat_ws(" ", link, motion, "brand"))
    return assets.semantics_rows(as_lines(ad.parts(t), line, F.col("obj").cast("string")))


@query("S09", f"SELECT CAST(obj AS STRING) AS path, label AS part, o0 AS x, o1 AS y, o2 AS z FROM {J}")
def origins_scan(t: Tables) -> DataFrame:
    entry = F.struct(F.col("label").cast("string"), F.array("o0", "o1", "o2"))
    docs = ad.joints(t).groupBy(F.col("obj").cast("string").alias("path")).agg(F.collect_list(entry).alias("e"))
    world = F.array(F.struct(F.lit("world"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    text = F.to_json(F.map_from_entries(F.concat(world, "e")))
    return assets.origin_rows(docs.select("path", text.alias("text")))


@query("S10", f"""
SELECT CAST(obj AS STRING) AS path, CAST(i AS BIGINT) AS instance, label AS part, name FROM {P}, range(2) r(i)""")
def part_list_scan(t: Tables) -> DataFrame:
    part = F.struct(F.col("name").alias("part_name"), F.concat(F.col("label").cast("string"), F.lit(".obj")).alias("file_name"))
    docs = ad.parts(t).groupBy(F.col("obj").cast("string").alias("path")).agg(F.struct(F.collect_list(part).alias("part")).alias("i"))
    return assets.part_list_rows(docs.select("path", F.to_json(F.array("i", "i")).alias("text")))


@query("S25 S26", f"""
SELECT CAST(obj AS STRING) AS path, label AS object_index, name, CAST(size AS BIGINT) AS num_verts, concat(factory, '.', brand) AS tags,
  label * 10 AS first_instance FROM {P}""")
def frame_objects_scan(t: Tables) -> DataFrame:
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)])
    entry = F.struct(F.col("label").alias("object_index"), "name", F.col("size").alias("num_verts"), F.array("factory", "brand").alias("tags"),
                     F.array(F.array(F.col("label") * 10, F.lit(1).cast("bigint"))).alias("instance_ids"), F.array(eye).alias("model_matrices"))
    docs = ad.parts(t).groupBy(F.col("obj").cast("string").alias("path")).agg(F.to_json(F.collect_list(entry)).alias("text"))
    rows = assets.frame_object_rows(docs)
    inst = assets.instance_rows(rows).select("path", "object_index", F.col("instance_id")[0].alias("first_instance"))
    return rows.select("path", "object_index", "name", "num_verts", F.array_join("tags", ".").alias("tags")).join(inst, ["path", "object_index"])


# -- logs ---------------------------------------------------------------------------------

JOBS = ad.jobs.sql


def accounting_lines(t: Tables) -> DataFrame:
    gpu = F.when(F.col("gpus") > 0, F.concat(F.lit(",gpu="), F.col("gpus").cast("string"))).otherwise("")
    res = F.concat(F.lit("cpu="), F.col("cpus").cast("string"), F.lit(",mem=16G"), gpu)
    node = F.when(F.col("job_id") % 13 == 0, "None").otherwise(F.col("node"))
    line = F.concat_ws("   ", F.col("job_id").cast("string"), F.concat_ws("_", F.lit("run"), F.col("scene").cast("string"), "stage"), res,
                       F.col("elapsed_s").cast("string"), "state", node, F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("x"))
    return as_lines(ad.jobs(t), line)


@query("S13 X29", f"""
SELECT job_id, concat('run_', CAST(scene AS STRING), '_', stage) AS name, '16G' AS req_mem, cpus AS cpu, gpus AS gpu, elapsed_s, state, node,
  epoch_us(start) // 1000000 AS start_s, epoch_us(start) // 1000000 + elapsed_s AS end_s FROM {JOBS} WHERE job_id % 13 <> 0""")
def accounting_scan(t: Tables) -> DataFrame:
    rows = logs.accounting_rows(accounting_lines(t))
    def secs(c: str):
        return F.unix_seconds(F.col(c).cast("timestamp")).alias(f"{c}_s")
    return rows.select("job_id", "name", "req_mem", "cpu", "gpu", "elapsed_s", "state", "node", secs("start"), secs("end"))


@query("S14", f"""
SELECT job_id, concat('run_', CAST(scene AS STRING)) AS name, CASE WHEN gpus = 0 THEN '(Priority)' ELSE '(Resources)' END AS state
FROM {JOBS} WHERE cpus % 2 = 0""")
def queue_scan(t: Tables) -> DataFrame:
    """Waiting jobs of the run; other runs' jobs are left out."""
    run = F.when(F.col("cpus") % 2 == 0, "run_").otherwise("other_")
    line = F.concat(F.lit("   "), F.col("job_id").cast("string"), F.lit("  "), run, F.col("scene").cast("string"), F.lit("   "),
                    F.when(F.col("gpus") == 0, "(Priority)").otherwise("(Resources)"))
    return logs.queued_rows(as_lines(ad.jobs(t), line), "run_")


@query("S15 X28", f"""
SELECT job_id, CASE gpus WHEN 0 THEN elapsed_s / 1e6 WHEN 1 THEN elapsed_s / 1e3 ELSE CAST(elapsed_s AS DOUBLE) END AS gb FROM {JOBS}""")
def peak_memory_scan(t: Tables) -> DataFrame:
    unit = F.when(F.col("gpus") == 0, "K").when(F.col("gpus") == 1, "M").otherwise("G")
    line = F.concat(F.col("job_id").cast("string"), F.lit(".0   batch cpu=1  "), F.col("elapsed_s").cast("string"), unit)
    return logs.peak_memory_rows(as_lines(ad.jobs(t), line))


@query("S16", f"""
SELECT CAST(scene AS STRING) AS path, stage, (elapsed_s // 86400) * 86400 + elapsed_s % 86400 AS secs FROM {JOBS} WHERE elapsed_s >= 1""")
def stage_log_scan(t: Tables) -> DataFrame:
    s = F.col("elapsed_s")
    days = F.floor(s / 86400)
    clock = F.concat(F.floor(s % 86400 / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    text = F.when(days > 0, F.concat(days.cast("string"), F.lit(" days, "), clock)).otherwise(clock)
    line = F.concat(F.lit("12:00:00 [INFO] | ["), "stage", F.lit("] finished in "), text)
    return logs.stage_rows(as_lines(ad.jobs(t), line, F.col("scene").cast("string")))


@query("S17 P29", f"""
SELECT concat('/runs/s', CAST(scene AS STRING), '/logs/', stage, '.err') AS log_path, concat('s', CAST(scene AS STRING)) AS job_id, split_part(stage, '_', 1) AS stage,
  substr(concat('RuntimeError: ', priority, ' went wrong in a place that is described at some length here'), 1, 60) AS reason, node
FROM {JOBS} WHERE state = 'FAILED'""")
def crash_scan(t: Tables) -> DataFrame:
    failed = ad.jobs(t).where("state = 'FAILED'")
    line = F.concat(F.lit("01/02 03:04PM x /runs/s"), F.col("scene").cast("string"), F.lit("/logs/"), "stage", F.lit('.err reason="RuntimeError: '), "priority",
                    F.lit(' went wrong in a place that is described at some length here" node=\''), "node", F.lit("'"))
    rows = logs.crash_rows(as_lines(failed, line))
    return rows.withColumn("reason", F.substring("reason", 1, 60))


_SCRIPTS = f"""(SELECT scene, s AS stage, concat(CASE scene % 3 WHEN 0 THEN 'forest' WHEN 1 THEN 'desert' ELSE 'coast' END, ' ', s, '_', CAST(scene % 5 AS STRING), '.gin') AS configs
  FROM (SELECT DISTINCT scene FROM {JOBS} WHERE scene % 7 <> 0), (VALUES ('coarse'), ('populate'), ('fine'), ('render_1')) v(s))"""


def script_lines(t: Tables) -> DataFrame:
    """Run scripts of all scenes but one in seven: a line a stage, another without configurations before it and one with others after it."""
    scenes = ad.jobs(t).select("scene").distinct().where("scene % 7 <> 0")
    stages = F.array(*[F.lit(s) for s in ("coarse", "populate", "fine", "render_1", "render_2")])
    rows = scenes.select("scene", F.posexplode(stages).alias("i", "stage"))
    biome = F.when(F.col("scene") % 3 == 0, "forest").when(F.col("scene") % 3 == 1, "desert").otherwise("coast")
    own = F.concat(F.lit("python gen.py --task "), "stage", F.lit(" -g "), biome, F.lit(" "), "stage", F.lit("_"), (F.col("scene") % 5).cast("string"), F.lit(".gin -p a=1"))
    bare, later = F.concat(F.lit("echo --task "), F.col("stage")), F.concat(F.lit("python gen.py --task "), F.col("stage"), F.lit(" -g later.gin -p a=1"))
    path = F.concat(F.lit("file:///runs//s"), F.col("scene").cast("string"), F.lit("/run_pipeline.sh"))
    lines = rows.select("scene", "i", F.posexplode(F.array(bare, own, later)).alias("j", "line"))
    return lines.select(path.alias("path"), F.lit(0).cast("bigint").alias("_blk"), (F.col("i") * 3 + F.col("j")).cast("bigint").alias("seq"), "line")


@query("S17", f"""
SELECT j.job_id AS id, s.configs, split_part(s.configs, ' ', 1) AS scenetype FROM {JOBS} j LEFT JOIN {_SCRIPTS} s ON s.scene = j.scene AND s.stage = CASE j.stage WHEN 'render_2' THEN 'render_1' ELSE j.stage END WHERE j.state = 'FAILED'""")
def crash_configs(t: Tables) -> DataFrame:
    """Crash lines with the configurations of their stage from the scene's run script."""
    failed = ad.jobs(t).where("state = 'FAILED'")
    line = F.concat(F.lit("01/02 03:04PM x /runs/s"), F.col("scene").cast("string"), F.lit("/logs/"), "stage", F.lit('.err reason="R" node=\''), F.col("job_id").cast("string"), F.lit("'"))
    out_ = logs.with_configs(logs.crash_rows(as_lines(failed, line)), script_lines(t))
    return out_.select(F.col("node").cast("bigint").alias("id"), "configs", "scenetype")


@query("S17", f"SELECT job_id AS id FROM {JOBS} WHERE state = 'FAILED' AND job_id % 5 = 0")
def crash_line_rejects(t: Tables) -> DataFrame:
    """Crash lines that have lost their node; empty lines are none."""
    failed = ad.jobs(t).where("state = 'FAILED'")
    good = F.concat(F.lit("a b /r/s1/logs/fine.err reason=\"R"), F.col("job_id").cast("string"), F.lit('" node=\'n\''))
    line = F.when(F.col("job_id") % 5 == 0, F.substring_index(good, " node", 1)).when(F.col("job_id") % 5 == 1, "").otherwise(good)
    return logs.crash_rejects(as_lines(failed, line)).select(F.regexp_extract("line", 'R([0-9]+)"', 1).cast("bigint").alias("id"))


@query("S18", f"SELECT CAST(scene AS STRING) AS path, stage AS key, elapsed_s AS value FROM {JOBS}")
def polycount_scan(t: Tables) -> DataFrame:
    good = F.concat("stage", F.lit(":"), F.format_number("elapsed_s", 0))
    jobs = ad.jobs(t)
    path = F.col("scene").cast("string")
    return logs.polycount_rows(as_lines(jobs, good, path).unionByName(as_lines(jobs, F.lit("a:b:c"), path)))


@query("S19", f"SELECT job_id, priority AS first, CAST(2 AS BIGINT) AS n FROM {JOBS}")
def list_literal_scan(t: Tables) -> DataFrame:
    text = F.concat(F.lit("['"), "priority", F.lit("', '"), "stage", F.lit("']"))
    return ad.jobs(t).select("job_id", logs.list_literal(text).alias("l")).select("job_id", F.col("l")[0].alias("first"), F.size("l").cast("bigint").alias("n"))


@query("S19", f"""
SELECT concat('job ', CAST(job_id AS STRING)) AS name, CASE WHEN job_id % 11 = 3 THEN '-' WHEN state <> 'FAILED' THEN 'true' ELSE 'false' END AS ran, CASE WHEN job_id % 11 <> 0 THEN elapsed_s * 1000 END AS mem_at_finish, cpus AS obj_count,
  CASE WHEN job_id % 11 <> 1 THEN gpus END AS instance_count, job_id % 11 IN (0, 3) AS corrupt FROM {JOBS}""")
def stage_csv_scan(t: Tables) -> DataFrame:
    """Stage results written as CSV files and read back; one row in eleven has no number for its memory, one an empty count, one a word for its flag."""
    j, k = ad.jobs(t), F.col("job_id") % 11
    text = j.select(F.concat(F.lit("job "), F.col("job_id").cast("string")).alias("name"), F.when(k == 3, "maybe").otherwise((F.col("state") != "FAILED").cast("string")).alias("ran"),
                    F.when(k == 0, "n/a").otherwise((F.col("elapsed_s") * 1000).cast("string")).alias("mem_at_finish"), F.col("cpus").cast("string").alias("obj_count"),
                    F.when(k != 1, F.col("gpus").cast("string")).alias("instance_count"))
    folder = new_folder(t.spark)
    text.write.option("header", "true").csv(folder)
    return logs.stage_results(t.spark, folder).drop("path").withColumns({"corrupt": F.col("corrupt").isNotNull(), "ran": F.coalesce(F.col("ran").cast("string"), F.lit("-"))})


@query("S19", f"""
SELECT job_id AS seed, CAST(2 + job_id % 2 AS BIGINT) AS n, priority AS first, CASE WHEN job_id % 2 = 1 THEN concat(stage, ', it''s "x" \\') END AS third, state FROM {JOBS}""")
def scene_db_scan(t: Tables) -> DataFrame:
    """The scene table as CSV with a list-valued column, written and read back; quotes of both kinds, commas and backslashes stand in the lists."""
    escaped = F.concat(F.col("stage"), F.lit(", it\\'s \"x\" \\\\"))
    items = F.concat(F.lit("['"), "priority", F.lit('\', "'), "stage", F.lit('"'), F.when(F.col("job_id") % 2 == 1, F.concat(F.lit(", '"), escaped, F.lit("'"))).otherwise(""), F.lit("]"))
    folder = new_folder(t.spark)
    ad.jobs(t).select(F.col("job_id").alias("seed"), items.alias("configs"), "state").write.option("header", "true").option("escape", '"').csv(folder)
    c = F.col("configs")
    return logs.scene_db(t.spark, folder, "seed bigint, configs string, state string").select("seed", F.size(c).cast("bigint").alias("n"), F.get(c, F.lit(0)).alias("first"), F.get(c, F.lit(2)).alias("third"), "state")


@query("S26", f"""
WITH d AS (SELECT DISTINCT factory, brand FROM {P})
SELECT concat(factory, '.', brand) AS name, CAST(row_number() OVER (ORDER BY factory, brand) AS BIGINT) AS id, factory AS first, CAST(2 AS BIGINT) AS n FROM d""")
def tag_dictionary_scan(t: Tables) -> DataFrame:
    """A tag dictionary written as one JSON document a folder and read back."""
    d = ranked(ad.parts(t).select("factory", "brand").distinct(), [], ["factory", "brand"], "id")
    # One document for each brand, so no task holds more than a brand's names.
    docs = d.groupBy("brand").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "factory", "brand"), "id")))).alias("value"))
    folder = new_folder(t.spark)
    docs.select("value").write.text(folder)
    texts = t.spark.read.text(folder).select(F.lit(folder).alias("path"), F.col("value").alias("text"))
    return assets.tag_rows(texts).select("name", "id", F.col("tags")[0].alias("first"), F.size("tags").cast("bigint").alias("n"))


@query("S22", f"SELECT CAST(obj AS STRING) AS path, CAST(label AS DOUBLE) AS t, o0 AS x, o1 AS y, o2 AS z, ax0 AS qx, ax1 AS qy, ax2 AS qz, upper AS qw FROM {J}")
def track_scan(t: Tables) -> DataFrame:
    """Pose tracks rendered as text and read back, header lines included."""
    j = ad.joints(t).select(F.col("obj").cast("string").alias("path"), F.col("label").cast("double").alias("t"), F.col("o0").alias("x"), F.col("o1").alias("y"),
                            F.col("o2").alias("z"), F.col("ax0").alias("qx"), F.col("ax1").alias("qy"), F.col("ax2").alias("qz"), F.col("upper").alias("qw"))
    text = out.track_text(j, ["path"], logs.TUM)
    header = j.select("path").distinct().withColumn("line", F.lit(" ".join(logs.TUM)))
    return logs.track_rows(text.unionByName(header), logs.TUM)


@query("S23", """
SELECT concat('node', CAST(s_suppkey AS STRING)) AS node, concat('part', CAST(s_nationkey AS STRING)) AS partition, s_suppkey % 9 AS alloc_cpus, CAST(64 AS BIGINT) AS total_cpus
FROM supplier WHERE s_nationkey <> 0""")
def node_scan(t: Tables) -> DataFrame:
    part = F.when(F.col("s_nationkey") == 0, "all").otherwise(F.concat(F.lit("part"), F.col("s_nationkey").cast("string")))
    line = F.concat(F.lit("node"), F.col("s_suppkey").cast("string"), F.lit("   "), part, F.lit("  "), (F.col("s_suppkey") % 9).cast("string"), F.lit("/3/0/64"))
    return logs.node_rows(as_lines(t.supplier, line))


# -- listings and frames ------------------------------------------------------------------

_FR = ad.fragments.sql


@query("S12 X37", f"""
SELECT DISTINCT scene, frame, object_id AS subcam, CAST(0 AS BIGINT) AS rig, 'Depth' AS dtype, 'npy' AS ext FROM {_FR}""")
def frame_file_scan(t: Tables) -> DataFrame:
    """Frame names built from their parts and parsed back; names with missing tokens give nothing."""
    zero = F.lit(0)
    name = F.concat(F.lit("Depth"), sc.frame_suffix(zero, zero, F.col("frame"), F.col("object_id")), F.lit(".npy"))
    names = ad.fragments(t).select("scene", "frame", "object_id").distinct().select("scene", F.explode(F.array(name, F.lit("Depth_7.npy"))).alias("name"))
    parsed = names.select("scene", files.frame_name(F.col("name")).alias("f")).where("f is not null")
    return parsed.select("scene", "f.frame", "f.subcam", "f.rig", "f.dtype", "f.ext")


@query("S20 F05", f"""
SELECT scene, frame, y, x, min(depth) AS value FROM {_FR} GROUP BY scene, frame, y, x""")
def dense_arrays(t: Tables) -> DataFrame:
    """Frames stored as npy bytes and decoded to pixels; empty pixels hold -1."""
    near = ad.fragments(t).groupBy("scene", "frame", "y", "x").agg(F.min("depth").alias("d"))
    filled = F.map_from_entries(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("k"), "d")))
    tiles = near.groupBy("scene", "frame").agg(filled.alias("m")).withColumn(
        "tile", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(-1.0)).cast("float")))
    coded = files.encode_arrays(tiles, ["scene", "frame"], "tile", (8, 8))
    return files.decode_arrays(coded, ["scene", "frame"]).where("value >= 0").select("scene", "frame", "y", "x", "value")


@query("S27 U07", """
SELECT c_nationkey AS seed, CAST(k AS BIGINT) AS camera, d AS dtype FROM (SELECT DISTINCT c_nationkey FROM customer), range(3) r(k), (VALUES ('Depth'), ('Flow')) v(d)
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 3 = k)""")
def release_gaps(t: Tables) -> DataFrame:
    wanted = (t.customer.select(F.col("c_nationkey").alias("seed")).distinct()
              .withColumn("camera", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(3)])))
              .withColumn("dtype", F.explode(F.array(F.lit("Depth"), F.lit("Flow")))))
    released = t.supplier.selectExpr("s_nationkey AS seed", "s_suppkey % 3 AS camera").distinct().withColumn(
        "dtype", F.explode(F.array(F.lit("Depth"), F.lit("Flow"))))
    return files.release_gaps(wanted, released, ["seed", "camera", "dtype"])


# -- sinks --------------------------------------------------------------------------------

@query("K06", f"""
WITH n AS (SELECT factory, obj * 8 + label AS id, row_number() OVER (PARTITION BY factory ORDER BY obj * 8 + label) - 1 AS seed FROM {P})
SELECT factory, CAST(seed // 5000 AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY factory, seed // 5000""")
def id_mapping_pages(t: Tables) -> DataFrame:
    ids = ad.parts(t).select("factory", (F.col("obj") * 8 + F.col("label")).alias("object_id"))
    docs = out.id_mapping(ranked(ids, ["factory"], ["object_id"]).withColumn("seed", F.col("rn") - 1))
    return docs.select("factory", "page", F.size(F.from_json("text", "map<string,bigint>")).cast("bigint").alias("n"))


@query("K07", f"SELECT job_id, scene, stage, state AS error FROM {JOBS} WHERE state = 'FAILED'")
def failure_report(t: Tables) -> DataFrame:
    jobs = ad.jobs(t).withColumn("ok", F.col("state") != "FAILED").withColumn("error", F.col("state"))
    return out.failures(jobs, "ok", ["job_id", "scene", "stage", "error"])


@query("K09", """
SELECT o_orderkey, CASE WHEN rn < 5000 THEN 'index' ELSE concat('index_', CAST(rn // 5000 AS STRING)) END AS page
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)""")
def paged_report(t: Tables) -> DataFrame:
    return out.pages(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("K10", f"""
SELECT scene, tag AS dtype, object_id AS camera, 'npy' AS ext, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(frame) AS BIGINT) AS bytes FROM {_FR} GROUP BY scene, tag, object_id""")
def release_bundles(t: Tables) -> DataFrame:
    rows = ad.fragments(t).select("scene", F.col("tag").alias("dtype"), F.col("object_id").alias("camera"), F.lit("npy").alias("ext"), F.col("frame").alias("length"))
    return out.bundles(rows, ["scene", "dtype", "camera", "ext"])


@query("K10", f"""
SELECT DISTINCT concat(CAST(scene AS STRING), '_', tag, '_', CAST(object_id AS STRING)) AS bundle, concat(CAST(scene AS STRING), '/', tag, '/', CAST(frame AS STRING), '.npy') AS path FROM {_FR}""")
def release_members(t: Tables) -> DataFrame:
    """The member paths of every bundle."""
    rows = ad.fragments(t).select("scene", F.col("tag").alias("dtype"), F.col("object_id").alias("camera"), F.concat_ws("/", "scene", "tag", F.concat(F.col("frame").cast("string"), F.lit(".npy"))).alias("path"))
    return out.bundle_members(rows.distinct(), ["scene", "dtype", "camera"])


@query("K11", f"""
SELECT scene, max(frame) AS last_frame, CAST(count(DISTINCT (tag, object_id, frame)) AS BIGINT) AS n_paths, CAST(0 AS BIGINT) AS n_second FROM {_FR} GROUP BY scene""")
def run_summary(t: Tables) -> DataFrame:
    """Nested summaries, checked by what they hold; one frame in three has a second path, which stands in none."""
    rows = ad.fragments(t).select("scene", F.col("tag").alias("dtype"), F.lit("npy").alias("ext"), F.lit(0).alias("rig"), F.col("object_id").alias("subcam"), "frame").distinct()
    rows = rows.withColumn("path", F.concat_ws("/", "dtype", "subcam", "frame"))
    docs = out.run_summary(rows.unionByName(rows.where("frame % 3 = 0").withColumn("path", F.concat("path", F.lit("_second")))))
    schema = "files map<string,map<string,map<string,map<string,map<string,string>>>>>, stats struct<`Max Frame`:bigint>"
    doc = docs.select("scene", F.from_json("text", schema).alias("d"))
    leaf = doc.select("scene", F.col("d.stats.`Max Frame`").alias("last_frame"), F.explode("d.files").alias("dtype", "m"))
    for name in ("ext", "rig", "subcam", "frame"):
        leaf = leaf.select("scene", "last_frame", F.explode("m").alias(name, "m"))
    return leaf.groupBy("scene", "last_frame").agg(F.count("*").alias("n_paths"), F.count_if(F.col("m").endswith("_second")).alias("n_second"))


@query("K12", f"SELECT job_id, round(elapsed_s / 7.0, 6) AS a, round(cpus / 3.0, 6) AS b FROM {JOBS}")
def float_compaction(t: Tables) -> DataFrame:
    text = F.to_json(F.struct(F.array(F.col("elapsed_s") / 7.0, F.col("cpus") / 3.0).alias("v")))
    compact = out.compact_floats(text, "v array<double>", ["v"])
    return ad.jobs(t).select("job_id", F.from_json(compact, "v array<double>")["v"].alias("v")).select("job_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))

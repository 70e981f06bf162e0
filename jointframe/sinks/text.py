"""Text outputs: OBJ, URDF, JSON records, reports, manifests.

Outputs without a size limit (OBJ) are line tables written in range order, so a
file may come in several ordered pieces. URDF and JSON documents describe one
object each and are rendered as one string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.plans.ordered import ranked


def number(c: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", c + 0.0)


# -- OBJ ----------------------------------------------------------------------------------

def corner_token(c: Column) -> Column:
    """v, v/vt, v//vn or v/vt/vn by which indices are present."""
    v, vt, vn = [c[n].cast("string") for n in ("v", "vt", "vn")]
    has_t, has_n = c["vt"] != 0, c["vn"] != 0
    return (F.when(has_t & has_n, F.concat_ws("/", v, vt, vn)).when(has_n, F.concat_ws("//", v, vn))
            .when(has_t, F.concat_ws("/", v, vt)).otherwise(v))


def obj_lines(vertices: DataFrame, faces: DataFrame, texcoords: DataFrame | None = None, normals: DataFrame | None = None,
              materials: DataFrame | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """(path, sec, pos, sub, line): vertices, texture points, normals, then faces with material lines before theirs.

    vertices and normals are (path, idx, x, y, z), texcoords (path, idx, u, w),
    faces (path, idx, corners), materials (path, n_faces, ord, directive, value),
    libraries (path, ord, value), which stand first.
    """
    def rows(df: DataFrame, sec: int, pos: Column, sub: Column, line: Column) -> DataFrame:
        return df.select("path", F.lit(sec).alias("sec"), pos.cast("bigint").alias("pos"), sub.cast("bigint").alias("sub"), line.alias("line"))

    def point(tag: str, names: str) -> Column:
        return F.concat_ws(" ", F.lit(tag), *[number(F.col(n)) for n in names])

    idx, first = F.col("idx"), F.lit(0)
    out = rows(vertices, 1, idx, first, point("v", "xyz"))
    if texcoords is not None:
        out = out.unionByName(rows(texcoords, 2, idx, first, point("vt", "uw")))
    if normals is not None:
        out = out.unionByName(rows(normals, 3, idx, first, point("vn", "xyz")))
    if materials is not None:
        out = out.unionByName(rows(materials, 4, F.col("n_faces") + 1, F.col("ord"), F.concat_ws(" ", "directive", "value")))
    if libraries is not None:
        out = out.unionByName(rows(libraries, 0, first, F.col("ord"), F.concat_ws(" ", F.lit("mtllib"), "value")))
    last = F.lit(1 << 40)
    face = F.concat(F.lit("f "), F.array_join(F.transform("corners", corner_token), " "))
    return out.unionByName(rows(faces, 4, idx, last, face))


def write_lines(lines: DataFrame, order: Sequence[str], folder: str, by: str = "path") -> None:
    """Write line tables as text, one sub-folder per ``by`` value with pieces named in order."""
    keys = [by, *order]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(by, F.col("line").alias("value")).write.mode(
        "overwrite").partitionBy(by).text(folder)


# -- URDF ---------------------------------------------------------------------------------

def _tag(name: str, **attrs: Column) -> Column:
    parts = [x for k, v in attrs.items() for x in (F.lit(f' {k}="'), v.cast("string"), F.lit('"'))]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit("/>"))


def _triple(cols: Sequence[Column]) -> Column:
    return F.concat_ws(" ", *[c.cast("string") for c in cols])


def urdf_links(links: DataFrame) -> DataFrame:
    """(path, ord, xml) of links (path, ord, link, mesh or null)."""
    body = F.when(F.col("mesh").isNotNull(), F.concat(
        F.lit("<visual><geometry>"), _tag("mesh", filename=F.col("mesh")), F.lit("</geometry></visual>"))).otherwise("")
    return links.select("path", "ord", F.concat(F.lit('<link name="'), "link", F.lit('">'), body, F.lit("</link>")).alias("xml"))


def urdf_joints(joints: DataFrame) -> DataFrame:
    """(path, ord, xml) of joints; limits for revolute and prismatic, for continuous only if not zero."""
    kind = F.col("type")
    limited = kind.isin("revolute", "prismatic") | ((kind == "continuous") & ((F.abs("lower") > 1e-6) | (F.abs("upper") > 1e-6)))
    limit = F.when(limited, F.coalesce(_tag("limit", lower=F.col("lower"), upper=F.col("upper")), F.lit(""))).otherwise("")
    axis = F.when(kind != "fixed", _tag("axis", xyz=_triple([F.col(f"ax{i}") for i in range(3)]))).otherwise("")
    return joints.select("path", "ord", F.concat(
        F.lit('<joint name="'), "joint", F.lit('" type="'), kind, F.lit('">'),
        _tag("parent", link=F.col("parent")), _tag("child", link=F.col("child")),
        _tag("origin", xyz=_triple([F.col(f"o{i}") for i in range(3)]), rpy=_triple([F.col(f"rpy{i}") for i in range(3)])),
        axis, limit, F.lit("</joint>")).alias("xml"))


def urdf_documents(links: DataFrame, joints: DataFrame) -> DataFrame:
    """(path, text): one robot document per object."""
    rows = urdf_links(links).withColumn("sec", F.lit(0)).unionByName(urdf_joints(joints).withColumn("sec", F.lit(1)))
    listed = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sec", "ord", "xml"))).alias("l"))
    return listed.select("path", F.concat(F.lit('<robot name="object">'), F.array_join(F.transform("l", lambda x: x["xml"]), ""), F.lit("</robot>")).alias("text"))


def group_links(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and joints of group records (path, gid, kind, type, parent, labels, params).

    Static parts are fixed to the world. A joint group gets an abstract link, a
    movable joint from the parent group's abstract link (or the world) and
    fixed joints to its parts.
    """
    zero = [F.lit(0.0)] * 3
    name = F.concat(F.lit("abstract_"), F.col("parent").cast("string"), F.lit("_"), F.col("gid").cast("string"))
    moving = groups.where("kind = 'joint'").withColumn("abstract", name)
    above = moving.select("path", F.col("gid").alias("parent"), F.col("abstract").alias("_up"))
    moving = moving.join(above, ["path", "parent"], "left").withColumn("_up", F.coalesce("_up", F.lit("l_world")))

    def joints(df: DataFrame, ident: Column, kind: Column, parent: Column, child: Column, origin, axis, lower: Column, upper: Column) -> DataFrame:
        return df.select("path", ident.alias("joint"), kind.alias("type"), parent.alias("parent"), child.alias("child"),
                         *[c.alias(f"o{i}") for i, c in enumerate(origin)], *[c.alias(f"rpy{i}") for i, c in enumerate(zero)],
                         *[c.alias(f"ax{i}") for i, c in enumerate(axis)], lower.alias("lower"), upper.alias("upper"))

    def fixed_joints(df: DataFrame, parent: Column, tag: Column) -> DataFrame:
        each = df.withColumn("_label", F.explode("labels"))
        label = F.col("_label").cast("string")
        return joints(each, F.concat(F.lit("joint_fixed_"), tag, F.lit("_"), label), F.lit("fixed"), parent,
                      F.concat(F.lit("l_"), label), zero, zero, F.lit(0.0), F.lit(0.0))

    p = [F.get("params", F.lit(i)) for i in range(8)]
    moves = joints(moving, F.concat_ws("_", F.lit("joint"), "type", "_up", "abstract"), F.col("type"), F.col("_up"), F.col("abstract"),
                   p[3:6], p[0:3], p[6], p[7])
    every = (moves.unionByName(fixed_joints(groups.where("kind = 'static'"), F.lit("l_world"), F.lit("world")))
             .unionByName(fixed_joints(moving, F.col("abstract"), F.col("abstract"))))
    links = every.select("path", F.col("child").alias("link")).union(groups.select("path", F.lit("l_world")).distinct())
    return links, every


def converted_joints(joints: DataFrame, centroids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joints of a converted document: world axes, origins relative to the parent part's centroid, safe limits.

    ``joints`` has world origin wo0..2 and direction wd0..2 and raw limits that
    may be null; ``centroids`` is (keys…, label, cx, cy, cz) of the parts.
    Missing limits are ±1, continuous joints always ±1, swapped limits are put
    in order. A joint to a helper link is named after its own type and the
    types of the joints below the helper.
    """
    parent = centroids.select(*keys, F.concat(F.lit("l_"), F.col("label").cast("string")).alias("parent"), "cx", "cy", "cz")
    below = joints.select(*keys, F.col("parent").alias("child"), F.col("type").alias("_t")).groupBy(*keys, "child").agg(F.collect_list("_t").alias("_below"))
    df = joints.join(parent, [*keys, "parent"], "left").join(below, [*keys, "child"], "left")
    lo, hi = F.coalesce("lower", F.lit(-1.0)), F.coalesce("upper", F.lit(1.0))
    turning = F.col("type") == "continuous"
    compound = F.col("child").endswith("_helper") & F.col("_below").isNotNull()
    kinds = F.when(compound, F.array_sort(F.array_append("_below", F.col("type")))).otherwise(F.array("type"))
    return df.select(
        *keys, "joint", "type", "parent", "child", F.concat(F.lit("joint_"), F.array_join(kinds, "_")).alias("prefix"),
        *[(F.col(f"wo{i}") - F.coalesce(f"c{a}", F.lit(0.0))).alias(f"o{i}") for i, a in enumerate("xyz")],
        *[F.col(f"wd{i}").alias(f"ax{i}") for i in range(3)], *[F.lit(0.0).alias(f"rpy{i}") for i in range(3)],
        F.when(turning, -1.0).otherwise(F.least(lo, hi)).alias("lower"), F.when(turning, 1.0).otherwise(F.greatest(lo, hi)).alias("upper"))


def tensor_joints(rows: DataFrame) -> DataFrame:
    """Joints of the verification document from tensor rows (path, slot, c0..c11) that exist."""
    hot = F.array("c6", "c7", "c8")
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.MOVABLE]), F.array_position(hot, F.array_max(hot)).cast("int"))
    slot = F.col("slot").cast("string")
    return rows.where("c11 = 1").withColumn("type", kind).select(
        "path", F.col("slot").alias("ord"), F.concat_ws("_", F.lit("joint"), "type", slot).alias("joint"), "type",
        F.lit("base_link").alias("parent"), F.concat(F.lit("moving_link_"), slot).alias("child"),
        *[number(F.col(f"c{i}")).alias(f"o{i}") for i in range(3)], *[number(F.col(f"c{i + 3}")).alias(f"ax{i}") for i in range(3)],
        F.when(F.col("type") != "continuous", number(F.col("c9"))).alias("lower"),
        F.when(F.col("type") != "continuous", number(F.col("c10"))).alias("upper"))


# -- JSON and reports ---------------------------------------------------------------------

def metadata_documents(objects: DataFrame, parts: DataFrame, joints: DataFrame, splits: DataFrame) -> DataFrame:
    """(factory, obj, text): one nested record per object.

    objects (obj, factory, source, category, mx, my, mz, scale); parts (obj,
    label, name, is_moving, movement); joints (obj, joint, type, span, o0..2,
    d0..2); splits (obj, key, label, role).
    """
    six = [F.array(*[F.round(f"{p}{i}", 6) for i in range(3)]) for p in "od"]
    part = parts.groupBy("obj").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("label").cast("string"), F.struct("name", "is_moving", F.col("movement").alias("movement_desc")))))).alias("parts"))
    joint = joints.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct(
        F.col("joint").alias("name"), "type", F.round("span", 6).alias("motion_range"), six[0].alias("axis_origin"), six[1].alias("axis_direction")))).alias("joints"))
    def labels(role: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("label")))).alias(role)
    per_key = splits.groupBy("obj", "key").agg(labels("body"), labels("moving"))
    split = per_key.groupBy("obj").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("body", "moving"))))).alias("splits"))
    full = objects.join(part, "obj", "left").join(joint, "obj", "left").join(split, "obj", "left")
    centre = F.struct(F.array("mx", "my", "mz").alias("center"), "scale")
    return full.select("factory", "obj", F.to_json(F.struct(
        "factory", F.col("obj").cast("string").alias("identifier"), "source", "category", centre.alias("normalize"), "parts", "joints", "splits")).alias("text"))


def id_mapping(numbered: DataFrame) -> DataFrame:
    """(factory, page, text): seed → source id maps as JSON pages of bounded size."""
    paged = numbered.withColumn("page", F.floor(F.col("seed") / 5000))
    return paged.groupBy("factory", "page").agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("seed").cast("string"), F.col("object_id")))))).alias("text"))


def failures(jobs: DataFrame, ok: str, columns: Sequence[str]) -> DataFrame:
    """Rows of failed jobs only."""
    return jobs.where(~F.col(ok)).select(*columns)


def pages(rows: DataFrame, order: Sequence[str], size: int = 5000) -> DataFrame:
    """Add ``page`` name: index, index_1, … of ``size`` rows each."""
    numbered = ranked(rows, [], order, "_rn").withColumn("_p", F.floor((F.col("_rn") - 1) / size))
    name = F.when(F.col("_p") == 0, "index").otherwise(F.concat(F.lit("index_"), F.col("_p").cast("string")))
    return numbered.withColumn("page", name).drop("_rn", "_p")


def bundles(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """File count and bytes per release bundle."""
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def bundle_members(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The members of each bundle as rows, with the bundle's name."""
    return files.select(F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("bundle"), "path")


RENAMED = {"T": "Camera Pose", "K": "Camera Intrinsics"}


def run_summary(files: DataFrame) -> DataFrame:
    """(scene, text): dtype → ext → rig → subcam → frame → path as nested JSON, with the last frame.

    ``files`` is (scene, dtype, ext, rig, subcam, frame, path); a document covers
    one scene. Of several paths for one frame the first by name stands.
    """
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    df = files.withColumn("dtype", F.coalesce(names[F.col("dtype")], F.col("dtype")))
    last = df.groupBy("scene").agg(F.max("frame").alias("last"))
    df = df.withColumns({c: F.col(c).cast("string") for c in ("rig", "subcam")}).withColumn("frame", F.lpad(F.col("frame").cast("string"), 4, "0"))
    def by_key(a: Column, b: Column) -> Column:
        return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)

    levels, value = ["dtype", "ext", "rig", "subcam", "frame"], F.col("path")
    df = df.groupBy("scene", *levels).agg(F.min("path").alias("path"))
    for i in range(len(levels) - 1, -1, -1):
        df = df.groupBy("scene", *levels[:i]).agg(
            F.map_from_entries(F.array_sort(
                F.collect_list(F.struct(F.col(levels[i]).alias("k"), value.alias("v"))), by_key)).alias("v"))
        value = F.col("v")
    return df.join(last, "scene").select("scene", F.to_json(F.struct(F.col("v").alias("files"), F.struct(F.col("last").alias("Max Frame")).alias("stats"))).alias("text"))


def compact_floats(text: Column, schema: str, fields: Sequence[str], digits: int = 6) -> Column:
    """JSON with the float arrays of the named fields rounded."""
    parsed = F.from_json(text, schema)
    for name in fields:
        parsed = parsed.withField(name, F.transform(parsed[name], lambda x: F.round(x, digits)))
    return F.to_json(parsed)


def track_text(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys…, line): space-separated numbers of a track row."""
    return rows.select(*keys, F.concat_ws(" ", *[F.col(n).cast("string") for n in names]).alias("line"))


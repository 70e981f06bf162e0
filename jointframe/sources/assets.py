"""Asset files to tables: object JSON, URDF, OBJ, MTL, semantics, origins, part lists.

The parsers take (path, text) or (path, _blk, seq, line) frames, so that they
work on scanned files and on text made by a query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.plans.ordered import running_sum
from jointframe.sources.text import tokens

OBJECT_SCHEMA = (
    "category string, object_name string, group_info map<string,string>, parts array<struct<label:bigint, name:string, "
    "material:string, density:string, `Young's Modulus (GPa)`:double, `Poisson's Ratio`:double, Movement_description:string>>"
)

URDF_SCHEMA = """
link array<struct<_name:string, visual:array<struct<origin:struct<_xyz:string>, geometry:struct<mesh:struct<_filename:string>>>>>>,
joint array<struct<_name:string, _type:string, origin:struct<_xyz:string,_rpy:string>, parent:struct<_link:string>,
  child:struct<_link:string>, axis:struct<_xyz:string>, limit:struct<_lower:string,_upper:string>>>
"""


# -- object JSON --------------------------------------------------------------------------

def parse_objects(texts: DataFrame) -> DataFrame:
    """(path, o): one parsed struct per readable document; corrupt ones are dropped."""
    return texts.where(F.try_parse_json("text").isNotNull()).select("path", F.from_json("text", OBJECT_SCHEMA).alias("o"))


def rejected_objects(texts: DataFrame) -> DataFrame:
    return texts.where(F.try_parse_json("text").isNull()).select("path")


def object_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.coalesce("o.category", F.lit("Unknown")).alias("category"), "o.object_name",
                         F.coalesce(F.size("o.parts"), F.lit(0)).cast("bigint").alias("n_parts"))


def part_rows(parsed: DataFrame) -> DataFrame:
    """Parts with defaults for missing properties; parts without label are skipped."""
    d = fixed.PART_DEFAULTS
    p = parsed.select("path", F.explode("o.parts").alias("p")).where("p.label is not null")
    return p.select(
        "path", "p.label", F.coalesce("p.name", F.lit(d["name"])).alias("name"),
        F.coalesce("p.material", F.lit(d["material"])).alias("material"), F.coalesce("p.density", F.lit(d["density"])).alias("density"),
        F.coalesce(F.col("p.`Young's Modulus (GPa)`"), F.lit(d["youngs"])).alias("youngs"),
        F.coalesce(F.col("p.`Poisson's Ratio`"), F.lit(d["poisson"])).alias("poisson"),
        F.coalesce("p.Movement_description", F.lit("")).alias("movement"))


def group_rows(parsed: DataFrame, codes: Mapping[str, str] = fixed.JOINT_CODES) -> DataFrame:
    """(path, gid, kind, type, parent, labels, params): joint groups are lists of at least 4 that end in a type code.

    All others are static and keep their numeric members.
    """
    g = parsed.select("path", F.explode("o.group_info").alias("gid", "raw"))
    items = F.from_json("raw", "array<string>")
    g = g.withColumn("items", F.coalesce(items, F.array("raw")))
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.element_at("items", -1)]
    joint = (F.size("items") >= 4) & code.isNotNull()
    head = F.get("items", F.lit(0))
    labels = F.coalesce(F.from_json(head, "array<bigint>"), F.array(head.try_cast("bigint")))
    numeric = F.filter(F.transform("items", lambda i: i.try_cast("double").cast("bigint")), lambda i: i.isNotNull())
    return g.select(
        "path", F.col("gid").try_cast("bigint").alias("gid"), F.when(joint, "joint").otherwise("static").alias("kind"),
        F.when(joint, code).alias("type"), F.when(joint, F.get("items", F.lit(1)).try_cast("bigint")).alias("parent"),
        F.when(joint, labels).otherwise(numeric).alias("labels"),
        F.when(joint, F.from_json(F.get("items", F.lit(2)), "array<double>")).alias("params"))


# -- URDF ---------------------------------------------------------------------------------

def parse_urdf(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.from_xml("text", URDF_SCHEMA, {"rowTag": "robot"}).alias("r"))


def part_of_link(name: Column) -> Column:
    return F.regexp_extract(name, r"^l_(\d+)", 1).try_cast("bigint")


def _vector(text: Column, default: Sequence[float]) -> list[Column]:
    parts = F.split(F.trim(text), r"\s+")
    return [F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(float(d))) for i, d in enumerate(default)]


def link_rows(parsed: DataFrame) -> DataFrame:
    """(path, link, is_helper, part, n_visuals, mesh, v0..2): visuals without a mesh do not count; the first gives the mesh."""
    links = parsed.select("path", F.explode("r.link").alias("l"))
    meshes = F.filter(F.coalesce("l.visual", F.array()), lambda v: v["geometry"]["mesh"]["_filename"].isNotNull())
    out = links.select("path", F.col("l._name").alias("link"), meshes.alias("_m"))
    first = F.get("_m", F.lit(0))
    return out.select(
        "path", "link", F.col("link").endswith("_helper").alias("is_helper"), part_of_link(F.col("link")).alias("part"),
        F.size("_m").cast("bigint").alias("n_visuals"), first["geometry"]["mesh"]["_filename"].alias("mesh"),
        *[c.alias(f"v{i}") for i, c in enumerate(_vector(first["origin"]["_xyz"], (0, 0, 0)))])


def joint_rows(parsed: DataFrame) -> DataFrame:
    """Joints with default axis X (normalised), zero origin and zero limits; flags tell given axes and limits."""
    j = parsed.select("path", F.explode("r.joint").alias("j"))
    axis = la.normalise(_vector(F.col("j.axis._xyz"), (1, 0, 0)))
    return j.select(
        "path", F.coalesce("j._name", F.lit("")).alias("joint"), F.coalesce("j._type", F.lit("fixed")).alias("type"),
        F.col("j.parent._link").alias("parent"), F.col("j.child._link").alias("child"),
        F.coalesce(F.col("j.limit._lower").try_cast("double"), F.lit(0.0)).alias("lower"),
        F.coalesce(F.col("j.limit._upper").try_cast("double"), F.lit(0.0)).alias("upper"),
        F.col("j.limit._upper").isNotNull().alias("limit_given"), F.col("j.axis._xyz").isNotNull().alias("axis_given"),
        *[c.alias(f"ax{i}") for i, c in enumerate(axis)],
        *[c.alias(f"o{i}") for i, c in enumerate(_vector(F.col("j.origin._xyz"), (0, 0, 0)))],
        *[c.alias(f"rpy{i}") for i, c in enumerate(_vector(F.col("j.origin._rpy"), (0, 0, 0)))])


# -- OBJ and MTL --------------------------------------------------------------------------

DIRECTIVES = ("mtllib", "usemtl", "o", "g", "s")


def obj_records(lines: DataFrame, order: Sequence[str] = ("seq",), blocked: bool = True) -> DataFrame:
    """OBJ lines with their tokens and, per file, 1-based record numbers (``n_d`` for directives) and the count of faces before each line.

    The numbers are running sums over blocks, so a huge file stays spread out.
    """
    # The generator keeps the optimizer from splitting a line again in each condition.
    split = lines.select("*", F.explode(F.array(tokens(F.col("line")))).alias("tok")).drop("line")
    kept = split.withColumn("kind", F.get("tok", F.lit(0)))
    n = F.size("tok")
    valid = (
        (F.col("kind").isin("v", "vn") & (n >= 4)) | ((F.col("kind") == "vt") & (n >= 3))
        | F.col("kind").isin("f", *DIRECTIVES)
    )
    kept = kept.where(valid)
    one = {f"n_{k}": (F.col("kind") == k).cast("bigint") for k in ("v", "vn", "vt", "f")}
    one["n_d"] = F.col("kind").isin(*DIRECTIVES).cast("bigint")
    return running_sum(kept, ["path"], list(order), one, blocked=blocked)


def _numbers(n: int) -> list[Column]:
    return [F.get("tok", F.lit(i + 1)).try_cast("double") for i in range(n)]


def obj_points(records: DataFrame, kind: str = "v") -> DataFrame:
    """(path, idx, x, y, z) of vertices (v) or normals (vn), or (path, idx, u, w) of texture points (vt)."""
    names = ["u", "w"] if kind == "vt" else ["x", "y", "z"]
    return records.where(F.col("kind") == kind).select(
        "path", F.col(f"n_{kind}").alias("idx"), *[c.alias(n) for c, n in zip(_numbers(len(names)), names)])


def obj_faces(records: DataFrame) -> DataFrame:
    """(path, idx, corners array<struct<v, vt, vn>>); absent indices are 0, negative ones stay."""
    def corner(token: Column) -> Column:
        idx = F.split(token, "/")
        def at(i: int) -> Column:
            return F.coalesce(F.get(idx, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
        return F.struct(at(0).alias("v"), at(1).alias("vt"), at(2).alias("vn"))
    corners = F.transform(F.slice("tok", F.lit(2), F.size("tok")), corner)
    return records.where("kind = 'f'").select("path", F.col("n_f").alias("idx"), corners.alias("corners"))


def obj_materials(records: DataFrame) -> DataFrame:
    """(path, directive, value, n_faces, ord): library, material and group lines with the number of faces before them, 1.. in the file's order."""
    rest = F.array_join(F.slice("tok", F.lit(2), F.size("tok")), " ")
    return records.where(F.col("kind").isin(*DIRECTIVES)).select(
        "path", F.col("kind").alias("directive"), rest.alias("value"), F.col("n_f").alias("n_faces"), F.col("n_d").alias("ord"))


def merge_offsets(counts: DataFrame, keys: Sequence[str], part: str, names: Sequence[str]) -> DataFrame:
    """Per part the record counts of all earlier parts of the object."""
    return running_sum(counts, keys, [part], {f"off_{n}": F.col(n) for n in names}, inclusive=False)


def shift_corners(faces: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corner indices of merged meshes: positive ones move by the offset, 0 and negative ones stay."""
    def move(i: Column, by: str) -> Column:
        return F.when(i > 0, i + F.col(by)).otherwise(i)
    corners = F.transform("corners", lambda c: F.struct(
        move(c["v"], "off_v").alias("v"), move(c["vt"], "off_vt").alias("vt"), move(c["vn"], "off_vn").alias("vn")))
    return faces.join(offsets, list(keys)).select(*faces.drop("corners").columns, corners.alias("corners"))


def material_colours(lines: DataFrame, order: Sequence[str] = ("_blk", "seq")) -> DataFrame:
    """(path, r, g, b): the first ``Kd`` line of each material file."""
    kd = lines.where(F.trim("line").rlike(r"^Kd\s")).withColumn("tok", tokens(F.col("line")))
    rgb = F.struct(*[c.alias(n) for c, n in zip(_numbers(3), "rgb")])
    return kd.groupBy("path").agg(F.min_by(rgb, F.struct(*order)).alias("c")).select("path", "c.*")


# -- small formats ------------------------------------------------------------------------

def semantics_rows(lines: DataFrame) -> DataFrame:
    """(path, link, motion, semantic); two tokens mean an unknown semantic, fewer are skipped."""
    tok = lines.select("path", tokens(F.col("line")).alias("t")).where(F.size("t") >= 2)
    return tok.select("path", F.get("t", F.lit(0)).alias("link"), F.get("t", F.lit(1)).alias("motion"),
                      F.coalesce(F.get("t", F.lit(2)), F.lit("unknown")).alias("semantic"))


def origin_rows(texts: DataFrame) -> DataFrame:
    """(path, part, x, y, z) of an origins map; the key ``world`` is the root and no part."""
    m = texts.select("path", F.explode(F.from_json("text", "map<string,array<double>>")).alias("part", "p"))
    return m.where(F.col("part").rlike(r"^\d+$")).select(
        "path", F.col("part").cast("bigint").alias("part"), *[F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xyz")])


def part_list_rows(texts: DataFrame, first_only: bool = False) -> DataFrame:
    """(path, instance, part, name): the part number is the stem of its file name."""
    schema = "array<struct<part:array<struct<part_name:string,file_name:string,file_obj_path:string>>>>"
    inst = texts.select("path", F.posexplode(F.from_json("text", schema)).alias("instance", "i"))
    inst = inst.where("instance = 0") if first_only else inst
    p = inst.select("path", F.col("instance").cast("bigint").alias("instance"), F.explode("i.part").alias("p"))
    return p.select("path", "instance", F.regexp_extract("p.file_name", r"^(\d+)\.", 1).try_cast("bigint").alias("part"),
                    F.col("p.part_name").alias("name"))


def tag_rows(texts: DataFrame) -> DataFrame:
    """(path, name, id, tags): a combined tag is the dot-joined sorted set of its names."""
    m = texts.select("path", F.explode(F.from_json("text", "map<string,bigint>")).alias("name", "id"))
    return m.select("path", "name", "id", F.split("name", r"\.").alias("tags"))


FRAME_OBJECT_SCHEMA = (
    "array<struct<object_index:bigint,name:string,num_verts:bigint,num_faces:bigint,materials:array<string>,tags:array<string>,"
    "min:array<double>,max:array<double>,instance_ids:array<array<bigint>>,model_matrices:array<array<array<double>>>>>"
)


def frame_object_rows(texts: DataFrame) -> DataFrame:
    return texts.select("path", F.inline(F.from_json("text", FRAME_OBJECT_SCHEMA)))


def instance_rows(objects: DataFrame) -> DataFrame:
    """One row per (object, instance) with its matrix."""
    return objects.select("path", "object_index", F.inline(F.arrays_zip("instance_ids", "model_matrices"))).withColumnsRenamed(
        {"instance_ids": "instance_id", "model_matrices": "matrix"})

"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.operators import catalog as cat
from jointframe.operators import kinematics as kin
from jointframe.queries.kinematics import CLOSURE_SQL
from jointframe.registry import query
from jointframe.session import Tables

P = ad.parts.sql


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def values(rows) -> str:
    def one(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


RULES = [("ECONOMY", "CabinetFactory"), ("SMALL", "DrawerFactory"), ("LARGE", "DoorFactory"), ("PROMO", "LampFactory")]


@query("P01", f"""
SELECT p.obj, p.label, p.factory AS category, coalesce(r.f, 'MiscFactory') AS factory
FROM {P} p LEFT JOIN (VALUES {values(RULES)}) r(c, f) ON r.c = p.factory""")
def category_map_fallback(t: Tables) -> DataFrame:
    rules = cat.literal_table(t.spark, RULES, "category string, factory string")
    rows = ad.parts(t).select("obj", "label", F.col("factory").alias("category"))
    return cat.map_category(rows, rules, "MiscFactory")


@query("P02", f"""
SELECT brand AS factory, CASE WHEN brand = 'Brand#7' THEN 'own' WHEN brand LIKE '%#1%' THEN 'net' WHEN brand LIKE '%#2%'
  THEN 'mob' ELSE 'im' END AS source, CAST(count(*) AS BIGINT) AS n FROM {P} GROUP BY 1, 2""")
def source_detection(t: Tables) -> DataFrame:
    registry = cat.literal_table(t.spark, [("Brand#7", "own")], "factory string, source string")
    rows = ad.parts(t).groupBy(F.col("brand").alias("factory")).agg(F.count("*").alias("n"))
    return cat.detect_source(rows, registry, [("#1", "net"), ("#2", "mob")], "im")


@query("P03", f"""
SELECT brand AS factory, coalesce(CASE WHEN brand = 'Brand#12' THEN 'special' WHEN regexp_matches(brand, '^Brand#1[0-9]$')
  THEN 'generic' END, 'none') AS rule, CAST(count(*) AS BIGINT) AS n FROM {P} GROUP BY 1, 2""")
def rule_fallback_pattern(t: Tables) -> DataFrame:
    rules = cat.literal_table(t.spark, [("Brand#12", "special")], "factory string, rule string")
    rows = ad.parts(t).groupBy(F.col("brand").alias("factory")).agg(F.count("*").alias("n"))
    out = cat.rule_or_generic(rows, rules, "^Brand#1[0-9]$", "generic")
    return out.withColumn("rule", F.coalesce("rule", F.lit("none")))


@query("P04", f"""
WITH ids AS (SELECT factory, obj * 8 + label AS object_id,
    row_number() OVER (PARTITION BY factory ORDER BY obj * 8 + label) - 1 AS pos,
    count(*) OVER (PARTITION BY factory) AS n FROM {P}),
s AS (SELECT o_orderkey AS seed, CASE o_orderkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'PROMO' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'MEDIUM' ELSE 'STANDARD' END AS factory FROM orders)
SELECT s.factory, s.seed, ids.object_id, s.seed >= ids.n AS is_variant
FROM s JOIN ids ON ids.factory = s.factory AND ids.pos = s.seed % ids.n""")
def seed_to_object(t: Tables) -> DataFrame:
    ids = ad.parts(t).select("factory", (F.col("obj") * 8 + F.col("label")).alias("object_id"))
    seeds = t.orders.selectExpr(
        "o_orderkey AS seed",
        "CASE o_orderkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'PROMO' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'MEDIUM' ELSE 'STANDARD' END AS factory")
    return cat.seeds_to_objects(ids, seeds)


@query("P11", f"""
SELECT obj, label, regexp_matches(lower(movement), '{"|".join(fixed.MOVE_STEMS)}')
  AND NOT regexp_matches(lower(movement), '{"|".join(fixed.ANCHOR_PHRASES)}') AS is_moving FROM {P}""")
def movement_text_flag(t: Tables) -> DataFrame:
    return ad.parts(t).select("obj", "label", cat.moves_by_text(F.col("movement")).alias("is_moving"))


@query("P11", f"""
SELECT doc_id, regexp_matches(lower(text), '{"|".join(fixed.MOVE_STEMS)}')
  AND NOT regexp_matches(lower(text), '{"|".join(fixed.ANCHOR_PHRASES)}') AS is_moving FROM documents""")
def movement_text_documents(t: Tables) -> DataFrame:
    """The same test over long free text."""
    return t.documents.select("doc_id", cat.moves_by_text(F.col("text")).alias("is_moving"))


_KW = values([(w, i, c) for i, (w, c) in enumerate(fixed.MATERIAL_KEYWORDS)])
_MARK = " OR ".join(f"contains(low, '{m}')" for m in fixed.COMPOSITE_MARKS)
MATERIAL_SQL = f"""
WITH n AS (SELECT DISTINCT material, lower(material) AS low FROM {P}),
f AS (SELECT material, low, ({_MARK}) AS composite FROM n),
h AS (SELECT f.material, f.composite, k.cat, row_number() OVER (PARTITION BY f.material
        ORDER BY CASE WHEN f.composite THEN strpos(f.low, k.w) ELSE 0 END, k.ord) AS rn
      FROM f JOIN (VALUES {_KW}) k(w, ord, cat) ON contains(f.low, k.w)),
m AS (SELECT f.material, coalesce(h.cat, 'plastic') AS category, f.composite FROM f
      LEFT JOIN h ON h.material = f.material AND h.rn = 1)
"""


@query("P12 O03", f"""{MATERIAL_SQL}
SELECT p.obj, p.label, m.category, m.composite FROM {P} p JOIN m USING (material)""")
def material_class_earliest(t: Tables) -> DataFrame:
    return ad.parts(t).select("obj", "label", cat.classify_material(F.col("material")).alias("c")).select("obj", "label", "c.*")


LOOKS = [(r[0], i, *r[1:]) for i, r in enumerate(fixed.MATERIAL_LOOKS)]


@query("P13", f"""
WITH n AS (SELECT DISTINCT material FROM {P}),
h AS (SELECT n.material, l.*, row_number() OVER (PARTITION BY n.material ORDER BY (l.look <> n.material), l.ord) AS rn
      FROM n JOIN (VALUES {values(LOOKS)}) l(look, ord, metallic, roughness, r, g, b) ON contains(lower(n.material), lower(l.look)))
SELECT p.obj, p.label, coalesce(h.metallic, 0.10) AS metallic, coalesce(h.roughness, 0.45) AS roughness,
  coalesce(h.r, 0.6) AS r, coalesce(h.g, 0.6) AS g, coalesce(h.b, 0.6) AS b
FROM {P} p LEFT JOIN h ON h.material = p.material AND h.rn = 1""")
def material_properties(t: Tables) -> DataFrame:
    out = cat.material_look(ad.parts(t), LOOKS)
    return out.select("obj", "label", "metallic", "roughness", "r", "g", "b")


HASH_SQL = ("((" + " + ".join(f"CAST(concat('0x', substr(md5({{k}}), {1 + 8 * i}, 8)) AS BIGINT)" for i in range(4))
            + ") % 4294967295)")


def hash_sql(*parts: str) -> str:
    return HASH_SQL.format(k="concat(" + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")")


def uniform_sql(*parts: str) -> str:
    return f"({hash_sql(*parts)} / CAST(4294967295 AS DOUBLE))"


OVERRIDES = [("ring", 0, 0.9, 0.2), ("bolt", 1, 0.97, 0.02), ("red", 2, 0.0, 0.6)]


@query("P13b", f"""
WITH n AS (SELECT DISTINCT name FROM {P}),
h AS (SELECT n.name, l.m, l.r, row_number() OVER (PARTITION BY n.name ORDER BY l.ord) AS rn
      FROM n JOIN (VALUES {values(OVERRIDES)}) l(kw, ord, m, r) ON contains(n.name, l.kw))
SELECT p.obj, p.label,
  round(least(greatest(coalesce(h.m, 0.1) + {uniform_sql("obj", "label", "'m'")} * 0.1 - 0.05, 0), 1), 6) AS metallic,
  round(least(greatest(coalesce(h.r, 0.5) + {uniform_sql("obj", "label", "'r'")} * 0.16 - 0.08, 0), 1), 6) AS roughness
FROM {P} p LEFT JOIN h ON h.name = p.name AND h.rn = 1""")
def part_name_override(t: Tables) -> DataFrame:
    out = cat.part_override(ad.parts(t), OVERRIDES, (0.1, 0.5), ["obj", "label"])
    return out.select("obj", "label", F.round("metallic", 6).alias("metallic"), F.round("roughness", 6).alias("roughness"))


_PHYS = values([(k, *v) for k, v in [*fixed.PHYSICS_RANGES.items(), ("base", fixed.BASE_PHYSICS)]])


@query("P14 P15", f"""
WITH m AS (SELECT obj, label, CASE WHEN size % 7 = 0 THEN NULL ELSE concat('shader_', material, CASE WHEN size % 2 = 0
    THEN '_metal_deepcopy3' ELSE '' END) END AS raw FROM {P}),
c AS (SELECT obj, label, raw, lower(split_part(replace(raw, 'shader_', ''), '_deepcopy', 1)) AS low FROM m),
k AS (SELECT *, CASE WHEN raw IS NULL THEN 'none' WHEN contains(low, 'metal') THEN 'metal' WHEN contains(low, 'plastic')
    THEN 'plastic' WHEN contains(low, 'wood') THEN 'wood' WHEN low = 'ceramic' THEN 'ceramic' ELSE 'base' END AS physics FROM c)
SELECT k.obj, k.label, k.physics,
  round(CASE WHEN raw IS NULL THEN 0 ELSE f0 + {uniform_sql("obj", "label", "'f'")} * (f1 - f0) END, 6) AS friction,
  round(CASE WHEN raw IS NULL THEN 1000 ELSE d0 + {uniform_sql("obj", "label", "'d'")} * (d1 - d0) END, 4) AS density
FROM k LEFT JOIN (VALUES {_PHYS}) r(p, f0, f1, d0, d1) ON r.p = k.physics""")
def physics_ranges(t: Tables) -> DataFrame:
    raw = "CASE WHEN size % 7 = 0 THEN NULL ELSE concat('shader_', material, CASE WHEN size % 2 = 0 THEN '_metal_deepcopy3' ELSE '' END) END AS raw"
    out = cat.draw_physics(ad.parts(t).selectExpr("obj", "label", raw), "raw", ["obj", "label"])
    return out.select("obj", "label", "physics", F.round("friction", 6).alias("friction"), F.round("density", 4).alias("density"))


MOVING = [("ECONOMY", "red widget", "moving"), ("SMALL", "small ring", "moving"), ("LARGE", "hot gear", "moving"),
          ("PROMO", "blue bolt", "moving"), ("SMALL", "blue bolt", "exclude"), ("PROMO", "small gizmo", "exclude")]


@query("P09", f"""
WITH r AS (SELECT * FROM (VALUES {values(MOVING)}) v(factory, name, role)),
h AS (SELECT p.*, EXISTS (SELECT 1 FROM r WHERE r.factory = p.factory AND r.name = p.name AND r.role = 'moving') AS hit,
   EXISTS (SELECT 1 FROM r WHERE r.factory = p.factory AND r.name = p.name AND r.role = 'exclude') AS ex FROM {P} p)
SELECT obj, label, hit OR NOT bool_or(hit) OVER (PARTITION BY obj) AS moving, ex AS excluded FROM h""")
def moving_parts_by_name(t: Tables) -> DataFrame:
    rules = cat.literal_table(t.spark, MOVING, "factory string, name string, role string")
    return cat.moving_by_name(ad.parts(t), rules, ["obj"]).select("obj", "label", "moving", "excluded")


NAMED, EXCLUDED = ["red widget", "small ring"], ["blue bolt", "hot gear"]


@query("P10", f"""{CLOSURE_SQL},
u AS (SELECT DISTINCT obj, label FROM moved WHERE type IN ('revolute', 'prismatic')),
h AS (SELECT p.obj, p.label, p.name IN ({quoted(NAMED)}) AS n, p.name IN ({quoted(EXCLUDED)}) AS x, u.label IS NOT NULL AS j
      FROM {P} p LEFT JOIN u ON u.obj = p.obj AND u.label = p.label),
a AS (SELECT *, bool_or(n) OVER (PARTITION BY obj) AS any_n FROM h),
b AS (SELECT *, CASE WHEN any_n THEN n ELSE j END AS mv FROM a),
c AS (SELECT *, bool_or(NOT x AND NOT mv) OVER (PARTITION BY obj) AS has_body FROM b)
SELECT obj, label, CASE WHEN x AND has_body THEN 'excluded' WHEN x THEN 'body' WHEN mv THEN 'moving' ELSE 'body' END AS role FROM c""")
def moving_parts_fallback(t: Tables) -> DataFrame:
    joints = ad.joints(t)
    some = joints.where("type IN ('revolute', 'prismatic')").select("obj", "joint")
    under = kin.descendant_parts(joints, ["obj"]).join(some, ["obj", "joint"], "left_semi")
    named = cat.literal_table(t.spark, [(n,) for n in NAMED], "name string")
    excluded = cat.literal_table(t.spark, [(n,) for n in EXCLUDED], "name string")
    return cat.moving_with_fallback(ad.parts(t), named, excluded, under, ["obj"]).select("obj", "label", "role")


@query("A09", f"""
SELECT factory, name, material, '1.0 g/cm^3' AS density, CAST(size AS DOUBLE) / 10 AS youngs, CAST(0.3 AS DOUBLE) AS poisson,
  CAST(count(*) AS BIGINT) AS uses FROM {P} GROUP BY ALL""")
def material_pool(t: Tables) -> DataFrame:
    rows = ad.parts(t).select("factory", "name", "material", F.lit(None).cast("string").alias("density"),
                              (F.col("size").cast("double") / 10).alias("youngs"), F.lit(None).cast("double").alias("poisson"))
    return cat.material_pool(rows)


TEXTURED = ["metal", "plastic"]


@query("A10", f"""{MATERIAL_SQL}
SELECT m.category, CAST(count(*) AS BIGINT) AS n_parts, m.category IN ({quoted(TEXTURED)}) AS textured
FROM {P} p JOIN m USING (material) GROUP BY m.category""")
def material_coverage(t: Tables) -> DataFrame:
    rows = ad.parts(t).select(cat.classify_material(F.col("material"))["category"].alias("category"))
    return cat.coverage(rows, cat.literal_table(t.spark, [(c,) for c in TEXTURED], "category string"))


@query("A10 O01", f"""{MATERIAL_SQL}
SELECT p.material, CAST(count(*) AS BIGINT) AS n_parts FROM {P} p JOIN m USING (material)
WHERE m.category NOT IN ({quoted(TEXTURED)}) GROUP BY p.material ORDER BY n_parts DESC, p.material LIMIT 20""")
def uncovered_topk(t: Tables) -> DataFrame:
    rows = ad.parts(t).select("material", cat.classify_material(F.col("material"))["category"].alias("category"))
    return cat.uncovered_materials(rows, cat.literal_table(t.spark, [(c,) for c in TEXTURED], "category string"))


@query("A11", f"""
SELECT obj, CAST(sum(size) AS DOUBLE) / count(*) AS r, CAST(sum(cents) AS DOUBLE) / count(*) AS g,
  CAST(sum(label) AS DOUBLE) / count(*) AS b FROM {P} GROUP BY obj""")
def average_colour(t: Tables) -> DataFrame:
    return ad.parts(t).groupBy("obj").agg(F.avg("size").alias("r"), F.avg("cents").alias("g"), F.avg("label").alias("b"))


@query("A14", f"""
SELECT obj, CAST(count(*) FILTER (type = 'revolute') AS BIGINT) AS revolute, CAST(count(*) FILTER (type = 'prismatic') AS BIGINT) AS prismatic,
  CAST(count(*) FILTER (type = 'continuous') AS BIGINT) AS continuous, CAST(count(*) FILTER (type <> 'fixed') AS BIGINT) AS total
FROM {ad.joints.sql} GROUP BY obj""")
def joint_type_counts(t: Tables) -> DataFrame:
    return ad.joints(t).groupBy("obj").agg(
        *[F.count_if(F.col("type") == k).alias(k) for k in fixed.MOVABLE], F.count_if(F.col("type") != "fixed").alias("total"))


@query("W01", f"""
SELECT factory, obj * 8 + label AS object_id,
  CAST(row_number() OVER (PARTITION BY factory ORDER BY obj * 8 + label) - 1 AS BIGINT) AS seed FROM {P}""")
def seed_numbering(t: Tables) -> DataFrame:
    from jointframe.plans.ordered import ranked
    ids = ad.parts(t).select("factory", (F.col("obj") * 8 + F.col("label")).alias("object_id"))
    return ranked(ids, ["factory"], ["object_id"]).select("factory", "object_id", (F.col("rn") - 1).alias("seed"))


@query("W02", f"""
SELECT factory, object_id, rn FROM (SELECT factory, obj * 8 + label AS object_id,
  CAST(row_number() OVER (PARTITION BY factory ORDER BY obj * 8 + label) AS BIGINT) AS rn FROM {P}) WHERE rn <= 3""")
def first_seeds(t: Tables) -> DataFrame:
    ids = ad.parts(t).select("factory", (F.col("obj") * 8 + F.col("label")).alias("object_id"))
    return cat.first_per_factory(ids, ["factory"], ["object_id"], 3)


@query("W03", f"""
SELECT obj, joint, CAST(row_number() OVER (PARTITION BY obj ORDER BY joint) - 1 AS BIGINT) + 10 AS mode
FROM {ad.joints.sql} WHERE type <> 'fixed'""")
def joint_modes(t: Tables) -> DataFrame:
    """Mode 10 + i drives the i-th joint by name; an object has few joints."""
    from pyspark.sql import Window
    order = Window.partitionBy("obj").orderBy("joint")
    return ad.joints(t).where("type <> 'fixed'").select(
        "obj", "joint", (F.row_number().over(order).cast("bigint") + 9).alias("mode"))


@query("J19", f"""
SELECT obj AS factory FROM {P} WHERE factory IN ('SMALL', 'LARGE') GROUP BY obj HAVING count(DISTINCT factory) = 2""")
def usage_division(t: Tables) -> DataFrame:
    """Objects that use parts of both types."""
    tags = ad.parts(t).select(F.col("obj").alias("factory"), F.col("factory").alias("tag"))
    return cat.factories_with_all(tags, ["SMALL", "LARGE"])


@query("J19", f"""
SELECT DISTINCT obj AS factory, factory AS tag FROM {P} UNION ALL SELECT DISTINCT obj, concat('generator:', CAST(obj AS STRING)) FROM {P}""")
def factory_usages(t: Tables) -> DataFrame:
    """Reverse lookup: the part types of every object and its generator tag."""
    return cat.usages_of_factories(ad.parts(t).select(F.col("obj").alias("factory"), F.col("factory").alias("tag")))


@query("J01 P05", f"""
SELECT j.obj, j.joint, p.label, p.name FROM {ad.joints.sql} j JOIN {P} p
  ON p.obj = j.obj AND (p.label = j.label OR p.label = (j.label + 1) % 8) WHERE j.type <> 'fixed'""")
def parts_of_groups(t: Tables) -> DataFrame:
    """Group label lists exploded to parts."""
    groups = ad.joints(t).where("type <> 'fixed'").select(
        "obj", "joint", F.explode(F.array(F.col("label"), (F.col("label") + 1) % 8)).alias("label"))
    return groups.join(ad.parts(t).select("obj", "label", "name"), ["obj", "label"]).select("obj", "joint", "label", "name")


@query("J27", f"""
WITH d AS (SELECT * FROM (VALUES ('ECONOMY', 'SMALL', 4), ('LARGE', 'PROMO', 3)) v(factory, donor, n))
SELECT p.obj, p.label, d.donor, {hash_sql("p.obj", "p.label")} % d.n AS texture,
  {uniform_sql("p.obj", "p.label", "'use'")} < 0.5 AS used FROM {P} p JOIN d USING (factory)""")
def texture_donors(t: Tables) -> DataFrame:
    donors = cat.literal_table(t.spark, [("ECONOMY", "SMALL", 4), ("LARGE", "PROMO", 3)], "factory string, donor string, n int")
    key = (F.col("obj"), F.col("label"))
    return ad.parts(t).join(donors, "factory").select(
        "obj", "label", "donor", (sc.stable_hash(*key) % F.col("n")).alias("texture"),
        sc.bernoulli(0.5, *key, F.lit("use")).alias("used"))


@query("U04", f"SELECT DISTINCT factory AS name FROM {P} UNION SELECT DISTINCT brand FROM {P} UNION SELECT 'GenericFactory'")
def factory_union(t: Tables) -> DataFrame:
    parts = ad.parts(t)
    extra = cat.literal_table(t.spark, [("GenericFactory",)], "name string")
    return parts.select(F.col("factory").alias("name")).union(parts.select("brand")).union(extra).distinct()


@query("U05", f"""
WITH a AS (SELECT name, min(factory) AS rule FROM {P} WHERE factory IN ('SMALL', 'LARGE') GROUP BY name),
b AS (SELECT name, min(material) AS rule FROM {P} GROUP BY name)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)""")
def rule_merge(t: Tables) -> DataFrame:
    parts = ad.parts(t)
    first = parts.where("factory IN ('SMALL', 'LARGE')").groupBy("name").agg(F.min("factory").alias("rule"))
    return cat.merge_rules(first, parts.groupBy("name").agg(F.min("material").alias("rule")), "name")

"""Scene-check queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe.functions import linalg as la
from jointframe.functions import scalar as sc
from jointframe.operators import catalog as cat
from jointframe.operators import scenes as sn
from jointframe.queries.catalog import values
from jointframe.queries.geometry import rounded, rsql
from jointframe.registry import query
from jointframe.session import Tables

# Customers as objects; relations come from orders and point to another object of the scene.
OBJS = ad.scene_objects.sql
RELS = """(SELECT CAST(floor(o_custkey / 50.0) AS BIGINT) AS scene, o_custkey AS child, CASE o_orderstatus WHEN 'F' THEN 'stable_against'
  WHEN 'O' THEN 'supported_by' ELSE 'coplanar' END AS relation, CAST(floor(o_custkey / 50.0) AS BIGINT) * 50 + o_orderkey % 50 AS target FROM orders)"""
IMPLIED = [("stable_against", "stable_against"), ("supported_by", "supported_by"), ("coplanar", "coplanar"), ("stable_against", "touching"), ("supported_by", "touching")]
_IMP = f"(VALUES {values(IMPLIED)})"


def objects(t: Tables) -> DataFrame:
    o = ad.scene_objects(t)
    pos = F.array_compact(F.array(F.col("tag"), F.when(F.col("w") > 2, "wide"), F.when(F.col("h") > 3, "tall")))
    neg = F.array_compact(F.array(F.when(F.col("d") > 2, "small")))
    return o.withColumns({"pos": pos, "neg": neg, "dims": F.array("w", "d", "h")})


def relations(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "CAST(floor(o_custkey / 50.0) AS BIGINT) AS scene", "o_custkey AS child",
        "CASE o_orderstatus WHEN 'F' THEN 'stable_against' WHEN 'O' THEN 'supported_by' ELSE 'coplanar' END AS relation",
        "CAST(floor(o_custkey / 50.0) AS BIGINT) * 50 + o_orderkey % 50 AS target")


def implied(t: Tables) -> DataFrame:
    return cat.literal_table(t.spark, IMPLIED, "relation string, implied string")


def scene_ids(t: Tables) -> DataFrame:
    return ad.scene_objects(t).select("scene").distinct()


# -- tags ---------------------------------------------------------------------------------

@query("P22 P24", f"SELECT scene, obj FROM {OBJS} WHERE active AND w > 2 AND NOT (h > 3)")
def tagged_objects(t: Tables) -> DataFrame:
    return sn.tagged(objects(t), ["wide"], ["tall"]).select("scene", "obj")


@query("P22 P24", f"SELECT scene, obj FROM {OBJS} WHERE active AND tag = 'building' AND NOT (d > 2)")
def tagged_refusals(t: Tables) -> DataFrame:
    """Objects that refuse a wanted tag themselves do not satisfy it."""
    o = objects(t).withColumn("pos", F.array_append("pos", F.lit("small")))
    return sn.tagged(o, ["building", "small"]).select("scene", "obj")


@query("P24", f"""
SELECT scene, obj, 'any' AS kind FROM {OBJS} WHERE active AND (w > 2 OR tag = 'building') UNION ALL SELECT scene, obj, 'none' FROM {OBJS} WHERE active AND NOT (w > 2 OR tag = 'building')""")
def tag_sets(t: Tables) -> DataFrame:
    o = objects(t)
    return sn.any_tag(o, ["wide", "building"]).select("scene", "obj", F.lit("any").alias("kind")).unionByName(
        sn.excludes(o, ["wide", "building"]).select("scene", "obj", F.lit("none").alias("kind")))


@query("P23 U06", f"""
SELECT scene, obj, NOT (w > 3 AND w > 2) AND (h > 3 OR NOT h > 4) AND (NOT (d > 1) OR d > 2) AS implies, w > 3 AND w > 2 AS contradiction FROM {OBJS}""")
def tag_implication(t: Tables) -> DataFrame:
    """Own tags against tags asked by size: wide refused by the widest, tall and small asked from some."""
    o = objects(t)
    neg = F.array_compact(F.array(F.when(F.col("d") > 2, "small"), F.when(F.col("w") > 3, "wide")))
    want = F.array_compact(F.array(F.when(F.col("h") > 4, "tall")))
    refuse = F.array_compact(F.array(F.when(F.col("d") > 1, "small")))
    return o.select("scene", "obj", sn.implies(F.col("pos"), neg, want, refuse).alias("implies"), sn.contradiction(F.col("pos"), neg).alias("contradiction"))


@query("U06", f"""
SELECT scene, obj, CAST(2 + (w > 2)::INT AS BIGINT) AS n_pos, CAST((d > 2)::INT + (h > 4)::INT AS BIGINT) AS n_neg FROM {OBJS} WHERE NOT (w > 2 AND h > 4)""")
def tag_intersection(t: Tables) -> DataFrame:
    """Own tags together with tall wanted, and wide refused from the tallest; objects to which that is a contradiction are left out first."""
    o = objects(t)
    want, refuse = F.array(F.lit("tall")), F.array_compact(F.array(F.when(F.col("h") > 4, "wide")))
    both = o.where(~sn.contradiction(F.array_union("pos", want), F.array_union("neg", refuse)))
    p, n = sn.intersection(F.col("pos"), F.col("neg"), want, refuse)
    return both.select("scene", "obj", F.size(p).cast("bigint").alias("n_pos"), F.size(n).cast("bigint").alias("n_neg"))


@query("P23 U06", f"""
SELECT scene, obj, CAST(1 + (w > 2)::INT + (h > 3)::INT + (d <= 2)::INT AS BIGINT) AS n_pos, CAST((d > 2)::INT + (CASE WHEN w > 2 THEN 0 ELSE 1 END) AS BIGINT) AS n_neg FROM {OBJS}""")
def tag_difference(t: Tables) -> DataFrame:
    """Difference to: wide wanted, small refused."""
    p, n = sn.difference(F.col("pos"), F.col("neg"), F.array(F.lit("wide")), F.array(F.lit("small")))
    return objects(t).select("scene", "obj", F.size(p).cast("bigint").alias("n_pos"), F.size(n).cast("bigint").alias("n_neg"))


# -- relations ----------------------------------------------------------------------------

@query("J20 J22", f"""
SELECT o.scene, o.obj FROM {OBJS} o WHERE active AND EXISTS (SELECT 1 FROM {RELS} r JOIN {_IMP} i(rel, imp) ON i.rel = r.relation AND i.imp = 'touching'
  JOIN {OBJS} p ON p.scene = r.scene AND p.obj = r.target AND p.active AND p.w > 2 WHERE r.scene = o.scene AND r.child = o.obj)""")
def relation_semi(t: Tables) -> DataFrame:
    o = objects(t)
    return sn.related(sn.tagged(o), relations(t), sn.tagged(o, ["wide"]), "touching", implied(t)).select("scene", "obj")


#: Kinds of relations and their special cases, and what is asked: (question, kind, negated, child tags wanted and refused, parent tags wanted and refused).
BELOW = (("touching", "supported_by"),)
ASKED = [
    (0, "any", False, [], [], [], []), (1, "any", True, [], [], [], []), (2, "supported_by", False, ["wide"], [], [], []), (3, "supported_by", True, ["wide"], ["small"], ["tall"], []),
    (4, "touching", False, [], [], ["tall"], ["small"]), (5, "stable_against", False, ["wide", "tall"], [], [], []), (6, "stable_against", True, ["wide"], [], ["tall"], []), (7, "coplanar", False, [], ["small"], [], []),
]
_KIND = "CASE WHEN o_orderkey % 11 = 0 THEN 'any' WHEN o_orderkey % 3 = 0 THEN 'touching' ELSE relation END"
_TAGGED = f"""(SELECT scene, obj, list_filter([CASE WHEN w > 2 THEN 'wide' END, CASE WHEN h > 3 THEN 'tall' END], lambda x: x IS NOT NULL) AS pos, CASE WHEN d > 2 THEN ['small'] ELSE [] END AS neg FROM {OBJS})"""


def _follows(p: str, q: str, flip: bool = False) -> str:
    """Tags of q follow from those of p, for child and parent, in SQL; with ``flip`` q's are the other way round."""
    x, y = ("n", "p") if flip else ("p", "n")
    return " AND ".join(f"NOT list_has_any({p}.{s}p, {p}.{s}n) AND list_has_all({p}.{s}p, {q}.{s}{x}) AND list_has_all({p}.{s}n, {q}.{s}{y})" for s in "cr")


def _covers_sql(p: str, q: str) -> str:
    return f"({p}.kind = {q}.kind OR ({p}.kind = 'touching' AND {q}.kind = 'supported_by'))"


def _entails_sql(p: str, q: str) -> str:
    return f"(CASE WHEN {p}.kind = 'any' THEN {q}.kind = 'any' WHEN {q}.kind = 'any' THEN true ELSE {_covers_sql(p, q)} AND {_follows(p, q)} END)"


def _beside_sql(p: str, q: str) -> str:
    return f"(CASE WHEN {p}.kind = 'any' THEN true WHEN {q}.kind = 'any' THEN false ELSE NOT {_entails_sql(q, p)} END)"


_ASKED_SQL = "(VALUES " + ", ".join(f"({q[0]}, '{q[1]}', {str(q[2]).lower()}, " + ", ".join(f"CAST({v} AS VARCHAR[])" for v in q[3:]) + ")" for q in ASKED) + ") q(question, kind, neg, cp, cn, rp, rn)"
_COMPATIBLE = " AND ".join(f"NOT list_has_any(list_concat(s.{s}p, q.{s}p), list_concat(s.{s}n, q.{s}n))" for s in "cr")


@query("J22", f"""
WITH r AS (SELECT *, {_KIND} AS kind, o_orderkey % 5 = 0 AS neg FROM (SELECT *, {RELS.partition("SELECT ")[2].rpartition(" FROM orders)")[0]} FROM orders)),
s AS (SELECT r.kind, r.neg, c.pos AS cp, c.neg AS cn, p.pos AS rp, p.neg AS rn FROM r JOIN {_TAGGED} c ON c.scene = r.scene AND c.obj = r.child JOIN {_TAGGED} p ON p.scene = r.scene AND p.obj = r.target)
SELECT CAST(q.question AS INTEGER) AS question, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (CASE WHEN s.neg AND q.neg THEN {_entails_sql("s", "q")} WHEN s.neg THEN q.kind <> 'any' AND NOT {_entails_sql("s", "q")} AND NOT {_beside_sql("q", "s")}
    WHEN q.neg THEN s.kind <> 'any' AND q.kind <> 'any' AND {_covers_sql("s", "q")} AND {_follows("s", "q", True)} ELSE {_entails_sql("s", "q")} END) AS BIGINT) AS n_implied,
  CAST(count(*) FILTER (CASE WHEN s.neg AND q.neg THEN s.kind <> 'any' AND q.kind <> 'any' WHEN s.neg THEN {_beside_sql("q", "s")} WHEN q.neg THEN {_beside_sql("s", "q")}
    ELSE s.kind = 'any' OR q.kind = 'any' OR ({_covers_sql("s", "q")} AND {_COMPATIBLE}) END) AS BIGINT) AS n_met
FROM s, {_ASKED_SQL} GROUP BY q.question""")
def relation_statements(t: Tables) -> DataFrame:
    """Statements made of the relations and the tags of both ends, one in five refused, against the statements asked."""
    rel = t.orders.selectExpr(
        "o_orderkey", "CAST(floor(o_custkey / 50.0) AS BIGINT) AS scene", "o_custkey AS child",
        "CASE o_orderstatus WHEN 'F' THEN 'stable_against' WHEN 'O' THEN 'supported_by' ELSE 'coplanar' END AS relation", "CAST(floor(o_custkey / 50.0) AS BIGINT) * 50 + o_orderkey % 50 AS target")
    tags = ad.scene_objects(t).select("scene", "obj", F.array_compact(F.array(F.when(F.col("w") > 2, "wide"), F.when(F.col("h") > 3, "tall"))).alias("pos"), F.array_compact(F.array(F.when(F.col("d") > 2, "small"))).alias("neg"))
    ends = [tags.select("scene", F.col("obj").alias(k), F.col("pos").alias(f"{e}_pos"), F.col("neg").alias(f"{e}_neg")) for k, e in (("child", "child"), ("target", "parent"))]
    rel = rel.withColumns({"kind": F.expr(_KIND), "negated": F.col("o_orderkey") % 5 == 0}).join(ends[0], ["scene", "child"]).join(ends[1], ["scene", "target"])
    # Few statements differ: each is compared once, with its number.
    statement = F.struct("kind", "negated", "child_pos", "child_neg", "parent_pos", "parent_neg").alias("statement")
    made = rel.select(statement).groupBy("statement").agg(F.count("*").alias("n"))
    out = sn.compared_statements(made, ASKED, sn.RelationLogic(BELOW))
    return out.groupBy("question").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("implied", "met")])


@query("J21", f"""
WITH r AS (SELECT r.*, i.imp FROM {RELS} r JOIN {_IMP} i(rel, imp) ON i.rel = r.relation),
tall AS (SELECT scene, obj FROM {OBJS} WHERE active AND h > 3), wide AS (SELECT o.scene, o.obj FROM {OBJS} o WHERE active AND w > 2
   AND NOT EXISTS (SELECT 1 FROM r JOIN tall p ON p.scene = r.scene AND p.obj = r.target WHERE r.scene = o.scene AND r.child = o.obj AND r.imp = 'coplanar'))
SELECT o.scene, o.obj FROM {OBJS} o WHERE active AND EXISTS (SELECT 1 FROM r JOIN wide p ON p.scene = r.scene AND p.obj = r.target WHERE r.scene = o.scene AND r.child = o.obj AND r.imp = 'supported_by')""")
def domain_members(t: Tables) -> DataFrame:
    """Objects supported by a wide object that is coplanar with no tall one."""
    wide = sn.Domain(want=("wide",), clauses=(("coplanar", sn.Domain(want=("tall",)), False),))
    dom = sn.Domain(clauses=(("supported_by", wide, True),))
    return sn.members(objects(t), relations(t), dom, implied(t)).select("scene", "obj")


@query("A28 J20 F03", f"""
WITH k AS (SELECT DISTINCT r.scene, r.child, r.target FROM {RELS} r JOIN {OBJS} c ON c.scene = r.scene AND c.obj = r.child AND c.active WHERE r.relation = 'supported_by')
SELECT o.scene, o.obj, CAST(count(k.child) AS BIGINT) AS n FROM {OBJS} o LEFT JOIN k ON k.scene = o.scene AND k.target = o.obj WHERE o.active GROUP BY o.scene, o.obj""")
def supported_counts(t: Tables) -> DataFrame:
    o = sn.tagged(objects(t))
    return sn.related_counts(o, relations(t), o, "supported_by", implied(t))


@query("A28 F03", f"""
SELECT s.scene, CAST(count(o.obj) AS BIGINT) AS n, coalesce(sum(o.w), 0.0) AS total, coalesce(avg(o.w), 0.0) AS mean, coalesce(bool_and(o.w > 0), true) AS all_positive
FROM (SELECT DISTINCT scene FROM {OBJS}) s LEFT JOIN (SELECT * FROM {OBJS} WHERE active AND tag = 'building' AND h > 4) o ON o.scene = s.scene GROUP BY s.scene""")
def set_scalars(t: Tables) -> DataFrame:
    chosen = sn.tagged(objects(t), ["building"]).where("h > 4")
    return sn.set_scalars(chosen, scene_ids(t), F.col("w"))


COUNTS = f"(SELECT scene, count(*) FILTER (active AND w > 2) AS a, count(*) FILTER (active AND h > 3) AS b FROM {OBJS} GROUP BY scene)"


@query("A29 P32 X30", f"""
SELECT scene, CAST(greatest(b - a, 0) AS BIGINT) AS ge, CAST(greatest(a - b, 0) AS BIGINT) AS le, CAST(greatest(b - a + 1, 0) AS BIGINT) AS gt,
  CAST(greatest(a - b + 1, 0) AS BIGINT) AS lt, CAST(abs(a - b) AS BIGINT) AS eq, CAST(greatest(18 - a, a - 21, 0) AS BIGINT) AS rng, a BETWEEN 18 AND 21 AS ok,
  CAST(least(abs(a - b), greatest(b - a, 0)) AS BIGINT) AS alt, CAST(CASE WHEN a / 2.0 > b THEN 0 ELSE 1 END AS INTEGER) AS flt FROM {COUNTS}""")
def violation_counts(t: Tables) -> DataFrame:
    o = objects(t)
    n = o.groupBy("scene").agg(F.count_if(F.col("active") & (F.col("w") > 2)).alias("a"), F.count_if(F.col("active") & (F.col("h") > 3)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return n.select("scene", *[sn.shortfall(a, op, b).alias(op) for op in ("ge", "le", "gt", "lt", "eq")], sn.outside(a, 18, 21).alias("rng"), a.between(18, 21).alias("ok"),
                    sn.either(sn.shortfall(a, "eq", b), sn.shortfall(a, "ge", b)).alias("alt"), sn.broken(a / 2.0 > b).alias("flt"))


@query("A29 A30 X31", f"""
WITH t AS (SELECT scene, 'wide_share' AS term, round(-2.0 * a / (a + b), 6) AS loss, CAST(greatest(b - a + 1, 0) AS DOUBLE) AS viol FROM {COUNTS}
UNION ALL SELECT scene, 'tall_range', round(0.5 * b, 6), CAST(greatest(16 - b, b - 18, 0) AS DOUBLE) FROM {COUNTS})
SELECT * FROM t""")
def violation_report(t: Tables) -> DataFrame:
    return _report(t).withColumn("loss", F.round("loss", 6))


def _report(t: Tables) -> DataFrame:
    o = objects(t)
    n = o.groupBy("scene").agg(F.count_if(F.col("active") & (F.col("w") > 2)).alias("a"), F.count_if(F.col("active") & (F.col("h") > 3)).alias("b"))
    wide = n.select("scene", (-2.0 * F.col("a") / (F.col("a") + F.col("b"))).alias("loss"), sn.shortfall(F.col("a"), "gt", F.col("b")).alias("viol"))
    tall = n.select("scene", (0.5 * F.col("b")).alias("loss"), sn.outside(F.col("b"), 16, 18).alias("viol"))
    return sn.report({"wide_share": wide, "tall_range": tall}, scene_ids(t))


@query("A30", f"""
SELECT scene, round(-2.0 * a / (a + b) + 0.5 * b, 6) AS loss, CAST(greatest(b - a + 1, 0) + greatest(16 - b, b - 18, 0) AS DOUBLE) AS viol,
  CAST((greatest(b - a + 1, 0) > 0)::INT + (greatest(16 - b, b - 18, 0) > 0)::INT AS BIGINT) AS n_violated FROM {COUNTS}""")
def violation_totals(t: Tables) -> DataFrame:
    return sn.report_totals(_report(t)).withColumn("loss", F.round("loss", 6))


@query("A31", f"""
SELECT scene, round(sum(w * d * h / least(w, d, h) + 1e-10), 6) AS volume FROM {OBJS} WHERE active GROUP BY scene""")
def top_face_area(t: Tables) -> DataFrame:
    """Product of the two largest sizes."""
    return sn.volumes(sn.tagged(objects(t)), 2).withColumn("volume", F.round("volume", 6))


@query("A37", f"""
SELECT scene, round(CASE a WHEN 20 THEN -ln(0.5 + 1e-20) WHEN 21 THEN -ln(0.3 + 1e-20) WHEN 22 THEN -ln(0.2 + 1e-20) ELSE -ln(1e-100) END, 6) AS cat,
  round(CASE WHEN a % 3 = 1 THEN -ln(0.7) WHEN a % 3 = 0 THEN -ln(0.3) ELSE -ln(1e-100) END, 6) AS bern FROM {COUNTS}""")
def count_surprise(t: Tables) -> DataFrame:
    n = objects(t).groupBy("scene").agg(F.count_if(F.col("active") & (F.col("w") > 2)).alias("a"))
    shifted = F.when(F.col("a").between(20, 22), F.col("a") - 20).otherwise(3)
    return n.select("scene", F.round(sn.surprise(shifted, [0.5, 0.3, 0.2]), 6).alias("cat"), F.round(sn.bernoulli_surprise(F.col("a") % 3, 0.7), 6).alias("bern"))


@query("O06", f"""
SELECT scene, obj, rn FROM (SELECT scene, obj, CAST(row_number() OVER (PARTITION BY scene ORDER BY obj) AS BIGINT) AS rn FROM {OBJS} o WHERE active
  AND NOT EXISTS (SELECT 1 FROM {RELS} r WHERE r.scene = o.scene AND r.target = o.obj AND r.relation = 'coplanar')) WHERE rn <= 5""")
def capped_candidates(t: Tables) -> DataFrame:
    held = relations(t).where("relation = 'coplanar'").select("scene", F.col("target").alias("obj")).distinct()
    return sn.capped_candidates(sn.tagged(objects(t)), held, 5).select("scene", "obj", "rn")


# -- boxes --------------------------------------------------------------------------------

BOX = f"(SELECT *, x - w / 2 AS x0, x + w / 2 AS x1, y - d / 2 AS y0, y + d / 2 AS y1, z - h / 2 AS z0, z + h / 2 AS z1 FROM {OBJS})"
_TOUCH = "a.scene = b.scene AND a.obj <> b.obj AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1"
_DEPTH = "least(least(a.x1, b.x1) - greatest(a.x0, b.x0), least(a.y1, b.y1) - greatest(a.y0, b.y0), least(a.z1, b.z1) - greatest(a.z0, b.z0))"
_GAP = "sqrt(" + " + ".join(f"power(greatest(b.{c}0 - a.{c}1, a.{c}0 - b.{c}1, 0), 2)" for c in "xyz") + ")"


def boxed(t: Tables) -> DataFrame:
    return sn.box_of(objects(t))


@query("J13", f"SELECT a.scene, a.obj AS a, b.obj AS b, {_DEPTH} AS depth FROM {BOX} a JOIN {BOX} b ON {_TOUCH}")
def box_overlap(t: Tables) -> DataFrame:
    b = boxed(t)
    return sn.touching(b, b).select("scene", "a", "b", "depth")


@query("J13", f"""
SELECT a.scene, a.obj AS a, b.obj AS b FROM (SELECT *, x0 - 3 AS X0_, x1 + 3 AS X1_ FROM {BOX}) a JOIN {BOX} b ON a.scene = b.scene AND a.obj <> b.obj AND a.X0_ <= b.x0 AND b.x1 <= a.X1_
  AND a.y0 - 3 <= b.y0 AND b.y1 <= a.y1 + 3 AND a.z0 - 3 <= b.z0 AND b.z1 <= a.z1 + 3""")
def box_containment(t: Tables) -> DataFrame:
    """Boxes inside others that are grown by 3 on every side."""
    b = boxed(t)
    grown = b.withColumns({f"lo_{c}": F.col(f"lo_{c}") - 3 for c in "xyz"}).withColumns({f"hi_{c}": F.col(f"hi_{c}") + 3 for c in "xyz"})
    return sn.contained(grown, b).select("scene", "a", "b")


_AB = "(SELECT * FROM {B} WHERE active AND tag = 'building') a JOIN (SELECT * FROM {B} WHERE active AND tag = 'machinery') b ON a.scene = b.scene".replace("{B}", BOX)


@query("J30 J31", f"""
WITH s AS (SELECT DISTINCT scene FROM {OBJS}), m AS (SELECT a.scene, min({_GAP}) AS dist FROM {_AB} GROUP BY a.scene)
SELECT s.scene, round(coalesce(m.dist, 0), 6) AS dist, round(greatest(coalesce(m.dist, 0) - 4, 2 - coalesce(m.dist, 0), 0), 6) AS off FROM s LEFT JOIN m USING (scene)""")
def set_distance(t: Tables) -> DataFrame:
    b = boxed(t)
    dist = sn.min_distances(sn.tagged(b, ["building"]), sn.tagged(b, ["machinery"]), scene_ids(t))
    return dist.select("scene", F.round("dist", 6).alias("dist"), F.round(sn.outside(F.col("dist"), 2.0, 4.0), 6).alias("off"))


@query("J30", f"""
WITH s AS (SELECT DISTINCT scene FROM {OBJS}), m AS (SELECT a.scene, min({_GAP}) AS dist FROM (SELECT * FROM {BOX} WHERE active AND tag = 'building') a
  JOIN (SELECT * FROM {BOX} WHERE active AND tag = 'building') b ON a.scene = b.scene AND a.obj <> b.obj GROUP BY a.scene)
SELECT s.scene, round(coalesce(m.dist, 0), 6) AS dist FROM s LEFT JOIN m USING (scene)""")
def internal_distance(t: Tables) -> DataFrame:
    """Least distance inside one set; fewer than two objects have none."""
    one = sn.tagged(boxed(t), ["building"])
    two = one.join(one.groupBy("scene").count().where("count > 1").select("scene"), "scene", "left_semi")
    return sn.min_distances(two, two, scene_ids(t)).withColumn("dist", F.round("dist", 6))


@query("J31", f"""
WITH s AS (SELECT DISTINCT scene FROM {OBJS}), m AS (SELECT a.scene, min({_GAP}) AS dist FROM {_AB} GROUP BY a.scene),
t AS (SELECT a.scene, max({_DEPTH}) AS depth FROM {_AB} WHERE {_TOUCH} GROUP BY a.scene)
SELECT s.scene, round(coalesce(t.depth, m.dist, 0), 6) AS score FROM s LEFT JOIN m USING (scene) LEFT JOIN t USING (scene)""")
def soft_contact(t: Tables) -> DataFrame:
    b = boxed(t)
    one, two = sn.tagged(b, ["building"]), sn.tagged(b, ["machinery"])
    out = sn.soft_contact(sn.touching(one, two), sn.min_distances(one, two, scene_ids(t)))
    return out.withColumn("score", F.round("score", 6))


@query("J29", f"""
SELECT DISTINCT r.scene, r.child, r.target, a.x BETWEEN b.x0 AND b.x1 AND a.y BETWEEN b.y0 AND b.y1 AS supported, b.x0 <= a.x0 AND a.x1 <= b.x1 AND b.y0 <= a.y0 AND a.y1 <= b.y1 AS stable,
  a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AS overhang, b.y0 <= a.y0 AND a.y1 <= b.y1 AS beside
FROM {RELS} r JOIN {BOX} a ON a.scene = r.scene AND a.obj = r.child JOIN {BOX} b ON b.scene = r.scene AND b.obj = r.target""")
def support_checks(t: Tables) -> DataFrame:
    return sn.supported(relations(t).select("scene", "child", "target").distinct(), boxed(t))


@query("J28", f"""
WITH r AS (SELECT DISTINCT scene, child, target, child % 3 AS margin FROM {RELS} WHERE relation = 'coplanar'),
p AS (SELECT scene, obj, CASE WHEN obj % 4 = 0 THEN 1.0 ELSE 0.0 END AS n0, CASE WHEN obj % 4 = 0 THEN 0.0 ELSE 1.0 END AS n2, x AS p0, z AS p2 FROM {OBJS})
SELECT r.scene, r.child, r.target, abs(abs(a.n0 * b.n0 + a.n2 * b.n2) - 1) <= 0.01 AND abs((a.p0 - b.p0) * b.n0 + (a.p2 - b.p2) * b.n2 - margin) <= 0.01 AS ok
FROM r JOIN p a ON a.scene = r.scene AND a.obj = r.child JOIN p b ON b.scene = r.scene AND b.obj = r.target""")
def coplanar_relations(t: Tables) -> DataFrame:
    rel = relations(t).where("relation = 'coplanar'").select("scene", "child", "target", (F.col("child") % 3).alias("margin")).distinct()
    side = F.col("obj") % 4 == 0
    planes = objects(t).select("scene", "obj", F.when(side, 1.0).otherwise(0.0).alias("n0"), F.lit(0.0).alias("n1"), F.when(side, 0.0).otherwise(1.0).alias("n2"),
                               F.col("x").alias("p0"), F.col("y").alias("p1"), F.col("z").alias("p2"))
    return sn.coplanar_relations(rel, planes)


# -- scores -------------------------------------------------------------------------------

_ACT = f"(SELECT * FROM {OBJS} WHERE active)"


@query("A38", f"""
WITH c AS (SELECT scene, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM {_ACT} GROUP BY scene),
r AS (SELECT o.scene, o.obj, n, yaw, x - mx AS dx, y - my AS dy, atan2(y - my, x - mx) AS ang FROM {_ACT} o JOIN c USING (scene)),
k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY ang, obj) - 1 AS i, first_value(ang) OVER (PARTITION BY scene ORDER BY ang, obj) AS a0,
  first_value(yaw) OVER (PARTITION BY scene ORDER BY ang, obj) AS y0, max(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY scene) AS big FROM r),
p AS (SELECT scene, n, sqrt(dx * dx + dy * dy) / big * cos(ang - a0 - i * 2 * pi() / n) AS px, sqrt(dx * dx + dy * dy) / big * sin(ang - a0 - i * 2 * pi() / n) AS py,
  cos(yaw - y0 - i * 2 * pi() / n) AS vx, sin(yaw - y0 - i * 2 * pi() / n) AS vy FROM k)
SELECT scene, round(CASE WHEN max(n) > 1 THEN (var_pop(px) + var_pop(py) + var_pop(vx) + var_pop(vy)) / 2 ELSE 0 END, 6) AS score FROM p GROUP BY scene""")
def rotational_asymmetry(t: Tables) -> DataFrame:
    return sn.rotational_asymmetry(sn.tagged(objects(t))).withColumn("score", F.round("score", 6))


_PCA = f"""
g AS (SELECT scene, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, 0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) AS t, sqrt(2 * (var_samp(x) + var_samp(y))) AS s FROM {_ACT} GROUP BY scene)"""


@query("A43", f"WITH {_PCA} SELECT scene, {rsql(['cx', 'cy', 'cz', '-sin(t)', 'cos(t)', 'cos(t)', 'sin(t)'], ['cx', 'cy', 'cz', 'long0', 'long1', 'short0', 'short1'])} FROM g")
def principal_axes(t: Tables) -> DataFrame:
    out = sn.principal_axes(sn.tagged(objects(t)), ["scene"])
    return out.select("scene", *rounded(["cx", "cy", "cz", "long0", "long1", "short0", "short1"]))


@query("A39 X24", f"""WITH {_PCA},
i AS (SELECT o.scene, o.obj AS b, x - 2 * ((x - cx) * -sin(t) + (y - cy) * cos(t)) * -sin(t) AS bx, y - 2 * ((x - cx) * -sin(t) + (y - cy) * cos(t)) * cos(t) AS by_,
   2 * atan2(sin(t), cos(t)) - yaw AS yb FROM {_ACT} o JOIN g USING (scene)),
d AS (SELECT o.scene, o.obj, o.w, o.yaw - i.yb AS turn, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) AS dist, row_number() OVER (PARTITION BY o.scene, o.obj ORDER BY sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)), i.b) AS rn
   FROM {_ACT} o JOIN i USING (scene)),
e AS (SELECT scene, w, dist, turn - 2 * pi() * floor(turn / (2 * pi())) AS a FROM d WHERE rn = 1),
u AS (SELECT scene, sum(w * w * w * (dist + least(a, 2 * pi() - a))) AS dev FROM e GROUP BY scene)
SELECT u.scene, round(1 - 1 / (1 + dev / s), 6) AS score FROM u JOIN g USING (scene)""")
def reflectional_asymmetry(t: Tables) -> DataFrame:
    return sn.reflectional_asymmetry(sn.tagged(objects(t))).withColumn("score", F.round("score", 6))


@query("A40", f"""WITH {_PCA},
b AS (SELECT o.*, round((x - cx) * cos(t) + (y - cy) * sin(t), 9) AS al FROM {BOX} o JOIN g USING (scene) WHERE active),
n AS (SELECT scene, {", ".join(f"abs({c} - lead({c}) OVER w) AS g{i}" for i, c in enumerate(("x0", "x1", "y0", "y1", "z0", "z1")))} FROM b WINDOW w AS (PARTITION BY scene ORDER BY al, obj))
SELECT scene, round(sum(CASE WHEN g0 IS NULL THEN 0 ELSE list_sum(list_sort([g0, g1, g2, g3, g4, g5])[1:4]) END) / count(*), 6) AS score FROM n GROUP BY scene""")
def coplanarity(t: Tables) -> DataFrame:
    return sn.coplanarity(sn.tagged(objects(t))).withColumn("score", F.round("score", 6))


# Rooms: one L-shaped ring per supplier; the scene of a supplier is its hundred, walls of the room of the same number.
_RING = [(0, "0", "0"), (1, "w", "0"), (2, "w", "d"), (3, "w / 2", "d"), (4, "w / 2", "h"), (5, "0", "h")]
_ROOM_COLS = "s_suppkey AS room, CAST(floor(s_suppkey / 20.0) AS BIGINT) AS scene, CAST(s_suppkey % 3 AS BIGINT) AS level, CAST(4 + s_suppkey % 9 AS DOUBLE) AS w, CAST(5 + s_suppkey % 7 AS DOUBLE) AS d, CAST(6 + s_suppkey % 4 AS DOUBLE) + 3 AS h"
ROOMS = f"(SELECT {_ROOM_COLS} FROM supplier)"
RING = "(" + " UNION ALL ".join(f"SELECT scene, room, level, CAST({i} AS BIGINT) AS ring_idx, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {ROOMS}" for i, x, y in _RING) + ")"
EDGES = f"(SELECT *, coalesce(lead(x) OVER r, first_value(x) OVER r) AS x1, coalesce(lead(y) OVER r, first_value(y) OVER r) AS y1 FROM {RING} WINDOW r AS (PARTITION BY scene, room ORDER BY ring_idx))"
ROOM = ["scene", "room"]


def rings(t: Tables) -> DataFrame:
    rooms = t.supplier.selectExpr(*[c.strip() for c in _ROOM_COLS.split(", ")])
    corners = F.array(*[F.struct(F.lit(i).cast("bigint").alias("ring_idx"), F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y")) for i, x, y in _RING])
    return rooms.select("scene", "room", "level", F.inline(corners))


@query("W06", f"SELECT scene, room, ring_idx AS edge, x AS x0, y AS y0, x1, y1 FROM {EDGES} WHERE abs(x - x1) > 1e-8 OR abs(y - y1) > 1e-8")
def ring_edges(t: Tables) -> DataFrame:
    return sn.ring_edges(rings(t), ROOM)


@query("A32", f"""
WITH e AS (SELECT scene, room, abs(sum(x * y1 - x1 * y)) / 2 AS area, sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) AS length, count(*) + 1 AS n_verts, (max(x) - min(x)) / (max(y) - min(y)) AS r FROM {EDGES} GROUP BY scene, room)
SELECT scene, room, round(area, 6) AS area, round(length, 6) AS length, CAST(n_verts AS BIGINT) AS n_verts, round(greatest(r, 1 / r), 6) AS aspect FROM e""")
def ring_metrics(t: Tables) -> DataFrame:
    out = sn.room_metrics(rings(t), ROOM)
    return out.select("scene", "room", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"), "n_verts", F.round("aspect", 6).alias("aspect"))


@query("A32", f"SELECT scene, CAST(count(DISTINCT CAST(trunc(x / 1.5) AS BIGINT)) AS BIGINT) AS n_lines FROM {RING} GROUP BY scene")
def grid_lines(t: Tables) -> DataFrame:
    return sn.grid_lines(rings(t), ["scene"], "x", 1.5)


_SHARED = "(SELECT CAST(floor(s_suppkey / 20.0) AS BIGINT) AS scene, s_suppkey AS a, CAST(floor(s_suppkey / 20.0) AS BIGINT) * 20 + (s_suppkey * 7 + 3) % 20 AS b, CAST(1 + s_suppkey % 5 AS DOUBLE) AS length, CAST(2 + s_suppkey % 2 AS BIGINT) AS n_verts FROM supplier)"


def shared(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("CAST(floor(s_suppkey / 20.0) AS BIGINT) AS scene", "s_suppkey AS a", "CAST(floor(s_suppkey / 20.0) AS BIGINT) * 20 + (s_suppkey * 7 + 3) % 20 AS b",
                                 "CAST(1 + s_suppkey % 5 AS DOUBLE) AS length", "CAST(2 + s_suppkey % 2 AS BIGINT) AS n_verts")


@query("A33", f"""
WITH u AS (SELECT scene, a, b, length, n_verts FROM {_SHARED} UNION SELECT scene, b, a, length, n_verts FROM {_SHARED})
SELECT scene, sum(length) AS length, CAST(sum(n_verts) AS BIGINT) AS n_verts FROM u WHERE a IN (SELECT room FROM {ROOMS} WHERE level = 0) AND b IN (SELECT room FROM {ROOMS} WHERE level > 0) GROUP BY scene""")
def shared_boundary(t: Tables) -> DataFrame:
    rooms = rings(t).select("scene", "room", "level").distinct()
    return sn.shared_boundary(shared(t), rooms.where("level = 0"), rooms.where("level > 0"))


@query("A34", f"SELECT r.scene, r.room FROM {ROOMS} r WHERE EXISTS (SELECT 1 FROM {ROOMS} c WHERE c.scene = r.scene AND c.level = r.level AND c.w > 11)")
def same_level(t: Tables) -> DataFrame:
    """Rooms on a level that has a wide room."""
    corners = rings(t)
    wide = corners.groupBy("scene", "room", "level").agg(F.max("x").alias("w")).where("w > 11")
    return sn.same_level(corners.select("scene", "room", "level").distinct(), wide).select("scene", "room")


@query("A35", f"""
WITH r AS (SELECT scene, room, level, room % 20 < 3 AS ext, CASE WHEN room % 20 < 3 THEN 40.0 ELSE w END AS area, -w AS lx, -d AS ly, w AS hx, d AS hy FROM {ROOMS}),
s AS (SELECT e.scene, sum(CASE WHEN r.ext THEN 2 ELSE 1 END) AS n FROM {_SHARED} e JOIN r ON r.scene = e.scene AND r.room = e.a WHERE e.length < 2.5 GROUP BY e.scene),
l AS (SELECT scene, count(*) FILTER (abs(i - o) > 0.01) AS n FROM (SELECT scene, level, sum(CASE WHEN ext THEN 0 ELSE area END) AS i, sum(CASE WHEN ext THEN area ELSE 0 END) AS o FROM r GROUP BY scene, level) GROUP BY scene),
c AS (SELECT u.scene, count(*) FILTER (NOT (b.lx <= u.lx AND b.ly <= u.ly AND u.hx <= b.hx AND u.hy <= b.hy)) AS n FROM r u JOIN r b ON b.scene = u.scene AND b.level = u.level - 1 AND b.ext WHERE u.ext GROUP BY u.scene)
SELECT scene, CAST(sum(n) AS BIGINT) AS count FROM (SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT * FROM c) GROUP BY scene""")
def graph_coherence(t: Tables) -> DataFrame:
    rooms = t.supplier.selectExpr(*[c.strip() for c in _ROOM_COLS.split(", ")]).withColumn("exterior", F.col("room") % 20 < 3)
    rooms = rooms.select("scene", "room", "level", "exterior", F.when(F.col("exterior"), 40.0).otherwise(F.col("w")).alias("area"),
                         (-F.col("w")).alias("lo_x"), (-F.col("d")).alias("lo_y"), F.col("w").alias("hi_x"), F.col("d").alias("hi_y"))
    return sn.graph_coherence(rooms, shared(t), 2.5)


@query("A36", f"""
WITH k AS (SELECT scene, room, CAST(room * 3 % 17 AS DOUBLE) AS cx, CAST(room * 5 % 13 AS DOUBLE) AS cy FROM {ROOMS}), q AS (SELECT scene, min(room) AS root FROM k GROUP BY scene),
a AS (SELECT k.scene, k.room, q.root, r.cx - k.cx AS vx, r.cy - k.cy AS vy, n.cx - k.cx AS ux, n.cy - k.cy AS uy FROM k JOIN q USING (scene) JOIN k r ON r.scene = k.scene AND r.room = q.root
   LEFT JOIN {_SHARED} e ON e.scene = k.scene AND e.a = k.room LEFT JOIN k n ON n.scene = k.scene AND n.room = e.b),
d AS (SELECT *, coalesce((ux * vx + uy * vy) / nullif(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy), 0), 0) AS c FROM a)
SELECT scene, room, round(CASE WHEN max(root) = room THEN 0 ELSE least(pi(), min(CASE WHEN ux IS NULL THEN pi() ELSE acos((1 - 1e-6) * least(greatest(c, -1), 1)) END)) END, 5) AS angle FROM d GROUP BY scene, room""")
def access_angle(t: Tables) -> DataFrame:
    rooms = rings(t).select("scene", "room").distinct()
    centres = rooms.select("scene", "room", (F.col("room") * 3 % 17).cast("double").alias("cx"), (F.col("room") * 5 % 13).cast("double").alias("cy"))
    roots = rooms.groupBy("scene").agg(F.min("room").alias("root"))
    return sn.access_angles(centres, shared(t).select("scene", "a", "b"), roots).withColumn("angle", F.round("angle", 5))


@query("A41 O03 X17", f"""
WITH e AS (SELECT o.scene, o.obj, o.yaw, o.x, o.y, e.room, e.ring_idx, e.x AS x0, e.y AS y0, e.x1 - e.x AS dx, e.y1 - e.y AS dy FROM {_ACT} o LEFT JOIN (SELECT * FROM {EDGES} WHERE abs(x - x1) > 1e-8 OR abs(y - y1) > 1e-8) e ON e.scene = o.scene),
s AS (SELECT *, least(greatest(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0), 1) AS s FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY scene, obj ORDER BY round(sqrt((x - x0 - s * dx) * (x - x0 - s * dx) + (y - y0 - s * dy) * (y - y0 - s * dy)), 9), room, ring_idx) AS rn FROM s)
SELECT scene, round(coalesce(sum(0.5 - abs((cos(yaw) * dy - sin(yaw) * dx) / sqrt(dx * dx + dy * dy)) / 2), 0), 6) AS score FROM k WHERE rn = 1 GROUP BY scene""")
def angle_alignment(t: Tables) -> DataFrame:
    """Objects against the walls of all rooms of their scene; 0 for a scene without walls."""
    return sn.angle_alignment(sn.tagged(objects(t)), sn.ring_edges(rings(t), ROOM)).withColumn("score", F.round("score", 6))


@query("A41", f"""
WITH c AS (SELECT scene, avg(x) AS tx, avg(y) AS ty FROM {OBJS} GROUP BY scene)
SELECT o.scene, round(sum(0.5 - coalesce((cos(yaw) * (tx - x) + sin(yaw) * (ty - y)) / nullif(sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)), 0), 0) / 2), 6) AS score FROM {_ACT} o JOIN c USING (scene) GROUP BY o.scene""")
def focus_score(t: Tables) -> DataFrame:
    o = objects(t)
    targets = o.groupBy("scene").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))
    return sn.focus(sn.tagged(o), targets).withColumn("score", F.round("score", 6))


@query("A42 O03", f"""
WITH d AS (SELECT a.scene, a.obj, a.yaw, b.x - a.x AS dx, b.y - a.y AS dy, b.w, b.d, b.h, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist,
  row_number() OVER (PARTITION BY a.scene, a.obj ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.obj) AS rn FROM {_ACT} a JOIN {_ACT} b ON a.scene = b.scene AND a.obj <> b.obj)
SELECT scene, round(sum(CASE WHEN cos(yaw) * dx + sin(yaw) * dy < 0 THEN 0 ELSE coalesce((cos(yaw) * dx + sin(yaw) * dy) / nullif(dist * dist, 0), 0) * sqrt(w * w + d * d + h * h) END), 5) AS score FROM d WHERE rn = 1 GROUP BY scene""")
def accessibility(t: Tables) -> DataFrame:
    return sn.accessibility(sn.tagged(objects(t))).withColumn("score", F.round("score", 5))


@query("A42b", f"""
SELECT a.scene, max({_DEPTH}) AS depth FROM (SELECT scene, obj, x1 AS x0, x1 + 2 AS x1, y0, y1, z0, z1 FROM {BOX} WHERE active) a JOIN {BOX} b ON {_TOUCH} GROUP BY a.scene""")
def front_penetration(t: Tables) -> DataFrame:
    b = boxed(t)
    return sn.front_penetration(b.where("active"), b, "x", 1, 2.0)


@query("A45", f"""
WITH r AS (SELECT DISTINCT scene, child, target FROM {RELS})
SELECT r.scene, round(sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z-b.h/2)*(a.z-b.z-b.h/2))), 4) AS score FROM r JOIN {OBJS} a ON a.scene = r.scene AND a.obj = r.child JOIN {OBJS} b ON b.scene = r.scene AND b.obj = r.target GROUP BY r.scene""")
def centre_distance(t: Tables) -> DataFrame:
    o = objects(t)
    planes = o.select("scene", "obj", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("z") + F.col("h") / 2).alias("pz"))
    return sn.centre_distance(relations(t).select("scene", "child", "target").distinct(), o, planes).withColumn("score", F.round("score", 4))


@query("A48", f"""
WITH h AS (SELECT scene, sum(w * d) * 4 AS have FROM {OBJS} GROUP BY scene), u AS (SELECT scene, sum(w * d) AS used FROM {_ACT} GROUP BY scene)
SELECT h.scene, round((have - coalesce(used, 0)) / have * 100, 6) AS free FROM h LEFT JOIN u USING (scene)""")
def free_floor(t: Tables) -> DataFrame:
    o = objects(t)
    return sn.free_floor(o.withColumn("w", F.col("w") * 4), sn.tagged(o)).withColumn("free", F.round("free", 6))


@query("A46")
def colour_palette(t: Tables) -> DataFrame:
    """Mixture of colours over shades of all fragments; an iterative fit without a SQL form."""
    f = ad.fragments(t)
    hsv = f.select((F.col("depth") / 50).alias("h"), F.col("shade").alias("s"), (F.col("object_id") / 7).alias("v"))
    return sn.palette(hsv, 3).select("component", F.round("weight", 3).alias("weight"))


_SHADES = [("depth / 50", "h"), ("shade", "s"), ("object_id / 7", "v")]


@query("A46", f"""
WITH p AS (SELECT depth / CAST(50 AS DOUBLE) AS a0, CAST(shade AS DOUBLE) AS a1, object_id / CAST(7 AS DOUBLE) AS a2 FROM {ad.fragments.sql})
SELECT CAST(1 AS DOUBLE) AS weight, {", ".join(f"round(avg(a{i}), 6) AS m{i}" for i in range(3))}, {", ".join(f"round(covar_pop(a{i}, a{j}), 6) + 0.0 AS c{i}{j}" for i in range(3) for j in range(i, 3))} FROM p""")
def colour_moments(t: Tables) -> DataFrame:
    """Moments of the fitted colour mixture, rebuilt from weights, means and Cholesky factors; they are those of the pixels."""
    hsv = ad.fragments(t).select(*[F.expr(e).alias(n) for e, n in _SHADES])
    out = sn.mixture_moments(sn.palette(hsv, 3))
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) for c in out.columns])


# -- scalar expressions -------------------------------------------------------------------

@query("X30 X18 X17 X16 X08", f"""
SELECT obj, CASE WHEN d <> 1 THEN w / (d - 1) WHEN w = 0 THEN 0.0 ELSE 1.0 END AS safe, round_even(x / 5, 0) * 5 AS step, x * 7 - 10 * floor(x * 7 / 10) AS wrapped,
  round(3 + (y - 0) / (43 - 0) * (7 - 3), 6) AS scaled, round(w * (1 - 0.25) + h * 0.25, 6) AS mixed, round(power(w, h), 4) AS pw, round(ln(w), 6) AS lg, least(greatest(x, 5), 30) AS cl,
  round(least(greatest(x / 47, 0), 1) * least(greatest(x / 47, 0), 1) * (3 - 2 * least(greatest(x / 47, 0), 1)), 6) AS smooth,
  round((list_value(w, d, h))[CAST(floor(x / 47 * 2) AS INT) + 1] * (1 - (x / 47 * 2 - floor(x / 47 * 2))) + (list_value(w, d, h))[least(CAST(floor(x / 47 * 2) AS INT) + 2, 3)] * (x / 47 * 2 - floor(x / 47 * 2)), 6) AS tab
FROM {OBJS}""")
def scalar_expressions(t: Tables) -> DataFrame:
    c = {n: F.col(n) for n in "xywdh"}
    return objects(t).select(
        "obj", sc.safe_div(c["w"], c["d"] - 1).alias("safe"), sc.nearest_step(c["x"], 5.0).alias("step"), sc.wrap(c["x"] * 7, 10.0).alias("wrapped"),
        F.round(sc.rescale(c["y"], 0, 43, 3, 7), 6).alias("scaled"), F.round(sc.lerp(c["w"], c["h"], F.lit(0.25)), 6).alias("mixed"), F.round(F.pow(c["w"], c["h"]), 4).alias("pw"),
        F.round(F.ln(c["w"]), 6).alias("lg"), sc.clamp(c["x"], 5.0, 30.0).alias("cl"), F.round(sc.smoothstep(c["x"] / 47), 6).alias("smooth"),
        F.round(sc.table_lerp(F.col("dims"), c["x"] / 47 * 2), 6).alias("tab"))


@query("X24", f"""
SELECT obj, round(abs((x - 1) * 0.6 + (y - 2) * 0.8), 6) AS dist, round(x - 2 * ((x - 1) * 0.6 + (y - 2) * 0.8) * 0.6, 6) AS rx, round(y - 2 * ((x - 1) * 0.6 + (y - 2) * 0.8) * 0.8, 6) AS ry,
  round(2 * acos(least(abs(cos(yaw / 2)), 1.0)), 6) AS turn FROM {OBJS}""")
def plane_math(t: Tables) -> DataFrame:
    p, at, n = [F.col(a) for a in "xyz"], la.lits((1, 2, 0)), la.lits((0.6, 0.8, 0))
    r = sn.reflect(p, at, n)
    ident = la.lits((1, 0, 0, 0))
    q = [F.cos(F.col("yaw") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2)]
    return objects(t).select("obj", F.round(sn.plane_distance(p, at, n), 6).alias("dist"), F.round(r[0], 6).alias("rx"), F.round(r[1], 6).alias("ry"),
                             F.round(sn.quaternion_angle(q, ident), 6).alias("turn"))


_HSV = "CASE WHEN mx = mn THEN 0.0 ELSE (h6 / 6.0) - floor(h6 / 6.0) END"


@query("X16 X17 X24 X25", f"""
WITH o AS (SELECT *, x / 47 AS r, y / 43 AS g, w / 50 AS b FROM {OBJS}),
m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM o),
k AS (SELECT *, CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN (g - b) / (mx - mn) WHEN mx = g THEN (b - r) / (mx - mn) + 2.0 ELSE (r - g) / (mx - mn) + 4.0 END AS h6 FROM m)
SELECT obj, round(x / (z + 1), 6) AS ux, round(y / (z + 1), 6) AS uy, 1.0 AS one,
  round(CASE WHEN w < 0 THEN NULL WHEN w <= 0 THEN 0 WHEN w <= 7 THEN w / 7 WHEN w <= 19 THEN 1 + (w - 7) / 12 WHEN w <= 60 THEN 2 + (w - 19) / 41 END, 6) AS place,
  round(-yaw, 6) + 0.0 AS turn, round(1 * 0.6 - 2 * (0.6 * 0.6 + 0.0 * 0.8) * 0.6, 6) AS a0, round(0 - 2 * (0.6 * 0.6) * 0.8, 6) + 0.0 AS a1, 0.8 AS a2,
  round({_HSV}, 6) AS h, round(CASE WHEN mx = 0 THEN 0.0 ELSE (mx - mn) / mx END, 6) AS s, round(mx, 6) AS v FROM k""")
def scalar_inverses(t: Tables) -> DataFrame:
    """Homogeneous points, inverse interpolation, mirrored turns and HSV."""
    c = {n: F.col(n) for n in "xyzw"}
    whole = sc.homogenise([c["x"], c["y"]])
    flat = sc.dehomogenise([c["x"], c["y"], c["z"] + 1])
    place = sc.inverse_table_lerp(F.array(*[F.lit(float(v)) for v in (0, 7, 19, 60)]), c["w"])
    turn = sc.reflect_axis_angle([F.col("yaw"), F.lit(0.6), F.lit(0.0), F.lit(0.8)], [F.lit(0.6), F.lit(0.8), F.lit(0.0)])
    h, s, v = sc.rgb_to_hsv(c["x"] / 47, c["y"] / 43, c["w"] / 50)
    named = {"ux": flat[0], "uy": flat[1], "one": whole[2], "place": place, "turn": turn[0], "a0": turn[1], "a1": turn[2], "a2": turn[3], "h": h, "s": s, "v": v}
    return objects(t).select("obj", *[(F.round(e, 6) + 0.0).alias(k) for k, e in named.items()])

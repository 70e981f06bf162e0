"""Planning and mutation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.operators import catalog as cat
from jointframe.operators import kinematics as kin
from jointframe.operators import mutate as mu
from jointframe.operators import plan as pl
from jointframe.operators import splits as sp
from jointframe.queries.catalog import hash_sql, uniform_sql, values
from jointframe.queries.geometry import rounded, rsql
from jointframe.queries.kinematics import CLOSURE_SQL
from jointframe.queries.splits import SPLIT_SQL, movable_parts
from jointframe.registry import query
from jointframe.session import Tables

J, P = ad.joints.sql, ad.parts.sql
MAX_MODES = [("ECONOMY", 3), ("SMALL", 1), ("LARGE", 2)]

OBJECTS_SQL = f"(SELECT obj, min(factory) AS factory FROM {P} GROUP BY obj)"


def objects(t: Tables) -> DataFrame:
    return ad.parts(t).groupBy("obj").agg(F.min("factory").alias("factory"))


@query("J24 U03", f"""
SELECT DISTINCT brand AS factory, CAST(s AS BIGINT) AS seed, 'im' AS source FROM {P}, range(5, 9) r(s)
UNION ALL SELECT factory, obj * 8 + label, 'net' FROM {P} UNION ALL SELECT o_orderpriority, o_orderkey, 'mob' FROM orders""")
def work_plan(t: Tables) -> DataFrame:
    parts = ad.parts(t)
    made = pl.generated_jobs(parts.select(F.col("brand").alias("factory")).distinct(), 4, 5, "im")
    net = pl.catalogue_jobs(parts.select("factory", (F.col("obj") * 8 + F.col("label")).alias("object_id")), "net")
    mob = pl.catalogue_jobs(t.orders.select(F.col("o_orderpriority").alias("factory"), F.col("o_orderkey").alias("object_id")), "mob")
    return made.unionByName(net).unionByName(mob)


@query("A13", f"""
WITH j AS (SELECT factory, 'net' AS source FROM {P} UNION ALL SELECT o_orderpriority, 'mob' FROM orders)
SELECT coalesce(source, 'all') AS source, coalesce(factory, 'all') AS factory, CAST(count(*) AS BIGINT) AS n_jobs FROM j
GROUP BY ROLLUP (source, factory)""")
def plan_counts(t: Tables) -> DataFrame:
    jobs = ad.parts(t).select("factory", F.lit("net").alias("source")).unionByName(
        t.orders.select(F.col("o_orderpriority").alias("factory"), F.lit("mob").alias("source")))
    return jobs.rollup("source", "factory").agg(F.count("*").alias("n_jobs")).select(
        F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("factory", F.lit("all")).alias("factory"), "n_jobs")


@query("W07", """
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1) / ceil(count(*) OVER () / 7.0)) AS BIGINT) AS shard
FROM orders""")
def shard_assign(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", "o_orderkey")
    return pl.shard(rows, ["o_orderpriority", "o_orderkey"], 7).select("o_orderkey", "shard")


@query("P33", f"""
WITH o AS (SELECT o.obj, o.factory, coalesce(m.n, 0) AS n FROM {OBJECTS_SQL} o LEFT JOIN (VALUES {values(MAX_MODES)}) m(f, n) ON m.f = o.factory),
t AS (SELECT obj, bool_or(type = 'revolute') AS r, bool_or(type = 'prismatic') AS p, bool_or(type = 'continuous') AS c
  FROM {J} WHERE type <> 'fixed' GROUP BY obj),
m AS (SELECT o.obj, o.factory, mode, CASE mode WHEN 0 THEN r WHEN 1 THEN p WHEN 2 THEN c ELSE true END AS ok
  FROM o JOIN t USING (obj), range(4) q(mode) WHERE mode <= o.n),
w AS (SELECT *, bool_or(ok) OVER (PARTITION BY obj) AS any_ok FROM m)
SELECT obj, factory, CAST(mode AS BIGINT) AS mode FROM w WHERE ok OR NOT any_ok""")
def valid_modes(t: Tables) -> DataFrame:
    most = cat.literal_table(t.spark, MAX_MODES, "factory string, max_mode int")
    return pl.valid_modes(objects(t), ad.joints(t), most, ["obj"])


@query("J25", f"""{CLOSURE_SQL}, {SPLIT_SQL},
k AS (SELECT obj, key, CASE WHEN key = 'default' THEN 3 ELSE CAST(substr(key, 5) AS BIGINT) END AS mode FROM kept)
SELECT obj, key, mode, view, view = 'orbit_00' AS moving FROM k, (VALUES ('hemi_00'), ('hemi_08'), ('orbit_00')) v(view)
WHERE NOT (mode >= 10 AND view = 'hemi_08')""")
def split_render_plan(t: Tables) -> DataFrame:
    moving, _ = sp.build_splits(*movable_parts(t))
    return pl.render_plan(moving.select("obj", "key").distinct(), ["obj"])


# Output files of rendering jobs, one per lineitem: the object is the order.
FILE_EXPR = ("concat('hemi_0', CAST(l_linenumber AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '_anim1' ELSE '_anim12' END, "
             "CASE WHEN l_quantity < 5 THEN '.mp4' ELSE '_nobg.mp4' END)")
_DONE = f"""
f AS (SELECT l_orderkey AS obj, {FILE_EXPR} AS name FROM lineitem),
n AS (SELECT obj, CASE WHEN contains(name, '_anim') THEN CAST(regexp_extract(name, '_anim([0-9]+)_', 1) AS BIGINT) ELSE 0 END AS mode
  FROM f WHERE name LIKE '%\\_nobg.mp4' ESCAPE '\\'),
c AS (SELECT obj, mode, count(*) AS n_videos FROM n GROUP BY obj, mode),
j AS (SELECT o_orderkey AS obj, CAST(unnest([0, 1, 12]) AS BIGINT) AS mode FROM orders)"""


def _files(t: Tables) -> tuple[DataFrame, DataFrame]:
    files = t.lineitem.selectExpr("l_orderkey AS obj", f"{FILE_EXPR} AS name")
    jobs = t.orders.select(F.col("o_orderkey").alias("obj"),
                           F.explode(F.array(*[F.lit(m).cast("bigint") for m in (0, 1, 12)])).alias("mode"))
    return jobs, files


@query("A12", f"WITH {_DONE} SELECT j.obj, j.mode, CAST(coalesce(n_videos, 0) AS BIGINT) AS n_videos, coalesce(n_videos, 0) >= 2 AS complete FROM j LEFT JOIN c USING (obj, mode)")
def output_completeness(t: Tables) -> DataFrame:
    return pl.completeness(*_files(t), ["obj"], expected=2)


_VIEW_FILE = """concat(CASE l_linenumber % 4 WHEN 0 THEN 'front' WHEN 1 THEN 'side' WHEN 2 THEN 'back' ELSE 'threequarter' END,
  CASE WHEN l_suppkey % 3 = 0 THEN '_bg' WHEN l_suppkey % 3 = 1 THEN '_nobg' ELSE '_raw' END, '.mp4')"""


@query("A12", f"""
WITH f AS (SELECT DISTINCT l_partkey AS obj, {_VIEW_FILE} AS name FROM lineitem),
n AS (SELECT obj, count(*) AS n FROM f WHERE name NOT LIKE '%!_raw.mp4' ESCAPE '!' GROUP BY obj)
SELECT p_partkey AS obj, CAST(coalesce(n, 0) AS BIGINT) AS n_files, coalesce(n, 0) = 8 AS complete FROM part LEFT JOIN n ON obj = p_partkey""")
def named_view_completeness(t: Tables) -> DataFrame:
    """Folders that hold all four named views with and without background."""
    return pl.named_views_complete(t.part.select(F.col("p_partkey").alias("obj")), t.lineitem.selectExpr("l_partkey AS obj", f"{_VIEW_FILE} AS name"), ["obj"])


@query("P35", f"WITH {_DONE} SELECT j.obj, j.mode FROM j WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.obj = j.obj AND c.mode = j.mode AND n_videos >= 2)")
def plan_minus_done(t: Tables) -> DataFrame:
    return pl.pending(*_files(t), ["obj"], expected=2)


SELECTORS = [("ECONOMY", 0, "revolute", "all", ""), ("ECONOMY", 1, "prismatic", "ordinal", "0"), ("ECONOMY", 2, "continuous", "ordinal", "-1"),
             ("LARGE", 0, "revolute", "axis", "y"), ("LARGE", 1, "prismatic", "sign", "+"), ("LARGE", 2, "revolute", "sign", "-"),
             ("LARGE", 2, "prismatic", "axis", "z")]
_SEL = f"""
d AS (SELECT obj, joint, type, lower, upper, ax0, ax1, ax2, CAST(floor(log2(label + 1)) AS BIGINT) + 1 AS depth, factory
      FROM {J} JOIN {OBJECTS_SQL} o USING (obj) WHERE type <> 'fixed'),
g AS (SELECT *, row_number() OVER (PARTITION BY obj, type ORDER BY depth, joint) - 1 AS up, count(*) OVER (PARTITION BY obj, type) AS n,
   CASE WHEN abs(upper) >= abs(lower) THEN upper ELSE lower END AS tgt
   FROM d WHERE abs(upper - lower) >= CASE WHEN type = 'prismatic' THEN 0.005 ELSE 0.05 END),
s AS (SELECT * FROM (VALUES {values(SELECTORS)}) v(factory, mode, type, kind, arg)),
h AS (SELECT DISTINCT g.obj, s.mode, g.joint FROM g JOIN s ON s.factory = g.factory AND s.type = g.type WHERE CASE kind WHEN 'all' THEN true
   WHEN 'ordinal' THEN up = CASE WHEN CAST(arg AS INT) >= 0 THEN CAST(arg AS INT) ELSE n + CAST(arg AS INT) END
   WHEN 'axis' THEN abs(CASE arg WHEN 'x' THEN ax0 WHEN 'y' THEN ax1 ELSE ax2 END) > 0.5
   ELSE CASE arg WHEN '+' THEN tgt > 0 ELSE tgt < 0 END END)""".replace("CAST(arg AS INT)", "TRY_CAST(arg AS INT)")


@query("P34", f"""WITH {_SEL}
SELECT obj, CAST(mode AS BIGINT) AS mode, joint FROM h
UNION ALL SELECT d.obj, CAST(m.mode AS BIGINT), d.joint FROM d JOIN (SELECT DISTINCT factory, mode FROM s) m USING (factory)
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.obj = d.obj AND h.mode = m.mode)""")
def joint_selectors(t: Tables) -> DataFrame:
    joints = ad.joints(t)
    depth = kin.link_depth(joints.select("obj", "parent", "child"), ["obj"]).withColumnRenamed("node", "child")
    pool = joints.where("type <> 'fixed'").join(depth, ["obj", "child"]).join(objects(t), "obj")
    selectors = cat.literal_table(t.spark, SELECTORS, "factory string, mode bigint, type string, kind string, arg string")
    return pl.select_joints(pool, selectors, ["obj"])


_S45 = repr(math.sqrt(0.5))

@query("X10 X11 X13 X14 X15", f"""
WITH m AS (SELECT j.*, mutation FROM {J} j, (VALUES {values([(m,) for m in fixed.MUTATIONS])}) v(mutation)
  WHERE type <> 'fixed'),
c AS (SELECT *, CASE WHEN mutation = 'wrong_joint_type' THEN CASE WHEN type = 'prismatic' THEN 10.0 ELSE CAST(0.1 AS DOUBLE) END
  WHEN mutation = 'over_motion' THEN 2.5 ELSE 1.0 END AS k,
  CASE WHEN type = 'continuous' AND abs(upper - lower) <= 1e-6 THEN 1.0 WHEN abs(upper) >= abs(lower) THEN upper ELSE lower END AS tgt FROM m)
SELECT obj, joint, mutation, type AS old_type,
  CASE WHEN mutation = 'wrong_joint_type' THEN CASE WHEN type = 'prismatic' THEN 'revolute' ELSE 'prismatic' END
       WHEN mutation = 'part_detach' THEN 'prismatic' ELSE type END AS type,
  round(CASE WHEN mutation = 'part_detach' THEN 0 ELSE lower * k END, 6) + 0.0 AS lower,
  round(CASE WHEN mutation = 'part_detach' THEN 0.5 ELSE upper * k END, 6) + 0.0 AS upper,
  CASE WHEN mutation = 'wrong_direction' THEN NULL WHEN mutation = 'wrong_axis' THEN CASE WHEN ax2 <> 0 THEN 1.0 ELSE 0.0 END ELSE ax0 END + 0.0 AS ax0,
  CASE WHEN mutation = 'wrong_direction' THEN NULL WHEN mutation = 'wrong_axis' THEN CASE WHEN ax0 <> 0 THEN 1.0 ELSE 0.0 END ELSE ax1 END + 0.0 AS ax1,
  CASE WHEN mutation = 'wrong_direction' THEN NULL WHEN mutation = 'wrong_axis' THEN CASE WHEN ax1 <> 0 THEN -1.0 ELSE 0.0 END ELSE ax2 END + 0.0 AS ax2,
  mutation = 'wrong_parts_moving' AS invert_movers,
  round(CASE WHEN mutation = 'jitter' THEN abs(tgt) * 0.3 ELSE 0 END, 6) + 0.0 AS jitter_std
FROM c""")
def mutation_expand(t: Tables) -> DataFrame:
    """All mutation kinds; the tilted axis itself is compared by ``tilted_axes``."""
    out = mu.mutations(ad.joints(t), ["obj"])
    out = out.withColumns({f"ax{i}": F.when(F.col("mutation") != "wrong_direction", F.col(f"ax{i}")) for i in range(3)})
    return out.select("obj", "joint", "mutation", "old_type", "type", *rounded(["lower", "upper", "ax0", "ax1", "ax2"], 6),
                      "invert_movers", *rounded(["jitter_std"], 6))


@query("X12", f"""
WITH a AS (SELECT obj, joint, (ax0 + o0 / 10) / n AS a0, (ax1 + o1 / 10) / n AS a1, (ax2 + o2 / 10) / n AS a2 FROM
  (SELECT *, sqrt((ax0+o0/10)*(ax0+o0/10) + (ax1+o1/10)*(ax1+o1/10) + (ax2+o2/10)*(ax2+o2/10)) AS n FROM {J} WHERE type <> 'fixed')),
s AS (SELECT *, CASE WHEN abs(a0) <= abs(a1) AND abs(a0) <= abs(a2) THEN 0 WHEN abs(a1) <= abs(a2) THEN 1 ELSE 2 END AS k FROM a),
p AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN -a2 ELSE a1 END AS p0, CASE k WHEN 0 THEN a2 WHEN 1 THEN 0 ELSE -a0 END AS p1,
   CASE k WHEN 0 THEN -a1 WHEN 1 THEN a0 ELSE 0 END AS p2 FROM s),
u AS (SELECT *, sqrt(p0*p0 + p1*p1 + p2*p2) AS pn FROM p)
SELECT obj, joint, {rsql([f"({x} + ({y}) / pn) * {_S45}" for x, y in (("a0", "p1*a2 - p2*a1"), ("a1", "p2*a0 - p0*a2"), ("a2", "p0*a1 - p1*a0"))], ["d0", "d1", "d2"], 6)} FROM u""")
def tilted_axes(t: Tables) -> DataFrame:
    """The wrong-direction mutation on slanted axes."""
    joints = ad.joints(t).where("type <> 'fixed'")
    axis = [F.col(f"ax{i}") + F.col(f"o{i}") / 10 for i in range(3)]
    return mu.with_tilted_axis(joints, axis).select("obj", "joint", *rounded(["d0", "d1", "d2"], 6))


_U, _W = uniform_sql("obj", "joint", "frame", "'u'"), uniform_sql("obj", "joint", "frame", "'v'")


@query("X06 X07 X32", f"""
WITH f AS (SELECT *, CASE WHEN type = 'fixed' THEN 0.0 WHEN type = 'continuous' AND abs(upper - lower) <= 1e-6 THEN 1.0
   WHEN abs(upper) >= abs(lower) THEN upper ELSE lower END AS tgt FROM {J}, range(1, 4) r(frame)),
b AS (SELECT *, sin((frame - 1) / 2.0 * pi()) * tgt AS base, sqrt(-2.0 * ln(greatest({_U}, 1e-12))) * cos(2.0 * pi() * {_W}) AS z FROM f)
SELECT obj, joint, CAST(frame AS BIGINT) AS frame, round(CASE WHEN type = 'fixed' OR abs(base) < 1e-10 THEN base ELSE base + abs(tgt) * 0.3 * z END, 5) + 0.0 AS q FROM b""")
def jittered_values(t: Tables) -> DataFrame:
    rows = ad.joints(t).withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(3))))
    q = mu.jittered(F.col("type"), F.col("lower"), F.col("upper"), F.col("frame"), 3, F.col("obj"), F.col("joint"))
    return rows.select("obj", "joint", F.col("frame").cast("bigint").alias("frame"), (F.round(q, 5) + 0.0).alias("q"))


@query("W08", """
WITH d AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS done, min(ts) OVER () AS t0, (SELECT count(*) FROM events) AS total FROM events WHERE event_type = 'purchase')
SELECT event_id, CAST(done AS BIGINT) AS done, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS elapsed,
  round((epoch_us(ts) - epoch_us(t0)) / 1e6 / done * (total - done), 3) AS eta FROM d""")
def progress_eta(t: Tables) -> DataFrame:
    done = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    out = pl.progress(done, t.events.count(), "ts", "event_id")
    return out.select("event_id", "done", "elapsed", F.round("eta", 3).alias("eta"))


WEIGHTS = [("forest", 3), ("desert", 1), ("coast", 2)]


@query("W09 X35", """
SELECT o_orderkey AS i, printf('%x', 4096 + o_orderkey) AS seed, CASE WHEN o_orderkey % 6 < 3 THEN 'forest' WHEN o_orderkey % 6 < 4 THEN 'desert' ELSE 'coast' END AS config FROM orders""")
def roundrobin_config(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("i"), sc.seed_text(F.col("o_orderkey") + 4096).alias("seed"))
    return pl.round_robin(rows, "i", WEIGHTS)


@query("W14", """
WITH s AS (SELECT c_custkey AS scene, c_custkey % 5 AS a, c_custkey % 5 + c_custkey % 37 + 20 AS b FROM customer),
v AS (SELECT scene, a, b, unnest(generate_series(a, b, 16)) AS vs FROM s),
w AS (SELECT *, least(b, vs + 15) AS ve FROM v),
c AS (SELECT *, unnest(generate_series(vs, ve, 5)) AS cs FROM w)
SELECT scene, vs AS view_start, ve AS view_end, cs AS cam_start, least(ve, cs + 4) AS cam_end FROM c""")
def frame_blocks(t: Tables) -> DataFrame:
    scenes = t.customer.selectExpr("c_custkey AS scene", "c_custkey % 5 AS a", "c_custkey % 5 + c_custkey % 37 + 20 AS b")
    return pl.frame_blocks(scenes, "a", "b", 16, 5).drop("a", "b")


@query("W15", f"""
WITH v AS (SELECT s_suppkey AS view, CAST(s_suppkey % 60 AS DOUBLE) AS e0, CAST(s_suppkey % 180 AS DOUBLE) AS a0,
   CAST(s_suppkey % 45 AS DOUBLE) AS e1, CAST(-(s_suppkey % 90) AS DOUBLE) AS a1, frame FROM supplier, range(1, 6) r(frame)),
w AS (SELECT view, frame, radians(e0 + (e1 - e0) * (frame - 1) / 4.0) AS e, radians(a0 + (a1 - a0) * (frame - 1) / 4.0) AS a FROM v)
SELECT view, CAST(frame AS BIGINT) AS frame, {rsql(["2.5 * cos(e) * cos(a)", "2.5 * cos(e) * sin(a)", "2.5 * sin(e)"], ["x", "y", "z"])} FROM w""")
def camera_path(t: Tables) -> DataFrame:
    views = t.supplier.selectExpr("s_suppkey AS view", "CAST(s_suppkey % 60 AS DOUBLE) AS elev0", "CAST(s_suppkey % 180 AS DOUBLE) AS azim0",
                                  "CAST(s_suppkey % 45 AS DOUBLE) AS elev1", "CAST(-(s_suppkey % 90) AS DOUBLE) AS azim1")
    return pl.camera_path(views, 5, 2.5).select("view", "frame", *rounded(["x", "y", "z"]))


@query("O07", """
WITH s AS (SELECT o_custkey AS scene, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS done,
   count(*) FILTER (o_orderstatus = 'P') AS q, count(*) >= 15 AS finished, max(o_totalprice) > 497000 AS crashed FROM orders GROUP BY o_custkey),
r AS (SELECT *, running + done AS inflight, sum(q) OVER (ORDER BY running + done DESC, scene ROWS UNBOUNDED PRECEDING) AS queued FROM s WHERE NOT finished AND NOT crashed)
SELECT scene, CAST(inflight AS BIGINT) AS inflight, CAST(queued AS BIGINT) AS queued FROM r WHERE queued <= 1000""")
def backlog_ranking(t: Tables) -> DataFrame:
    s = t.orders.groupBy(F.col("o_custkey").alias("scene")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("running"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("queued_next"),
        (F.count("*") >= 15).alias("finished"), (F.max("o_totalprice") > 497000).alias("crashed"))
    return pl.backlog(s, 1000).select("scene", "inflight", "queued")


@query("X34", f"""
WITH d AS (SELECT c_custkey AS scene, {uniform_sql("c_custkey", "'trees'", "0")} < 0.6 AS trees, {uniform_sql("c_custkey", "'fruit'", "0")} < 0.5 AND c_custkey % 10 <> 0 AS fruit FROM customer)
SELECT scene, trees, trees AND fruit AS fruit FROM d""")
def stage_selection(t: Tables) -> DataFrame:
    """A stage runs when enabled, its draw is below its chance and its prerequisite ran."""
    scene = F.col("c_custkey")
    trees = sc.bernoulli(0.6, scene, F.lit("trees"), F.lit(0))
    fruit = sc.bernoulli(0.5, scene, F.lit("fruit"), F.lit(0)) & (scene % 10 != 0)
    return t.customer.select(scene.alias("scene"), trees.alias("trees"), (trees & fruit).alias("fruit"))


@query("X19", f"SELECT doc_id, {hash_sql('doc_id', 'text', 'lang')} AS h FROM documents")
def stable_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sc.stable_hash(F.col("doc_id"), F.col("text"), F.col("lang")).alias("h"))

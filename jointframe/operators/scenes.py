"""Declarative checks over scenes: tags, relations, distances, scores, violations.

Everything is evaluated for all scenes at once. A set of objects is a DataFrame
of (scene, obj); scalars are group-bys over such sets. Boxes are axis aligned.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.functions import linalg as la
from jointframe.functions import scalar as sc
from jointframe.operators.geometry import AXES
from jointframe.operators.nearest import box_pairs, closest
from jointframe.plans.ordered import neighbours, ranked

SCENE = ["scene"]
OBJ = ["scene", "obj"]


# -- tags ---------------------------------------------------------------------------------

def _within(small: Column, big: Column) -> Column:
    return F.size(F.array_except(small, big)) == 0


def satisfies(pos: Column, neg: Column, want: Column, refuse: Column) -> Column:
    """All wanted tags present, no refused tag present, no own refusal wanted."""
    return _within(want, pos) & ~F.arrays_overlap(neg, want) & ~F.arrays_overlap(refuse, pos)


def contradiction(pos: Column, neg: Column, generators: str = "gen:", singles: tuple[str, ...] = ("obj:", "var:")) -> Column:
    """A tag required and refused, two generators, or two objects or variables."""
    n_gen = F.size(F.filter(pos, lambda t: t.startswith(generators)))
    def single(t: Column) -> Column:
        out = t.startswith(singles[0])
        for s in singles[1:]:
            out = out | t.startswith(s)
        return out
    return F.arrays_overlap(pos, neg) | (n_gen > 1) | (F.size(F.filter(pos, single)) > 1)


def implies(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    return ~contradiction(p1, n1) & _within(p2, p1) & _within(n2, n1)


def difference(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    return F.array_union(p1, F.array_except(n2, n1)), F.array_union(n1, F.array_except(p2, p1))


def intersection(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column]:
    """Joint requirements; a contradiction is an error."""
    pos, neg = F.array_union(p1, p2), F.array_union(n1, n2)
    stop = F.raise_error(F.concat(F.lit("contradicting tags "), F.array_join(pos, ",")))
    return F.when(contradiction(pos, neg), stop.cast("array<string>")).otherwise(pos), neg


def tagged(objects: DataFrame, want: Sequence[str] = (), refuse: Sequence[str] = ()) -> DataFrame:
    """Active objects that satisfy the tags; ``objects`` has arrays pos and neg."""
    return objects.where("active").where(satisfies(F.col("pos"), F.col("neg"), _strings(want), _strings(refuse)))


def any_tag(objects: DataFrame, tags: Sequence[str]) -> DataFrame:
    return objects.where("active").where(F.arrays_overlap("pos", _strings(tags)))


def excludes(objects: DataFrame, tags: Sequence[str]) -> DataFrame:
    return objects.where("active").where(~F.arrays_overlap("pos", _strings(tags)))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# -- statements about relations -----------------------------------------------------------

ANY = "any"


@dataclass(frozen=True)
class Statement:
    """Columns of a relation that is asked for: its kind (``any`` for every relation), whether it is refused, and the tags wanted and refused of child and parent."""

    kind: Column
    negated: Column
    child: tuple[Column, Column]
    parent: tuple[Column, Column]

    @classmethod
    def of(cls, row: Column) -> Statement:
        """From a struct (kind, negated, child_pos, child_neg, parent_pos, parent_neg)."""
        return cls(row["kind"], row["negated"], (row["child_pos"], row["child_neg"]), (row["parent_pos"], row["parent_neg"]))


@dataclass(frozen=True)
class RelationLogic:
    """What follows from what among statements; ``below`` has the pairs (kind, a kind that is a special case of it)."""

    below: tuple[tuple[str, str], ...]

    def _covers(self, a: Statement, b: Statement) -> Column:
        """b's kind is a's or a special case of it."""
        pairs = [f"{x}>{y}" for x, y in self.below]
        return (a.kind == b.kind) | F.concat(a.kind, F.lit(">"), b.kind).isin(pairs)

    def _entails(self, a: Statement, b: Statement) -> Column:
        """Of statements taken without their negation."""
        tags = implies(*a.child, *b.child) & implies(*a.parent, *b.parent)
        return F.when(a.kind == ANY, b.kind == ANY).when(b.kind == ANY, True).otherwise(self._covers(a, b) & tags)

    def _excludes(self, a: Statement, b: Statement) -> Column:
        """a without its negation entails that b without its does not hold: a has b's tags the other way round."""
        tags = implies(*a.child, *b.child[::-1]) & implies(*a.parent, *b.parent[::-1])
        return F.when((a.kind == ANY) | (b.kind == ANY), False).otherwise(self._covers(a, b) & tags)

    def _beside(self, a: Statement, refused: Statement) -> Column:
        """a can hold where ``refused`` does not."""
        return F.when(a.kind == ANY, True).when(refused.kind == ANY, False).otherwise(~self._entails(refused, a))

    def implies(self, a: Statement, b: Statement) -> Column:
        """Whoever meets a meets b."""
        refusal = F.when(b.kind == ANY, False).otherwise(~self._entails(a, b) & ~self._beside(b, a))
        return (F.when(a.negated & b.negated, self._entails(a, b)).when(a.negated, refusal)
                .when(b.negated, self._excludes(a, b)).otherwise(self._entails(a, b)))

    def intersects(self, a: Statement, b: Statement) -> Column:
        """Something can meet both; of two refusals this is taken for granted unless one refuses everything."""
        clash = [contradiction(F.array_union(x[0], y[0]), F.array_union(x[1], y[1])) for x, y in ((a.child, b.child), (a.parent, b.parent))]
        plain = F.when((a.kind == ANY) | (b.kind == ANY), True).otherwise(self._covers(a, b) & ~clash[0] & ~clash[1])
        return (F.when(a.negated & b.negated, (a.kind != ANY) & (b.kind != ANY)).when(a.negated, self._beside(b, a))
                .when(b.negated, self._beside(a, b)).otherwise(plain))


def compared_statements(left: DataFrame, asked: Sequence[tuple], logic: RelationLogic) -> DataFrame:
    """The rows of ``left`` (with a struct ``statement``) for each statement asked: (…, question, implied, met).

    ``asked`` is configuration: (question, kind, negated, child_pos, child_neg, parent_pos, parent_neg).
    """
    names = ("kind", "negated", "child_pos", "child_neg", "parent_pos", "parent_neg")
    rows = [F.struct(F.lit(q[0]).alias("question"), *[(_strings(v) if isinstance(v, (list, tuple)) else F.lit(v)).alias(n) for n, v in zip(names, q[1:], strict=True)]) for q in asked]
    both = left.withColumn("_q", F.explode(F.array(*rows)))
    a, b = Statement.of(F.col("statement")), Statement.of(F.col("_q"))
    return both.select(*left.columns, F.col("_q.question").alias("question"), logic.implies(a, b).alias("implied"), logic.intersects(a, b).alias("met"))


# -- relations ----------------------------------------------------------------------------

def related(children: DataFrame, relations: DataFrame, parents: DataFrame, relation: str, implied: DataFrame) -> DataFrame:
    """Children with a relation that implies ``relation`` to one of the parents.

    ``relations`` is (scene, child, relation, target), ``implied`` a configuration
    table (relation, implied) that holds the identity pairs as well.
    """
    kinds = implied.where(F.col("implied") == relation).select("relation")
    hits = relations.join(kinds, "relation", "left_semi").join(
        parents.select("scene", F.col("obj").alias("target")), ["scene", "target"], "left_semi")
    return children.join(hits.select("scene", F.col("child").alias("obj")).distinct(), OBJ, "left_semi")


@dataclass(frozen=True)
class Domain:
    """Tags plus clauses (relation, sub-domain, required); not required means no such related object."""

    want: tuple[str, ...] = ()
    refuse: tuple[str, ...] = ()
    clauses: tuple[tuple[str, "Domain", bool], ...] = field(default=())


def members(objects: DataFrame, relations: DataFrame, domain: Domain, implied: DataFrame) -> DataFrame:
    """Objects in a domain: one semi or anti join per clause, inner clauses first."""
    out = tagged(objects, domain.want, domain.refuse)
    for relation, sub, required in domain.clauses:
        inner = members(objects, relations, sub, implied)
        hit = related(objects, relations, inner, relation, implied).select(*OBJ)
        out = out.join(hit, OBJ, "left_semi" if required else "left_anti")
    return out


def related_counts(parents: DataFrame, relations: DataFrame, children: DataFrame, relation: str, implied: DataFrame) -> DataFrame:
    """(scene, obj, n): per parent the number of related children, 0 included."""
    kinds = implied.where(F.col("implied") == relation).select("relation")
    kept = relations.join(kinds, "relation", "left_semi").select("scene", F.col("child").alias("obj"), "target").distinct()
    kept = kept.join(children.select(*OBJ), OBJ, "left_semi")
    n = kept.groupBy("scene", F.col("target").alias("obj")).agg(F.count("*").alias("n"))
    return parents.select(*OBJ).join(n, OBJ, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


# -- counts and violations ----------------------------------------------------------------

def set_scalars(sets: DataFrame, scenes: DataFrame, value: Column) -> DataFrame:
    """(scene, n, total, mean, all_positive) over a set; an empty set counts 0, sums 0, has mean 0 and holds."""
    agg = sets.groupBy("scene").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.bool_and(value > 0).alias("all_positive"))
    return scenes.select("scene").join(agg, "scene", "left").select(
        "scene", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("all_positive", F.lit(True)).alias("all_positive"))


def shortfall(lhs: Column, op: str, rhs: Column) -> Column:
    """Violation of an integer comparison: how far the left side is off; strict ones add 1; equality is the distance."""
    err = {"ge": rhs - lhs, "le": lhs - rhs, "gt": rhs - lhs + 1, "lt": lhs - rhs + 1, "eq": F.abs(lhs - rhs)}[op]
    return F.greatest(err, F.lit(0))


def broken(condition: Column) -> Column:
    """Violation of a float comparison or a boolean: 0 or 1."""
    return F.when(condition, 0).otherwise(1)


def outside(x: Column, low, high) -> Column:
    return sc.hinge(x, low, high)


def either(a: Column, b: Column) -> Column:
    return F.least(a, b)


def report(terms: Mapping[str, DataFrame], scenes: DataFrame) -> DataFrame:
    """(scene, term, loss, viol): one row per scene and named term, missing ones 0. Terms are (scene, loss, viol)."""
    out = None
    for name, df in terms.items():
        rows = scenes.select("scene").join(df, "scene", "left").select(
            "scene", F.lit(name).alias("term"), F.coalesce("loss", F.lit(0.0)).alias("loss"), F.coalesce(F.col("viol").cast("double"), F.lit(0.0)).alias("viol"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scene").agg(F.sum("loss").alias("loss"), F.sum("viol").alias("viol"), F.count_if(F.col("viol") > 0).alias("n_violated"))


def volumes(sets: DataFrame, k: int) -> DataFrame:
    """(scene, volume): product of the k largest dims plus 1e-10 per object, summed."""
    largest = F.slice(F.sort_array("dims", asc=False), 1, k)
    prod = F.aggregate(largest, F.lit(1.0), lambda a, x: a * x)
    return sets.groupBy("scene").agg(F.sum(prod + 1e-10).alias("volume"))


def surprise(count: Column, weights: Sequence[float]) -> Column:
    """−ln of a categorical weight; impossible counts cost −ln 1e-100."""
    arr = F.array(*[F.lit(float(w)) for w in weights])
    return F.coalesce(-F.ln(F.get(arr, count.cast("int")) + 1e-20), F.lit(-math.log(1e-100)))


def bernoulli_surprise(count: Column, p: float) -> Column:
    return F.when(count == 1, -math.log(p)).when(count == 0, -math.log(1 - p)).otherwise(-math.log(1e-100))


# -- boxes --------------------------------------------------------------------------------

def touching(left: DataFrame, right: DataFrame) -> DataFrame:
    """Touching pairs with the depth of their overlap."""
    depth = F.least(*[F.least(F.col(f"a_hi_{x}"), F.col(f"b_hi_{x}")) - F.greatest(F.col(f"a_lo_{x}"), F.col(f"b_lo_{x}")) for x in AXES])
    return box_pairs(left, right, SCENE, AXES).withColumn("depth", depth)


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs where box b lies inside box a."""
    inside = None
    for x in AXES:
        c = (F.col(f"a_lo_{x}") <= F.col(f"b_lo_{x}")) & (F.col(f"b_hi_{x}") <= F.col(f"a_hi_{x}"))
        inside = c if inside is None else inside & c
    return box_pairs(left, right, SCENE, AXES).where(inside)


def _side(df: DataFrame, tag: str, ends: dict[str, str], more: Sequence[str] = ()) -> DataFrame:
    """(scene, a or b, alo_…, ahi_…): the rows as items of a search; ``ends`` maps lo_/hi_ names to columns."""
    return df.select("scene", F.col("obj").alias(tag), *[F.col(c).alias(f"{tag}{e}") for e, c in ends.items()], *more)


BOX_ENDS = {f"{p}_{x}": f"{p}_{x}" for p in ("lo", "hi") for x in AXES}


def min_distances(left: DataFrame, right: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene, dist): least distance of two different boxes of two sets, 0 if there are none."""
    gap = F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.greatest(F.col(f"blo_{x}") - F.col(f"ahi_{x}"), F.col(f"alo_{x}") - F.col(f"bhi_{x}"), F.lit(0.0)), 2) for x in AXES]))
    found = closest(_side(left, "a", BOX_ENDS), _side(right, "b", BOX_ENDS), SCENE, AXES, gap, ["a", "b"], each=False, distinct=True)
    return scenes.select("scene").join(found.select("scene", "dist"), "scene", "left").withColumn("dist", F.coalesce("dist", F.lit(0.0)))


def soft_contact(touch: DataFrame, dist: DataFrame) -> DataFrame:
    """(scene, score): overlap depth if the sets touch, else their distance."""
    depth = touch.groupBy("scene").agg(F.max("depth").alias("depth"))
    return dist.join(depth, "scene", "left").select("scene", F.coalesce("depth", "dist").alias("score"))


def nearest_between(left: DataFrame, right: DataFrame, dims: Sequence[str] = ("x", "y"), same: bool = False) -> DataFrame:
    """(scene, a, b, dist): the nearest right point per left point; ties take the smaller id. With ``same`` a point does not meet itself."""
    ends = {f"{p}_{d}": d for p in ("lo", "hi") for d in dims}
    gap = F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.col(f"alo_{d}") - F.col(f"blo_{d}"), 2) for d in dims]))
    return closest(_side(left, "a", ends), _side(right, "b", ends), SCENE, dims, gap, ["b"], distinct=same).select("scene", "a", "b", "dist")


def box_of(objects: DataFrame) -> DataFrame:
    """Boxes from centres x, y, z and sizes w, d, h."""
    half = dict(zip(AXES, ("w", "d", "h")))
    return objects.withColumns({f"lo_{a}": F.col(a) - F.col(s) / 2 for a, s in half.items()}).withColumns(
        {f"hi_{a}": F.col(a) + F.col(s) / 2 for a, s in half.items()})


def coplanar_relations(relations: DataFrame, planes: DataFrame, tol: float = 1e-2) -> DataFrame:
    """(scene, child, target, ok): parallel planes whose distance is the margin.

    ``relations`` has (scene, child, target, margin); ``planes`` (scene, obj, n0..2, p0..2).
    """
    def side(tag: str, key: str) -> DataFrame:
        return planes.select("scene", F.col("obj").alias(key), *[F.col(f"{c}{i}").alias(f"{tag}{c}{i}") for c in "np" for i in range(3)])
    both = relations.join(side("a", "child"), ["scene", "child"]).join(side("b", "target"), ["scene", "target"])
    parallel = F.abs(F.abs(la.dot(la.fields("an", 3), la.fields("bn", 3))) - 1) <= tol
    dist = la.dot(la.sub(la.fields("ap", 3), la.fields("bp", 3)), la.fields("bn", 3))
    return both.groupBy("scene", "child", "target").agg(F.bool_and(parallel & (F.abs(dist - F.col("margin")) <= tol)).alias("ok"))


def supported(relations: DataFrame, boxes: DataFrame) -> DataFrame:
    """(scene, child, target, supported, stable, overhang, beside): footprint tests of a child on its target."""
    ends = [f"{p}_{a}" for p in ("lo", "hi") for a in AXES]
    def side(tag: str, key: str) -> DataFrame:
        return boxes.select("scene", F.col("obj").alias(key), *[F.col(e).alias(f"{tag}{e}") for e in ends])
    both = relations.join(side("a", "child"), ["scene", "child"]).join(side("b", "target"), ["scene", "target"])
    def axis(x: str, what: str) -> Column:
        alo, ahi, blo, bhi = [F.col(f"{t}{p}_{x}") for t in "ab" for p in ("lo", "hi")]
        mid = (alo + ahi) / 2
        return {"mid": (mid >= blo) & (mid <= bhi), "in": (blo <= alo) & (ahi <= bhi), "over": (alo <= bhi) & (blo <= ahi)}[what]
    return both.select("scene", "child", "target", (axis("x", "mid") & axis("y", "mid")).alias("supported"),
                       (axis("x", "in") & axis("y", "in")).alias("stable"), (axis("x", "over") & axis("y", "over")).alias("overhang"), axis("y", "in").alias("beside"))


# -- scores -------------------------------------------------------------------------------

def rotational_asymmetry(objects: DataFrame) -> DataFrame:
    """(scene, score): objects ordered by angle around their centroid, compared with an even n-fold arrangement.

    Mean of the position part (scaled by the largest radius) and the heading part; 0 for fewer than two.
    """
    mid = objects.groupBy("scene").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count("*").alias("_n"))
    rel = objects.join(mid, "scene").withColumns({"_dx": F.col("x") - F.col("_mx"), "_dy": F.col("y") - F.col("_my")})
    rel = rel.withColumn("_ang", F.atan2("_dy", "_dx"))
    order = ranked(rel, SCENE, ["_ang", "obj"], "_rn")
    first = order.groupBy("scene").agg(F.min_by(F.struct("_ang", "yaw"), "_rn").alias("_f"), F.max(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)).alias("_big"))
    rows = order.join(first, "scene")
    radius = F.coalesce(F.try_divide(F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2), F.col("_big")), F.lit(0.0))
    step = (F.col("_rn") - 1) * 2 * math.pi / F.col("_n")
    # Angle of each vector after alignment to the first and turning back by its place.
    pa, va = F.col("_ang") - F.col("_f._ang") - step, F.col("yaw") - F.col("_f.yaw") - step
    rows = rows.select("scene", "_n", *[e.alias(n) for e, n in zip(
        (radius * F.cos(pa), radius * F.sin(pa), F.cos(va), F.sin(va)), ("px", "py", "vx", "vy"))])
    # MSD to the mean is the variance, since turning all back keeps distances.
    spread = rows.groupBy("scene").agg(*[F.var_pop(c).alias(c) for c in ("px", "py", "vx", "vy")], F.max("_n").alias("_n"))
    score = (F.col("px") + F.col("py") + F.col("vx") + F.col("vy")) / 2
    return spread.select("scene", F.when(F.col("_n") > 1, score).otherwise(0.0).alias("score"))


def principal_axes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, cx, cy, cz, long0, long1, short0, short1): mid point and unit normals of the long and short mid planes."""
    m = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
                                  F.var_samp("x").alias("_a"), F.covar_samp("x", "y").alias("_b"), F.var_samp("y").alias("_d"))
    # Half the angle of the doubled-angle form gives the major axis.
    m = m.withColumn("_t", 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_d")))
    return m.select(*keys, "cx", "cy", "cz", (-F.sin("_t")).alias("long0"), F.cos("_t").alias("long1"), F.cos("_t").alias("short0"), F.sin("_t").alias("short1"))


def reflect(p: la.Vec, at: la.Vec, n: la.Vec) -> la.Vec:
    """Point mirrored at a plane."""
    d = la.dot(la.sub(p, at), n)
    return la.sub(p, la.scale(n, 2 * d))


def plane_distance(p: la.Vec, at: la.Vec, n: la.Vec) -> Column:
    return F.abs(la.dot(la.sub(p, at), n))


def quaternion_angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle between orientations, direction ignored."""
    d = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    return 2 * F.acos(F.least(F.abs(d), F.lit(1.0)))


def reflectional_asymmetry(objects: DataFrame) -> DataFrame:
    """(scene, score): every object against the nearest mirror image, weighted by size.

    Mirrors at the long mid plane of the scene. The deviation is scaled by the
    root mean square distance of all pairs, which comes from moments alone.
    """
    frame = principal_axes(objects, SCENE)
    rows = objects.join(frame, "scene")
    side = (F.col("x") - F.col("cx")) * F.col("long0") + (F.col("y") - F.col("cy")) * F.col("long1")
    yaw = 2 * F.atan2(-F.col("long0"), F.col("long1")) - F.col("yaw")
    image = rows.select("scene", "obj", (F.col("x") - 2 * side * F.col("long0")).alias("x"), (F.col("y") - 2 * side * F.col("long1")).alias("y"), yaw.alias("yaw"))
    pairs = nearest_between(objects.select("scene", "obj", "x", "y"), image.select("scene", "obj", "x", "y"))
    both = pairs.join(objects.select("scene", F.col("obj").alias("a"), F.col("yaw").alias("ya"), F.pow("w", 3).alias("wt")), ["scene", "a"]).join(
        image.select("scene", F.col("obj").alias("b"), F.col("yaw").alias("yb")), ["scene", "b"])
    turn = F.pmod(F.col("ya") - F.col("yb"), F.lit(2 * math.pi))
    angle = F.least(turn, 2 * math.pi - turn)
    total = both.groupBy("scene").agg(F.sum(F.col("wt") * (F.col("dist") + angle)).alias("_d"))
    spread = objects.groupBy("scene").agg(F.sqrt(2 * (F.var_samp("x") + F.var_samp("y"))).alias("_s"))
    scaled = F.coalesce(F.try_divide(F.col("_d"), F.col("_s")), F.lit(0.0))
    return total.join(spread, "scene").select("scene", (1 - 1 / (1 + scaled)).alias("score"))


def coplanarity(objects: DataFrame) -> DataFrame:
    """(scene, score): consecutive boxes along the main axis, the 4 best of 6 face distances summed, mean over objects."""
    rows = box_of(objects).join(principal_axes(objects, SCENE), "scene").withColumn(
        "_along", F.round((F.col("x") - F.col("cx")) * F.col("short0") + (F.col("y") - F.col("cy")) * F.col("short1"), 9))
    ends = [f"{p}_{a}" for p in ("lo", "hi") for a in AXES]
    pairs = neighbours(rows, SCENE, ["_along", "obj"], {f"_n_{e}": e for e in ends}, ahead=True)
    gaps = F.sort_array(F.array(*[F.abs(F.col(e) - F.col(f"_n_{e}")) for e in ends]))
    best = F.aggregate(F.slice(gaps, 1, 4), F.lit(0.0), lambda a, x: a + x)
    return pairs.groupBy("scene").agg((F.sum(F.when(F.col("_n_lo_x").isNotNull(), best).otherwise(0.0)) / F.count("*")).alias("score"))


def edge_distance(px: Column, py: Column, e: Mapping[str, Column]) -> Column:
    """Distance of a point from a segment x0,y0 – x1,y1."""
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    s = sc.clamp(F.coalesce(F.try_divide((px - e["x0"]) * dx + (py - e["y0"]) * dy, dx * dx + dy * dy), F.lit(0.0)), 0.0, 1.0)
    return F.sqrt(F.pow(px - e["x0"] - s * dx, 2) + F.pow(py - e["y0"] - s * dy, 2))


def angle_alignment(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene, score): per object the better of both normals of its nearest edge, −dot/2 + ½, summed. Edges are (scene, room, edge, x0..y1), the first by room and edge among equally near ones; an edge without length faces nowhere and gives ½, a scene without edges scores 0."""
    e = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    points = _side(objects, "a", {f"{p}_{d}": d for p in ("lo", "hi") for d in "xy"}, ["yaw"])
    walls = edges.select("scene", F.struct("room", "edge").alias("b"), *[f(f"{d}0", f"{d}1").alias(f"b{p}_{d}") for p, f in (("lo", F.least), ("hi", F.greatest)) for d in "xy"], "room", "edge", *e)
    gap = F.round(edge_distance(F.col("alo_x"), F.col("alo_y"), e), 9)
    near = closest(points, walls, SCENE, ("x", "y"), gap, ["room", "edge"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    dot = F.coalesce(F.try_divide(F.cos("yaw") * dy - F.sin("yaw") * dx, F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    scored = near.groupBy("scene").agg(F.sum(0.5 - F.abs(dot) / 2).alias("score"))
    return objects.select("scene").distinct().join(scored, "scene", "left").select("scene", F.coalesce("score", F.lit(0.0)).alias("score"))


def focus(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """(scene, score): how far objects look away from the target (scene, tx, ty): −dot/2 + ½ summed."""
    both = objects.join(targets, "scene")
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    dot = F.coalesce(F.try_divide(F.cos("yaw") * dx + F.sin("yaw") * dy, F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    return both.groupBy("scene").agg(F.sum(0.5 - dot / 2).alias("score"))


def accessibility(objects: DataFrame) -> DataFrame:
    """(scene, score): blockage by the nearest other object in front: dot / dist² · diagonal; behind counts 0."""
    near = nearest_between(objects, objects, ("x", "y", "z"), same=True)
    a = objects.select("scene", F.col("obj").alias("a"), "yaw", *[F.col(c).alias(f"a{c}") for c in AXES])
    b = objects.select("scene", F.col("obj").alias("b"), *[F.col(c).alias(f"b{c}") for c in AXES], F.sqrt(F.col("w") ** 2 + F.col("d") ** 2 + F.col("h") ** 2).alias("_diag"))
    both = near.join(a, ["scene", "a"]).join(b, ["scene", "b"])
    dot = F.cos("yaw") * (F.col("bx") - F.col("ax")) + F.sin("yaw") * (F.col("by") - F.col("ay"))
    cost = F.when(dot < 0, 0.0).otherwise(F.coalesce(F.try_divide(dot, F.col("dist") ** 2), F.lit(0.0)) * F.col("_diag"))
    return both.groupBy("scene").agg(F.sum(cost).alias("score"))


def front_penetration(left: DataFrame, right: DataFrame, axis: str, sign: int, depth: float) -> DataFrame:
    """(scene, depth): how deep boxes reach into the free space of ``depth`` in front of others, 0 without a hit."""
    face = F.col(f"hi_{axis}") if sign > 0 else F.col(f"lo_{axis}")
    ends = (face, face + depth) if sign > 0 else (face - depth, face)
    free = left.withColumns({f"lo_{axis}": ends[0], f"hi_{axis}": ends[1]})
    return touching(free, right).groupBy("scene").agg(F.max("depth").alias("depth"))


def free_floor(rooms: DataFrame, occupied: DataFrame) -> DataFrame:
    """(scene, free): percent of floor area left after the projected areas of the occupying set."""
    area = F.col("w") * F.col("d")
    have, used = rooms.groupBy("scene").agg(F.sum(area).alias("_have")), occupied.groupBy("scene").agg(F.sum(area).alias("_used"))
    return have.join(used, "scene", "left").select("scene", ((F.col("_have") - F.coalesce("_used", F.lit(0.0))) / F.col("_have") * 100).alias("free"))


def centre_distance(relations: DataFrame, objects: DataFrame, planes: DataFrame) -> DataFrame:
    """(scene, score): summed distance of object centres from the centre of their parent's plane (scene, obj, px, py, pz)."""
    a = objects.select("scene", F.col("obj").alias("child"), *AXES)
    b = planes.select("scene", F.col("obj").alias("target"), *[f"p{c}" for c in AXES])
    both = relations.join(a, ["scene", "child"]).join(b, ["scene", "target"])
    return both.groupBy("scene").agg(F.sum(la.norm([F.col(c) - F.col(f"p{c}") for c in AXES])).alias("score"))


def unique_planes(faces: DataFrame, keys: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """(keys…, k0..3, face): first face per rounded normal and offset; faces with a zero normal are skipped.

    ``faces`` is (keys…, face, n0..2, p0..2).
    """
    n = la.fields("n", 3)
    rounded = [F.rint(c / tolerance).cast("bigint").alias(f"k{i}") for i, c in enumerate([*n, la.dot(n, la.fields("p", 3))])]
    return faces.where(la.dot(n, n) > 0).groupBy(*keys, *rounded).agg(F.min("face").alias("face"))


# -- rooms --------------------------------------------------------------------------------

def ring_edges(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, edge, x0, y0, x1, y1): consecutive vertices with wrap-around, edges without length dropped."""
    nxt = neighbours(vertices, keys, ["ring_idx"], {"_x": "x", "_y": "y"}, ahead=True)
    first = vertices.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "ring_idx").alias("_f"))
    out = nxt.join(first, list(keys)).select(*keys, F.col("ring_idx").alias("edge"), F.col("x").alias("x0"), F.col("y").alias("y0"),
                                             F.coalesce("_x", "_f.x").alias("x1"), F.coalesce("_y", "_f.y").alias("y1"))
    return out.where((F.abs(F.col("x0") - F.col("x1")) > 1e-8) | (F.abs(F.col("y0") - F.col("y1")) > 1e-8))


def room_metrics(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, area, length, n_verts, aspect): shoelace area, perimeter, vertices of the closed ring, aspect of the bounds."""
    e = ring_edges(vertices, keys)
    lens = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    by_edge = e.groupBy(*keys).agg((F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))) / 2).alias("area"), F.sum(lens).alias("length"))
    ratio = (F.max("x") - F.min("x")) / (F.max("y") - F.min("y"))
    by_vertex = vertices.groupBy(*keys).agg((F.count("*") + 1).alias("n_verts"), ratio.alias("_r"))
    return by_edge.join(by_vertex, list(keys)).select(*keys, "area", "length", "n_verts", F.greatest(F.col("_r"), 1 / F.col("_r")).alias("aspect"))


def room_centroids(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, cx, cy): area centroid."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    s = ring_edges(vertices, keys).groupBy(*keys).agg(F.sum(cross).alias("_a"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("_x"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("_y"))
    return s.select(*keys, (F.col("_x") / (3 * F.col("_a"))).alias("cx"), (F.col("_y") / (3 * F.col("_a"))).alias("cy"))


def grid_lines(vertices: DataFrame, keys: Sequence[str], direction: str, unit: float) -> DataFrame:
    cell = (F.col(direction) / unit).cast("bigint")
    return vertices.groupBy(*keys).agg(F.countDistinct(cell).alias("n_lines"))


def shared_boundary(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(scene, length, n_verts) shared between two room sets; ``edges`` is (scene, a, b, length, n_verts), read both ways."""
    flip = edges.select("scene", F.col("b").alias("a"), F.col("a").alias("b"), "length", "n_verts")
    both = edges.select("scene", "a", "b", "length", "n_verts").unionByName(flip).distinct()
    kept = both.join(left.select("scene", F.col("room").alias("a")), ["scene", "a"], "left_semi").join(
        right.select("scene", F.col("room").alias("b")), ["scene", "b"], "left_semi")
    return kept.groupBy("scene").agg(F.sum("length").alias("length"), F.sum("n_verts").alias("n_verts"))


def same_level(rooms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rooms on the level of a chosen room of their scene."""
    return rooms.join(chosen.select("scene", "level").distinct(), ["scene", "level"], "left_semi")


def graph_coherence(rooms: DataFrame, edges: DataFrame, margin: float) -> DataFrame:
    """(scene, count): short shared segments (2 for exterior rooms), levels whose areas do not add up, upper outlines that stick out.

    ``rooms`` is (scene, room, level, exterior, area, lo_x, lo_y, hi_x, hi_y); ``edges`` (scene, a, b, length).
    """
    info = rooms.select("scene", F.col("room").alias("a"), "exterior")
    short = edges.where(F.col("length") < margin).join(info, ["scene", "a"]).groupBy("scene").agg(F.sum(F.when(F.col("exterior"), 2).otherwise(1)).alias("n"))
    level = rooms.groupBy("scene", "level").agg(F.sum(F.when(~F.col("exterior"), F.col("area")).otherwise(0.0)).alias("_in"), F.sum(F.when(F.col("exterior"), F.col("area")).otherwise(0.0)).alias("_out"))
    area = level.groupBy("scene").agg(F.count_if(F.abs(F.col("_in") - F.col("_out")) > 0.01).alias("n"))
    outline = rooms.where("exterior")
    below = outline.select("scene", (F.col("level") + 1).alias("level"), *[F.col(c).alias(f"_{c}") for c in ("lo_x", "lo_y", "hi_x", "hi_y")])
    inside = (F.col("_lo_x") <= F.col("lo_x")) & (F.col("_lo_y") <= F.col("lo_y")) & (F.col("hi_x") <= F.col("_hi_x")) & (F.col("hi_y") <= F.col("_hi_y"))
    sticks = outline.join(below, ["scene", "level"]).groupBy("scene").agg(F.count_if(~inside).alias("n"))
    return short.unionByName(area).unionByName(sticks).groupBy("scene").agg(F.sum("n").alias("count"))


def access_angles(centres: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(scene, room, angle): least angle between the ways to the root and to a neighbour, π without one, 0 at the root; unknown rooms do not count.

    ``centres`` is (scene, room, cx, cy), ``edges`` (scene, a, b) both ways, ``roots`` (scene, root).
    """
    c = {t: centres.select("scene", F.col("room").alias(k), F.col("cx").alias(f"{t}x"), F.col("cy").alias(f"{t}y")) for t, k in (("a", "room"), ("b", "b"), ("r", "root"))}
    base = c["a"].join(roots, "scene").join(c["r"], ["scene", "root"])
    ways = base.join(edges.select("scene", F.col("a").alias("room"), "b"), ["scene", "room"], "left").join(c["b"], ["scene", "b"], "left")
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("rx") - F.col("ax"), F.col("ry") - F.col("ay")
    dot = F.try_divide(ux * vx + uy * vy, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    angle = F.acos((1 - 1e-6) * sc.clamp(F.coalesce(dot, F.lit(0.0)), -1.0, 1.0))
    best = ways.groupBy("scene", "room", "root").agg(F.least(F.lit(math.pi), F.coalesce(F.min(F.when(F.col("bx").isNotNull(), angle)), F.lit(math.pi))).alias("angle"))
    return best.select("scene", "room", F.when(F.col("room") == F.col("root"), 0.0).otherwise(F.col("angle")).alias("angle"))


# -- candidates and palettes --------------------------------------------------------------

def capped_candidates(objects: DataFrame, forbidden: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` candidates by name per scene, forbidden ones removed. The rank limit works before the shuffle."""
    from pyspark.sql import Window

    free = objects.join(forbidden, OBJ, "left_anti")
    return free.withColumn("rn", F.row_number().over(Window.partitionBy("scene").orderBy("obj")).cast("bigint")).where(F.col("rn") <= limit)


def cholesky(cov: Sequence[Sequence[float]]) -> list[list[float]]:
    """Lower factor of a small positive semi-definite matrix; a direction without spread gives a zero column."""
    n = len(cov)
    low = [[0.0] * n for _ in range(n)]
    for j in range(n):
        low[j][j] = math.sqrt(max(cov[j][j] - sum(v * v for v in low[j][:j]), 0.0))
        for i in range(j + 1, n):
            rest = cov[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
            low[i][j] = rest / low[j][j] if low[j][j] > 0 else 0.0
    return low


_PALETTE = "component int, weight double, mean array<double>, cov array<array<double>>, chol array<array<double>>, log_likelihood double, rounds int, converged boolean"


def palette(pixels: DataFrame, colours: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """Colour mixture over h, s, v pixels: one row a component, numbered from the heaviest.

    With each its weight, mean, covariance and the lower Cholesky factor of it, which ``palette_colour`` draws with;
    the fit's log-likelihood, its number of rounds and whether it settled before the last allowed one. Pixels with a
    null are left out; without pixels there is no row. The model has ``colours`` rows, so it passes the driver.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    spark = pixels.sparkSession
    whole = pixels.select("h", "s", "v").dropna()
    if whole.isEmpty():
        return spark.createDataFrame([], _PALETTE)
    model = GaussianMixture(k=colours, seed=seed, maxIter=rounds).fit(VectorAssembler(inputCols=["h", "s", "v"], outputCol="features").transform(whole))
    fit = model.summary
    shapes = sorted(zip(model.weights, model.gaussians, strict=True), key=lambda x: (-x[0], x[1].mean.toArray().tolist()))
    rows = []
    for i, (weight, shape) in enumerate(shapes):
        cov = shape.cov.toArray().tolist()
        rows.append((i, float(weight), shape.mean.toArray().tolist(), cov, cholesky(cov), float(fit.logLikelihood), fit.numIter, fit.numIter < rounds))
    return spark.createDataFrame(rows, _PALETTE)


def mixture_moments(mixture: DataFrame) -> DataFrame:
    """One row of total weight, means and covariances (m0.., c00, c01..) of a whole mixture, from weights, means and Cholesky factors.

    Right after a fit these are the moments of the data, whatever the components are.
    """
    def mean(i: int) -> Column:
        return F.col("mean")[i]

    def cov(i: int, j: int) -> Column:
        return reduce(lambda a, b: a + b, [F.col("chol")[i][k] * F.col("chol")[j][k] for k in range(3)])

    def total(c: Column) -> Column:
        return F.sum(F.col("weight") * c)

    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return mixture.agg(F.sum("weight").alias("weight"), *[total(mean(i)).alias(f"m{i}") for i in range(3)],
                       *[(total(cov(i, j) + mean(i) * mean(j)) - total(mean(i)) * total(mean(j))).alias(f"c{i}{j}") for i, j in pairs])

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointframe.functions import scalar as sc
from jointframe.operators import nearest as near
from jointframe.operators import scenes as sn


def value(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize("n,low,high,want", [(0, 1, 3, 1), (1, 1, 3, 0), (3, 1, 3, 0), (7, 1, 3, 4), (4, 0, 3, 1), (6, 0, 3, 3)])
def test_range_violation(spark, n, low, high, want):
    assert value(spark, sn.outside(F.lit(n), low, high)) == (want,)


@pytest.mark.parametrize("lhs,op,rhs,want", [(3, "lt", 3, 1), (1, "eq", 3, 2), (3, "lt", 1, 3), (1, "ge", 6, 5), (0, "ge", 3, 3), (1, "ge", 3, 2), (4, "eq", 3, 1), (6, "eq", 3, 3), (2, "gt", 1, 0)])
def test_integer_violation(spark, lhs, op, rhs, want):
    assert value(spark, sn.shortfall(F.lit(lhs), op, F.lit(rhs))) == (want,)


def test_arithmetic(spark):
    got = value(spark, sc.hinge(F.lit(1.0), 2, 3), sc.hinge(F.lit(2.0), 0, 1.5), sc.safe_div(F.lit(2.0), F.lit(3.0)), sc.safe_div(F.lit(0.0), F.lit(0.0)), sc.safe_div(F.lit(5.0), F.lit(0.0)))
    assert got == pytest.approx((1.0, 0.5, 2 / 3, 0.0, 1.0))


@pytest.mark.parametrize("p1,n1,p2,n2,implies", [
    (["a"], [], [], [], True), (["a"], [], ["a"], [], True), ([], [], ["a"], [], False), (["a", "b"], [], ["a"], [], True),
    (["a"], ["b"], ["a"], ["b"], True), (["a"], [], ["a"], ["b"], False), (["a"], ["a"], ["a"], [], False), (["gen:x", "gen:y"], [], [], [], False)])
def test_tag_implication(spark, p1, n1, p2, n2, implies):
    cols = [sn._strings(x) for x in (p1, n1, p2, n2)]
    assert value(spark, sn.implies(*cols)) == (implies,)


def objects(spark, rows):
    return spark.createDataFrame(rows, "scene int, obj int, x double, y double, z double, w double, d double, h double, yaw double")


def test_min_distance(spark):
    df = sn.box_of(objects(spark, [(1, 1, 0., 0., 0., 1., 1., 1., 0.), (1, 2, 2., 0., 0., 1., 1., 1., 0.), (2, 1, 0., 0., 0., 1., 1., 1., 0.), (3, 1, 0., 0., 0., 1., 1., 1., 0.), (3, 2, 500., 0., 0., 1., 1., 1., 0.)]))
    scenes = spark.createDataFrame([(1,), (2,), (3,)], "scene int")
    got = {r.scene: r.dist for r in sn.min_distances(df.where("obj = 1"), df.where("obj = 2"), scenes).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 499.0}


def brute_touching(rows):
    return {(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and all(abs(a[2 + i] - b[2 + i]) <= (a[5 + i] + b[5 + i]) / 2 for i in range(3))}


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_box_pairs_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    sizes = lambda: [float(x) * (1 + spread * float(2.0 ** rng.integers(-8, 3))) for x in rng.random(3) * 4 + 0.1]
    rows = [(1, i, *map(float, rng.random(3) * 20 - 10), *sizes(), 0.0) for i in range(80)] + [(1, 80, 0.0, 0.0, 0.0, 4000.0, 3.0, 5.0, 0.0), (1, 81, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 82, 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = sn.box_of(objects(spark, rows))
    got = [(r.a, r.b) for r in sn.touching(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_touching(rows)


def near_rows(df):
    """Output rows of the joins of an executed frame."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_giant_box_compares_a_linear_number_of_pairs(spark):
    """Small boxes apart from each other below one that covers all: the joins give a few rows a box."""
    rows = [(1, i, float(i % 60) * 3, float(i // 60) * 3, 0.0, 1.0, 1.0, 1.0, 0.0) for i in range(1200)] + [(1, 9999, 90.0, 30.0, 0.0, 500.0, 500.0, 9.0, 0.0)]
    df = sn.box_of(objects(spark, rows))
    met = near.box_pairs(df, df, sn.SCENE, sn.AXES)
    assert met.count() == 2 * 1200
    # Nobody meets more than a cell's worth of others and the giant: the plan's joins make a few rows a box.
    met.collect()
    made = near_rows(met)
    assert made and max(made) <= 8 * 1200


def nearest_brute(d, left, right):
    return {i: (right[int(j)], pytest.approx(d[k, j])) for k, (i, j) in enumerate(zip(left, d.argmin(axis=1), strict=True))}


@pytest.fixture(params=[near.PAIRS, 16])
def leaf(request, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", request.param)


def test_nearest_brute_force(spark, leaf):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.random((60, 2)), rng.random((40, 2)) * 0.001 + 7, [[9e6, 9e6]], [[3.0, 3.0]] * 5])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts)], "scene int, obj int, x double, y double")
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    np.fill_diagonal(d, np.inf)
    got = {r.a: (r.b, r.dist) for r in sn.nearest_between(df, df, same=True).collect()}
    assert got == nearest_brute(d, range(len(pts)), list(range(len(pts))))


def test_two_far_sets(spark, leaf):
    rng = np.random.default_rng(6)
    a, b = rng.random((50, 3)), rng.random((70, 3)) * 2 + 1e5
    frames = [spark.createDataFrame([(s, i, *map(float, p)) for s in (1, 2) for i, p in enumerate(x)], "scene int, obj int, x double, y double, z double") for x in (a, b)]
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    got = sn.nearest_between(*frames, dims=("x", "y", "z")).collect()
    assert {r.a: (r.b, r.dist) for r in got if r.scene == 2} == nearest_brute(d, range(50), list(range(70))) and len(got) == 100
    boxes = [sn.box_of(f.selectExpr("*", "0.5D AS w", "0.25D AS d", "1D AS h")) for f in frames]
    gaps = np.maximum(np.abs(a[:, None] - b[None]) - np.array([0.5, 0.25, 1.0]), 0)
    want = np.sqrt((gaps**2).sum(axis=2)).min()
    scenes = spark.createDataFrame([(1,), (2,), (3,)], "scene int")
    assert {r.scene: r.dist for r in sn.min_distances(*boxes, scenes).collect()} == {1: pytest.approx(want), 2: pytest.approx(want), 3: 0.0}


def test_far_sets_are_narrowed_before_items_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 256)
    rng = np.random.default_rng(8)
    left, right = [spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(rng.random((600, 2)) + shift)], "scene int, obj int, x double, y double") for shift in (0, 50)]
    items = [sn._side(df, t, {f"{p}_{d}": d for p in ("lo", "hi") for d in "xy"}) for df, t in ((left, "a"), (right, "b"))]
    large = spark.createDataFrame([(1, 600, 600)], "scene int, _na bigint, _nb bigint")
    compared = sum(df.count() for df in near._descend(*items, large, ["scene"], ["x", "y"], False, False))
    assert 0 < compared < 600 * 600 / 20


def test_walls_without_length_and_far_scenes(spark, leaf):
    rng = np.random.default_rng(10)
    obs = [(1, i, float(x), float(y), float(a)) for i, (x, y, a) in enumerate(rng.random((30, 3)) * 6)] + [(2, 0, 0.0, 0.0, 0.0), (3, 0, 1.0, 1.0, 0.0)]
    walls = [(1, r, e, *map(float, rng.random(4) * 6)) for r in range(5) for e in range(4)] + [(2, 0, 0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.scene: r.score for r in sn.angle_alignment(spark.createDataFrame(obs, "scene int, obj int, x double, y double, yaw double"), spark.createDataFrame(walls, "scene int, room int, edge int, x0 double, y0 double, x1 double, y1 double")).collect()}
    want = 0.0
    for _, _, x, y, yaw in obs[:30]:
        best = None
        for _, room, edge, x0, y0, x1, y1 in walls[:-1]:
            dx, dy = x1 - x0, y1 - y0
            s = min(max(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0), 1)
            k = (round(math.hypot(x - x0 - s * dx, y - y0 - s * dy), 9), room, edge, dx, dy)
            best = k if best is None or k < best else best
        want += 0.5 - abs((math.cos(yaw) * best[4] - math.sin(yaw) * best[3]) / math.hypot(best[3], best[4])) / 2
    assert got == {1: pytest.approx(want), 2: 0.5, 3: 0.0}


def test_circle_of_six(spark):
    ring = [(1, i, 2 * math.cos(i * math.pi / 3), 2 * math.sin(i * math.pi / 3), 0., 1., 1., 1., i * math.pi / 3) for i in range(6)]
    bent = [(2, *r[1:]) if r[1] else (2, 0, 1.0, 0.5, 0., 1., 1., 1., 0.3) for r in ring]
    got = {r.scene: r.score for r in sn.rotational_asymmetry(objects(spark, ring + bent)).collect()}
    assert got[1] == pytest.approx(0, abs=1e-9) and got[2] > 0.01


def test_unit_square(spark):
    v = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "room int, ring_idx int, x double, y double")
    r = sn.room_metrics(v, ["room"]).first()
    assert (r.area, r.length, r.n_verts, r.aspect) == (1.0, 4.0, 5, 1.0)


def test_contradiction_is_an_error(spark):
    a, b = sn._strings(["a"]), sn._strings([])
    with pytest.raises(Exception, match="contradicting"):
        value(spark, sn.intersection(a, b, b, a)[0])


def statement(kind="stable_against", child=(), parent=(), negated=False):
    """Tags with a leading minus are refused."""
    def split(tags):
        return [[t for t in tags if t[0] != "-"], [t[1:] for t in tags if t[0] == "-"]]
    return (kind, negated, *split(child), *split(parent))


EXAMPLE = statement(child=("top", "-bottom"), parent=("object", "-top"))
ANYTHING, NOTHING = statement("any"), statement("any", negated=True)


def negated(s):
    return (s[0], not s[1], *s[2:])


def logic_of(spark, left, asked, below=()):
    one = spark.range(1).select(F.struct(*[(sn._strings(v) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(("kind", "negated", "child_pos", "child_neg", "parent_pos", "parent_neg"), left)]).alias("statement"))
    rows = sn.compared_statements(one, [(i, *a) for i, a in enumerate(asked)], sn.RelationLogic(below)).orderBy("question").collect()
    return [(r.implied, r.met) for r in rows]


def test_statements_imply(spark):
    sf, sfi = statement("supported_by", ("support",)), statement("supported_by", ("support", "visible"))
    assert logic_of(spark, sf, [sf, sfi, ANYTHING, NOTHING, statement("touching")], (("touching", "supported_by"),)) == [(True, True), (False, True), (True, True), (False, False), (False, False)]
    assert [i for i, _ in logic_of(spark, sfi, [sf, ANYTHING])] == [True, True]
    assert [i for i, _ in logic_of(spark, ANYTHING, [sf, sfi, ANYTHING])] == [False, False, True]
    assert [i for i, _ in logic_of(spark, statement(), [statement("touching")])] == [False]
    # A general relation covers its special case, and tags the other way round exclude.
    assert [i for i, _ in logic_of(spark, statement("touching", ("support",)), [sf], (("touching", "supported_by"),))] == [True]
    assert [i for i, _ in logic_of(spark, statement(child=("-a",), parent=("b",)), [statement(child=("a",), parent=("-b",), negated=True), statement(child=("a",), negated=True)])] == [True, True]
    assert [i for i, _ in logic_of(spark, negated(sf), [negated(sf), negated(sfi), sf, sfi, ANYTHING])] == [True, False, False, False, False]


@pytest.mark.parametrize("other,plain,refused,flipped", [
    (statement("touching", ("top", "-bottom"), ("object", "-top")), False, True, True),
    (statement(child=("top",), parent=("object",)), True, True, False),
    (statement(child=("top", "-bottom", "support"), parent=("object", "-top", "-side")), True, False, True),
    (statement(child=("top", "visible"), parent=("object", "furniture")), True, True, True),
    (statement(child=("top", "bottom"), parent=("object",)), False, True, True),
    (statement(child=("top",), parent=("object", "top")), False, True, True),
])
def test_statements_meet(spark, other, plain, refused, flipped):
    """Both ways round: the statement with another, with its refusal, and the refused statement with the other."""
    assert [m for _, m in logic_of(spark, EXAMPLE, [other, negated(other)])] == [plain, refused]
    assert [m for _, m in logic_of(spark, negated(EXAMPLE), [other])] == [flipped]
    assert [m for _, m in logic_of(spark, other, [EXAMPLE, negated(EXAMPLE)])] == [plain, flipped]
    assert [m for _, m in logic_of(spark, negated(other), [EXAMPLE])] == [refused]
    assert [m for _, m in logic_of(spark, EXAMPLE, [ANYTHING, NOTHING])] == [True, False] and [m for _, m in logic_of(spark, negated(EXAMPLE), [ANYTHING])] == [True]


@pytest.mark.parametrize("cov", [[[4.0, 2.0, 0.5], [2.0, 3.0, 0.1], [0.5, 0.1, 1.0]], [[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0]]])
def test_cholesky_rebuilds_the_covariance(cov):
    low = np.array(sn.cholesky(cov))
    assert np.allclose(low @ low.T, cov) and np.allclose(low, np.tril(low))


def test_palette_finds_two_colours(spark):
    rng = np.random.default_rng(4)
    a = rng.multivariate_normal([0.2, 0.3, 0.4], np.diag([1e-3, 2e-3, 1e-3]), 900)
    b = rng.multivariate_normal([0.8, 0.7, 0.6], np.diag([1e-3, 1e-3, 3e-3]), 300)
    both = np.vstack([a, b])
    df = spark.createDataFrame([*map(tuple, both.tolist()), (None, 0.1, 0.1)], "h double, s double, v double")
    rows = sn.palette(df, 2, rounds=60).collect()
    assert [r.component for r in rows] == [0, 1] and rows[0].converged and rows[0].rounds < 60
    for r, own in zip(rows, (a, b)):
        assert r.weight == pytest.approx(len(own) / len(both), abs=0.01)
        assert r.mean == pytest.approx(own.mean(0), abs=0.01) and np.allclose(r.cov, np.cov(own.T, bias=True), atol=1e-3)
        assert np.allclose(np.array(r.chol) @ np.array(r.chol).T, r.cov)
    got = sn.mixture_moments(sn.palette(df, 2)).first()
    cov = np.cov(both.T, bias=True)
    assert [got.m0, got.m1, got.m2] == pytest.approx(both.mean(0)) and [got.c00, got.c01, got.c12] == pytest.approx([cov[0, 0], cov[0, 1], cov[1, 2]])
    components = [(r.weight, r.mean, [x for line in r.chol for x in line]) for r in rows]
    assert spark.range(5).select(*sc.palette_colour(components, F.col("id"))).count() == 5
    assert sn.palette(df.limit(0), 2).count() == 0


def test_stages_too_long_to_compile_are_split(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jointframe.operators import geometry as geo
from jointframe.operators import kinematics as kin
from jointframe.operators import mutate as mu
from jointframe.operators import splits as sp
from jointframe.plans import recursion
from jointframe.session import durable

COLS = "obj bigint, joint string, type string, parent string, child string, lower double, upper double, " + ", ".join(
    f"{c}{i} double" for c in ("ax", "o", "rpy") for i in range(3))


def joint(name, kind, parent, child, upper=1.0, axis=(0, 0, 1), origin=(0, 0, 0), rpy=(0, 0, 0), lower=0.0):
    return (1, name, kind, parent, child, lower, upper, *map(float, axis), *map(float, origin), *map(float, rpy))


@pytest.fixture(scope="module")
def appliance(spark):
    """Door moves parts 1 and 2, two racks move 4 and 5; 0 and 3 are static."""
    return spark.createDataFrame([
        joint("a_door", "revolute", "world", "h_door"), joint("f1", "fixed", "h_door", "l_1"), joint("f2", "fixed", "h_door", "l_2"),
        joint("b_rack", "prismatic", "world", "l_4", 0.4, (1, 0, 0)), joint("c_rack", "prismatic", "world", "l_5", 0.4, (1, 0, 0)),
        joint("f0", "fixed", "world", "l_0"), joint("f3", "fixed", "world", "l_3")], COLS)


def test_split_example(spark, appliance):
    moved = kin.descendant_parts(appliance, ["obj"])
    ordered = sp.joint_ordinals(appliance.where("type <> 'fixed'"))
    moving, active = sp.build_splits(ordered, moved.join(ordered.select("obj", "joint"), ["obj", "joint"], "left_semi"))
    got = {k: set(v) for k, v in moving.groupBy("key").agg(F.collect_list("label")).collect()}
    assert got == {"default": {1, 2, 4, 5}, "anim0": {1, 2}, "anim1": {4, 5}, "anim11": {4}, "anim12": {5}}
    parts = spark.createDataFrame([(1, i) for i in range(6)], "obj bigint, label bigint")
    roles = sp.split_roles(moving, parts).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("label").alias("d")).collect()
    assert all(r.n == 6 and r.d == 6 for r in roles)


def test_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    assert kin.ancestor_pairs(edges, []).count() == 6


def test_tail_into_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("t", "u"), ("r", "s")], "parent string, child string")
    got = {(r.node, r.ancestor): r.dist for r in kin.ancestor_pairs(edges, []).collect()}
    cycle = {(x, y): d for x, y, d in (("b", "a", 1), ("b", "c", 2), ("c", "b", 1), ("c", "a", 2), ("a", "c", 1), ("a", "b", 2))}
    assert got == {**cycle, ("t", "c"): 1, ("t", "b"): 2, ("t", "a"): 3, ("u", "t"): 1, ("u", "c"): 2, ("u", "b"): 3, ("u", "a"): 4, ("s", "r"): 1}
    assert [tuple(r) for r in kin.link_depth(edges, []).collect()] == [("s", 1)]


def test_deep_chain_takes_few_joins(spark, monkeypatch):
    written = []
    monkeypatch.setattr(recursion, "durable", lambda df: written.append(1) or durable(df))
    n = 1000
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "parent string, child string")
    assert {r.node: r.depth for r in kin.link_depth(edges, []).collect()} == {f"n{i}": i for i in range(1, n + 1)}
    assert len(written) <= 12
    joints = spark.createDataFrame([joint(f"j{i}", "fixed", f"n{i}", f"n{i + 1}", origin=(1, 0, 0)) for i in range(n)], COLS)
    poses = {r.link: r.t0 for r in kin.world_transforms(joints, ["obj"]).collect()}
    assert poses == {f"n{i}": float(i) for i in range(1, n + 1)} and len(written) <= 24
    assert kin.ancestor_pairs(edges.limit(200), []).count() == 200 * 201 // 2


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=60))
def test_breadth_first_numbers_match_a_queue(spark, picks):
    parent = {i + 1: (a % (i + 1)) for i, (a, _) in enumerate(picks)}
    sibling = {i + 1: b * 100 + i for i, (_, b) in enumerate(picks)}
    below = {}
    for c, p in parent.items():
        below.setdefault(p, []).append(c)
    queue, order = [(0, 0)], []
    while queue:
        node, depth = queue.pop(0)
        order += [(node, depth)] if node else []
        queue += [(c, depth + 1) for c in sorted(below.get(node, []), key=sibling.get)]
    edges = spark.createDataFrame([(1, f"n{p}", f"n{c}", sibling[c]) for c, p in parent.items()], "obj bigint, parent string, child string, label bigint")
    got = {r.link: (r.depth, r.number) for r in kin.breadth_first_numbers(edges, ["obj"], "label").collect()}
    assert got == {f"n{c}": (d, i) for i, (c, d) in enumerate(order)}


def test_world_rotation_is_orthonormal(spark):
    df = spark.createDataFrame([joint("a", "revolute", "world", "l_0", rpy=(0.3, 0.5, -0.7), origin=(1, 2, 3)),
                                joint("b", "revolute", "l_0", "l_1", rpy=(1.3, -0.5, 0.2), origin=(0, 1, 0))], COLS)
    for r in kin.world_transforms(df, ["obj"]).collect():
        m = np.array([r[f"r{i}"] for i in range(9)]).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)


def test_forward_kinematics_round_trip(spark):
    df = spark.createDataFrame([joint("a", "prismatic", "world", "l_0", 2.0, (0, 0, 1), (1, 0, 0)),
                                joint("b", "revolute", "l_0", "l_1", np.pi / 2, (0, 0, 1), (1, 0, 0)),
                                joint("c", "fixed", "l_1", "l_2", origin=(1, 0, 0))], COLS)
    out = {(r.link, r.frame): (r.t0, r.t1, r.t2) for r in kin.forward_kinematics(df, ["obj"], 3).collect()}
    assert np.allclose(out["l_2", 1], (3, 0, 0)) and np.allclose(out["l_2", 3], (3, 0, 0))
    assert np.allclose(out["l_2", 2], (2, 1, 2))


def test_custom_joint_value(spark):
    df = spark.createDataFrame([joint("a", "prismatic", "world", "l_0", 2.0, (0, 0, 1))], COLS)
    out = kin.forward_kinematics(df, ["obj"], 2, value=lambda kind, lo, hi, frame, n: frame * 10.0).collect()
    assert {(r.frame, r.t2) for r in out} == {(1, 10.0), (2, 20.0)}


@pytest.mark.parametrize("length", [4, 21])
def test_frames_are_multiplied_last(spark, length):
    from jointframe import session

    rng = np.random.default_rng(7)
    spec = [(rng.normal(size=3), rng.normal(size=3), float(rng.random())) for _ in range(length)]
    rows = [joint(f"j{i}", "revolute", "world" if i == 0 else f"l_{i - 1}", f"l_{i}", u, tuple(map(float, a)), tuple(map(float, o))) for i, (a, o, u) in enumerate(spec)]
    before = len(session._WRITTEN)
    out = {(r.link, r.frame): np.array([r[p] for p in kin.POSE]) for r in kin.forward_kinematics(spark.createDataFrame(rows, COLS), ["obj"], 9).collect()}
    assert len(out) == 9 * length
    for frame in (1, 4, 5, 9):
        m, v = np.eye(3), np.zeros(3)
        for i, (a, o, u) in enumerate(spec):
            x, q = a / np.linalg.norm(a), np.sin((frame - 1) / 8 * np.pi) * u
            skew = np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]])
            m, v = m @ (np.eye(3) + np.sin(q) * skew + (1 - np.cos(q)) * skew @ skew), v + m @ o
            assert np.allclose(out[f"l_{i}", frame], [*m.ravel(), *v])
    if length <= 8:
        assert all(spark.read.parquet(path).count() <= length for path in session._WRITTEN[before:])


def test_normalised_range(spark):
    v = spark.createDataFrame([(1, float(x), float(2 * x), 5.0) for x in range(10)] + [(2, 1.0, 1.0, 1.0)], "obj bigint, x double, y double, z double")
    out = geo.normalise(v, geo.normal_frames(v, ["obj"]), ["obj"]).toPandas()
    one = out[out.obj == 1]
    assert one[["x", "y", "z"]].abs().max().max() == pytest.approx(0.95)
    assert out[out.obj == 2][["x", "y", "z"]].to_numpy().tolist() == [[1.0, 1.0, 1.0]]


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_near_pairs_brute_force(spark, threshold):
    rng = np.random.default_rng(5)
    a, b = rng.random((150, 3)), rng.random((150, 3))
    ia, ib = rng.integers(0, 12, 150), rng.integers(0, 12, 150)
    left = spark.createDataFrame([(0, int(i), *map(float, p)) for i, p in zip(ia, a)], "k int, a int, x double, y double, z double")
    right = spark.createDataFrame([(0, int(i), *map(float, p)) for i, p in zip(ib, b)], "k int, b int, x double, y double, z double")
    close = np.linalg.norm(a[:, None] - b[None], axis=2) < threshold
    want = {(int(ia[i]), int(ib[j])) for i, j in zip(*np.where(close))}
    assert {(r.a, r.b) for r in geo.near_pairs(left, right, ["k"], "a", "b", threshold).collect()} == want


@pytest.mark.parametrize("few", [0, 35, 1 << 10])
def test_near_pairs_of_few_and_many_points(spark, monkeypatch, few):
    monkeypatch.setattr(geo, "FEW", few)
    rng = np.random.default_rng(6)
    p, part, key = rng.random((120, 3)), rng.integers(0, 9, 120), np.arange(120) % 7 % 3
    rows = [(int(k), int(i), *map(float, x)) for k, i, x in zip(key, part, p)]
    left, right = [spark.createDataFrame(rows, f"k int, {n} int, x double, y double, z double") for n in "ab"]
    close = (np.linalg.norm(p[:, None] - p[None], axis=2) < 0.25) & (key[:, None] == key[None]) & (part[:, None] < part[None])
    out = geo.near_pairs(left, right, ["k"], "a", "b", 0.25, "a < b")
    assert sorted(map(tuple, out.collect())) == sorted({(int(key[i]), int(part[i]), int(part[j])) for i, j in zip(*np.where(close))})
    if few > 120:
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_surface_samples_stay_on_triangles(spark):
    tri = spark.createDataFrame([(1, 0, 0., 0., 0., 1., 0., 0., 0., 1., 0.), (1, 1, 0., 0., 1., 3., 0., 1., 0., 3., 1.)],
                                "obj int, face int, " + ", ".join(f"{c}{i} double" for c in "pqs" for i in range(3)))
    pts = geo.surface_samples(tri, ["obj"], "face", least=1000).toPandas()
    assert abs(len(pts) - 1000) <= 2 and set(pts["z"]) == {0.0, 1.0}
    assert (pts["z"] == 1.0).mean() == pytest.approx(0.9, abs=0.01)
    assert (pts["x"] + pts["y"] <= np.where(pts["z"] == 1.0, 3.0, 1.0) + 1e-9).all()


def test_tilted_axis_angle(spark):
    df = spark.createDataFrame([joint("a", "revolute", "world", "l_0", axis=(0.3, -0.2, 0.9))], COLS)
    r = mu.with_tilted_axis(df, [F.col(f"ax{i}") for i in range(3)]).first()
    a, d = np.array([r.ax0, r.ax1, r.ax2]), np.array([r.d0, r.d1, r.d2])
    assert a @ d / np.linalg.norm(a) == pytest.approx(np.cos(np.pi / 4)) and np.linalg.norm(d) == pytest.approx(1)


def test_box_faces_show_one_side_of_each_pair(spark):
    from jointframe.operators import pixels as px

    corners = [(1, k, 10.2 * (k & 1) + 2.5 * (k >> 2), 10.2 * (k >> 1 & 1) + 1.5 * (k >> 2)) for k in range(8)]
    flat = [(2, k, 0.0, float(k & 1)) for k in range(8)]
    df = spark.createDataFrame(corners + flat, "box long, corner long, u double, v double")
    got = {(r.box, r.face): r.facing for r in px.box_faces(df, ["box"]).collect()}
    assert [got[1, f] for f in range(6)] == [True, False, False, True, False, True]
    assert not any(got[2, f] for f in range(6))


def test_grid_tracks_drop_broken_tracks_whole(spark):
    from jointframe.operators import pixels as px

    steps = [(1, f, y, x, 0.5 * f, float("nan") if (y, x, f) == (16, 16, 2) else 1.0) for f in (1, 2) for y in range(0, 80, 2) for x in range(0, 80, 2)]
    got = px.grid_tracks(spark.createDataFrame(steps, "scene long, frame long, row long, col long, dx double, dy double"), ["scene"], 40, 40, side=3).collect()
    assert {(r.gy, r.gx) for r in got} == {(y, x) for y in (8, 20, 32) for x in (8, 20, 32)} - {(8, 8)} and len(got) == 16
    assert {(r.x, r.y) for r in got if (r.gy, r.gx, r.frame) == (20, 32, 2)} == {(33.0, 21.0)}

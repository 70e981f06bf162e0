"""What the larger jobs write and exchange, and the same results as by plain means."""

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import session
from jointframe.functions import points as pts
from jointframe.functions import scalar as sc
from jointframe.functions import stats as st
from jointframe.operators import geometry as geo
from jointframe.operators import pixels as px
from jointframe.operators import splits as sp
from jointframe.plans import corpus, ordered
from jointframe.queries.corpus import strip_faces
from jointframe.queries.splits import movable_parts
from jointframe.session import Tables
from jointframe.sources import files

FOLDER = "/root/testdata/sf0.001"


def test_promotion_writes_no_more_rows_than_samples(spark):
    t = Tables(spark, FOLDER)
    faces = strip_faces(t)
    samples = faces.select("obj", "part").distinct().count() * 1_000
    before = len(session._WRITTEN)
    corpus.build(ad.joints(t), ad.parts(t).select("obj", "label"), ad.vertices(t), faces=faces).roles.count()
    assert max(spark.read.parquet(p).count() for p in session._WRITTEN[before:] if "durable-" in p) < 1.1 * samples


def test_contacts_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [(o, p, *map(float, rng.uniform(-0.2, 0.2, 3) * [1, 0.25, 0.25])) for o in range(3) for p in range(3) for _ in range(80)]
    frame = dict.fromkeys(["mx", "my", "mz"], 0.0) | {"scale": 1.0}
    joints = [{"obj": o, "joint": "j", "type": "prismatic", "lower": 0.0, "upper": up, "wo0": 0.0, "wo1": 0.0, "wo2": 0.0, "wd0": 1.0, "wd1": 0.0, "wd2": 0.0, **frame}
              for o, up in enumerate((0.1, 0.3, 9.0))]
    threshold = 0.01
    want = set()
    for o, j in enumerate(joints):
        mine = np.array([p[2:] for p in points if p[0] == o and p[1] == 0])
        for label in (1, 2):
            rest = np.array([p[2:] for p in points if p[0] == o and p[1] == label])
            for f in (0.5, 0.75, 1.0):
                posed = mine + [j["upper"] * f, 0, 0]
                if (((posed[:, None] - rest[None]) ** 2).sum(-1) < threshold ** 2).any():
                    want.add((o, "j", label))
    p = spark.createDataFrame(points, "obj bigint, part bigint, x double, y double, z double")
    moved = spark.createDataFrame([(o, "j", 0) for o in range(3)], "obj bigint, joint string, label bigint")
    pairs = spark.createDataFrame([(o, "j", k) for o in range(3) for k in (1, 2)], "obj bigint, joint string, label bigint")
    got = sp.contacts(p, moved, spark.createDataFrame(joints).withColumn("obj", F.col("obj").cast("bigint")), pairs, threshold)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and 0 < len(want) < 6


def test_samples_of_faces_are_neither_written_nor_exchanged(spark):
    t = Tables(spark, FOLDER)
    faces = strip_faces(t)
    samples = faces.select("obj", "part").distinct().count() * 1_000
    before = len(session._WRITTEN)
    corpus.build(ad.joints(t), ad.parts(t).select("obj", "label"), ad.vertices(t), faces=faces).roles.count()
    assert max(spark.read.parquet(p).count() for p in session._WRITTEN[before:] if "durable-" in p) < samples / 10


def test_contacts_over_faces_are_those_over_their_samples(spark, monkeypatch):
    rng = np.random.default_rng(11)
    frame = {"mx": 0.01, "my": 0.0, "mz": -0.02, "scale": 0.5}
    faces, joints, moved, pairs = [], [], [], []
    for o in range(6):
        # Labels need not count from 0, one asked label has no faces, and every other object has one more.
        more = (5,) if o % 2 else ()
        for part in (3, 4, 7, *more):
            for f in range(5):
                corners = rng.uniform(-0.3, 0.3, 9) + np.tile([0.5 * (part == 7), 0, 0], 3)
                faces.append((o, part, 10 * f, *map(float, corners)))
        for j, kind in enumerate(("prismatic", "revolute")):
            joints.append({"obj": o, "joint": f"j{j}", "type": kind, "lower": 0.0, "upper": float(rng.uniform(0, 0.8)), **{f"wo{i}": 0.1 * i for i in range(3)}, "wd0": float(1 - j), "wd1": 0.0, "wd2": float(j), **frame})
            moved.append((o, f"j{j}", 3 + j))
            pairs += [(o, f"j{j}", k) for k in (4 - j, 7, 9, *more)]
    tri = spark.createDataFrame(faces, ", ".join(["obj bigint, part bigint, face bigint", *[f"{c}{i} double" for c in "pqs" for i in range(3)]]))
    frames = spark.createDataFrame([(o, *frame.values(), False) for o in range(6)], ", ".join(["obj bigint", *[f"{c} double" for c in frame], "flat boolean"]))
    links = "obj bigint, joint string, label bigint"
    at = spark.createDataFrame(joints).withColumn("obj", F.col("obj").cast("bigint"))
    sides = [spark.createDataFrame(moved, links), at, spark.createDataFrame(pairs, links)]
    points = geo.in_frame(geo.surface_samples(tri.join(frames, "obj"), ["obj", "part"], "face", carry=geo.FRAME), ["obj", "part"])
    rest, posed = points.toPandas(), sp.posed_points(points, sides[0], at).toPandas()
    threshold, want = 0.004, set()
    for o, j, k in pairs:
        a = posed[(posed.obj == o) & (posed.joint == j)][geo.AXES].to_numpy()
        b = rest[(rest.obj == o) & (rest.part == k)][geo.AXES].to_numpy()
        if any((((x - b) ** 2).sum(-1) < threshold ** 2).any() for x in a):
            want.add((o, j, k))
    assert 5 < len(want) < len(pairs) - 12
    # All objects in one task each, and some in cells.
    for limit in (1 << 19, 7_000):
        monkeypatch.setattr(sp, "WHOLE", limit)
        rows = [tuple(r) for r in sp.surface_contacts(tri, frames, *sides, threshold).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_draws_of_a_batch_are_those_of_the_plan(spark):
    # The last but one fills a block of md5 with its number and tag, the last does not fit one.
    idents = ["1", "250", "-7", "x" * 51, "y" * 54]
    counts = np.array([1200, 1, 0, 110, 12])
    row, draws = pts.uniforms(pa.array(["cut", *idents]).slice(1), counts, ("a", "b"))
    rows = spark.createDataFrame([(r, s, int(n)) for r, (s, n) in enumerate(zip(idents, counts)) if n], "r int, s string, n int").selectExpr("r", "s", "explode(sequence(1, n)) AS i")
    want = rows.select("r", "i", *[sc.uniform(F.col("s"), F.col("i"), F.lit(t)).alias(t) for t in "ab"]).orderBy("r", "i").toPandas()
    assert (row == want.r).all() and (draws[0] == want.a).all() and (draws[1] == want.b).all()
    fits, (u, _) = pts.uniforms(pa.array(idents[:4]), counts[:4], ("a", "b"))
    assert (fits == row[: len(fits)]).all() and (u == draws[0][: len(fits)]).all()


def test_small_keys_are_done_whole_and_large_ones_in_blocks(spark, monkeypatch, many_blocks):
    df = spark.range(3_000).selectExpr("id % 7 * (id % 2) AS k", "id AS o", "IF(id % 5 = 0, id, NULL) AS v")

    def results():
        return [ordered.running_sum(df, ["k"], ["o"], {"s": F.col("o")}), ordered.ranked(df, ["k"], ["o"]), ordered.ranked(df, ["k"], ["o"], reread=True),
                ordered.neighbours(df, ["k"], ["o"], {"p": "v"}), ordered.neighbours(df, ["k"], ["o"], {"p": "v"}, ahead=True),
                ordered.fill_forward(df, ["k"], ["o"], ["v"]), ordered.running_max(df, ["k"], ["o"], "v", "m")]
    whole = results()
    # One exchange of the rows, and no join with summaries of blocks.
    for r in whole:
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for limit in (0, 1_000):
        monkeypatch.setattr(ordered, "WHOLE", limit)
        for a, b in zip(whole, results(), strict=True):
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_second_neighbours_come_by_the_same_exchange(spark, monkeypatch, many_blocks):
    df = spark.range(500).selectExpr("id % 7 * (id % 2) AS k", "id AS o", "IF(id % 5 = 0, id, NULL) AS v")
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    want = [(k, o, v, *[rows[i + d][2] if i + d < len(rows) and rows[i + d][0] == k else None for d in (1, 2)]) for i, (k, o, v) in enumerate(rows)]
    for limit in (1 << 16, 50, 0):
        monkeypatch.setattr(ordered, "WHOLE", limit)
        got = ordered.neighbours(df, ["k"], ["o"], {"p": "v"}, ahead=True, second={"q": "p"})
        if limit > 500:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
        assert sorted(map(tuple, got.select("k", "o", "v", "p", "q").collect()), key=lambda r: r[:2]) == want


def test_small_frames_leave_a_task_together():
    def coded(data) -> bytes:
        buf = io.BytesIO()
        np.save(buf, data)
        return buf.getvalue()
    tiles = [np.full((2, 3 + i % 2), i, dtype=np.float32) for i in range(1_000)] + [np.zeros((300, 300), dtype=np.float32), np.ones((1, 1), dtype=np.float32)]
    got = list(files.pixel_frames(["k"])(pd.DataFrame({"k": range(len(tiles)), "content": [coded(t) for t in tiles]})))
    assert [len(g) for g in got] == [7_000, 90_000, 1]
    rows = pd.concat(got)
    want = [(k, y, x, 0, float(v)) for k, t in enumerate(tiles) for (y, x), v in np.ndenumerate(t)]
    assert list(map(tuple, rows[["k", "y", "x", "c", "value"]].itertuples(index=False))) == want


def test_only_curved_segments_are_bisected():
    at = pd.Series([0.25, None, 0.5])
    ends = [pd.Series([v, None, v], dtype=object) for v in (0.0, 0.2, 0.7, 1.0, 1.0, 3.0, -1.0, 2.0)]
    got = st.bezier_value.func(at, *ends)
    s = np.linspace(0, 1, 2_000_001)
    x, y = [(1 - s) ** 3 * a + 3 * (1 - s) ** 2 * s * b + 3 * (1 - s) * s * s * c + s ** 3 * d for a, b, c, d in ((0.0, 0.2, 0.7, 1.0), (1.0, 3.0, -1.0, 2.0))]
    assert np.isnan(got[1]) and np.allclose(got[[0, 2]], np.interp([0.25, 0.5], x, y), atol=1e-6)


def test_covisibility_exchanges_depths_only(spark):
    rng = np.random.default_rng(8)
    spin = [0.0, 0.2, -0.5]
    cams, turns = [], []
    for f, a in enumerate(spin):
        c, s = float(np.cos(a)), float(np.sin(a))
        turns.append(np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]))
        cams.append((1, f, 8.0, 8.0, 9.5, 9.5, *map(float, turns[-1].ravel()), 0.3 * f, 0.0, 0.0))
    depth = {(f, y, x): float(d) for f in range(3) for y in range(20) for x in range(20) if (d := rng.integers(0, 6))}

    def land(f, g, y, x):
        p = np.array([(x - 9.5) / 8, (y - 9.5) / 8, 1.0]) * depth[f, y, x]
        q = turns[g].T @ (turns[f] @ p + [0.3 * f - 0.3 * g, 0, 0])
        return 8 * q[0] / q[2] + 9.5, 8 * q[1] / q[2] + 9.5

    want = {}
    for f in range(3):
        for g in range(3):
            hits = []
            for h, y, x in depth:
                if h != f or f == g:
                    continue
                u, v = land(f, g, y, x)
                back = np.zeros(2)
                for dx in (0, 1):
                    for dy in (0, 1):
                        bx, by = int(np.floor(u)) + dx, int(np.floor(v)) + dy
                        w = (u - np.floor(u) if dx else 1 - u + np.floor(u)) * (v - np.floor(v) if dy else 1 - v + np.floor(v))
                        if (g, by, bx) in depth:
                            back += w * (np.array(land(g, f, by, bx)) - [bx, by])
                hits.append(bool(np.hypot(*(back + [u - x, v - y])) < 1))
            if hits:
                want[f, g] = hits
    frame = spark.createDataFrame([(1, f, y, x, d) for (f, y, x), d in depth.items()], "scene int, frame int, y long, x long, depth double")
    names = ["scene int", "frame int", *[f"{c} double" for c in px.CAMERA]]
    out = px.covisibility(frame, spark.createDataFrame(cams, ", ".join(names)), ["scene"], "frame")
    got = {(r.a_frame, r.b_frame): r.score for r in out.collect()}
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # The tiles of a frame are made once, of depths; flow values of pairs are not gathered.
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathered and not any("gu" in line or "b_frame" in line for line in gathered)
    for k, hits in want.items():
        assert abs(got[k] - sum(hits) / len(hits)) < 1e-9 and 0 < sum(hits) < len(hits)


def test_candidate_splits_are_multiplied_after_a_merge(spark):
    ordered, moved = movable_parts(Tables(spark, FOLDER))
    rows = sp.candidate_splits(ordered, moved)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # A written table of moved parts is small by its bytes, but must not be sent to every task; nothing is counted to tell several joints.
    assert "SortMergeJoin" in plan and "HashAggregate" not in plan
    joints = ordered.toPandas()
    n = joints.groupby("obj").size()
    modes = {"revolute": 0, "prismatic": 1, "continuous": 2}
    want = set()
    for j in joints.itertuples():
        keys = [("default", 0), (f"anim{modes[j.type]}", modes[j.type] + 1)] + ([(f"anim{10 + j.ord}", 10 + j.ord)] if n[j.obj] > 1 else [])
        want |= {(j.obj, j.joint, *k) for k in keys}
    parts = {(r.obj, r.joint, r.label) for r in moved.collect()}
    assert sorted(map(tuple, rows.select("obj", "joint", "key", "prio", "label").collect())) == sorted((o, j, k, p, label) for o, j, k, p in want for oo, jj, label in parts if (oo, jj) == (o, j))

"""Queries over whole inputs, on the smallest data."""

import os

import duckdb
import pytest

from jointframe import adapters as ad
from jointframe.operators import geometry as geo
from jointframe.plans import corpus
from jointframe.queries import load_all
from jointframe.session import Tables
from tools.check_oracle import NAMES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES.split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


def test_every_frame_of_the_clip(spark, con):
    q = load_all()["forward_kinematics"]
    got = q.build(Tables(spark, FOLDER)).toPandas()
    assert sorted(got.frame.unique()) == list(range(1, 121))
    assert compare(got, con.execute(q.sql).df()).startswith("ok")


def test_walls_of_all_rooms_of_a_scene(spark, con):
    q = load_all()["angle_alignment"]
    got = q.build(Tables(spark, FOLDER)).toPandas()
    assert set(got.scene) == {r[0] for r in con.execute("SELECT DISTINCT CAST(floor(c_custkey / 50.0) AS BIGINT) FROM customer WHERE c_custkey % 9 <> 0").fetchall()}
    assert compare(got, con.execute(q.sql).df()).startswith("ok")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_partners_of_every_type(spark, con):
    q = load_all()["fuzzy_match"]
    got = q.build(Tables(spark, FOLDER)).toPandas()
    assert compare(got, con.execute(q.sql).df()).startswith("ok")
    rows = con.execute("SELECT DISTINCT p_name || ' ' || p_brand, substr(p_name, 2) || 's ' || p_brand FROM part").fetchall()
    want = {}
    for x in {r[0] for r in rows}:
        score = [(-200.0 * lcs(x, y) / (len(x) + len(y)), y) for y in {r[1] for r in rows} if 2 * min(len(x), len(y)) >= 0.88 * (len(x) + len(y))]
        best = min((s for s in score if -s[0] >= 88.0), default=None)
        if best:
            want[x] = best[1]
    assert want and {r.name_a: r.name_b for r in load_all()["fuzzy_match_lcs"].build(Tables(spark, FOLDER)).collect()} == want


def test_promotion_over_area_samples(spark, con):
    q = load_all()["corpus_splits"]
    got = q.build(Tables(spark, FOLDER)).toPandas()
    assert compare(got, con.execute(q.sql).df()).startswith("ok")
    least = corpus.build(*[f(Tables(spark, FOLDER)) for f in (ad.joints, lambda t: ad.parts(t).select("obj", "label"), ad.vertices)], threshold=1e-12)
    assert got.n_moving.sum() > least.roles.where("role = 'moving'").count()


def test_surface_samples_have_no_ceiling(spark):
    p = [f"CAST({v} AS DOUBLE) AS {c}{i}" for c, vs in (("p", "000"), ("q", "100"), ("s", "010")) for i, v in enumerate(vs)]
    tri = spark.range(12_000).selectExpr("1 AS obj", "id AS face", *p)
    assert geo.surface_samples(tri, ["obj"], "face").count() == 12_000

"""Mesh identity, names and inverse scalars."""

from pyspark.sql import functions as F

from jointframe.functions import scalar as sc
from jointframe.operators import pixels, splits


def test_identity_follows_overlapping_instance_sets(spark, many_blocks):
    rows = [(0, f, "m", 8, i) for f, ids in ((1, (1, 2)), (2, (2, 3)), (3, (3,)), (4, (9,)), (6, (9,)), (7, (9, 1))) for i in ids] + [(0, 2, "m", 9, 1)]
    got = pixels.mesh_identity(spark.createDataFrame(rows, "scene int, frame int, name string, n_verts int, instance int"))
    assert {(r.n_verts, r.frame): r.first_frame for r in got.collect()} == {(8, 1): 1, (8, 2): 1, (8, 3): 1, (8, 4): 4, (8, 6): 6, (8, 7): 6, (9, 2): 2}


def test_names(spark):
    names = ["TreeFactory(12).spawn_placeholder_x(3)", "TreeFactory(1).spawn_asset(2)", "scatter:grass_fine(3)", "Kole_Clouds", "bed-room 1", "kitchen_2/1", ""]
    n = F.col("name")
    df = spark.createDataFrame([(x,) for x in names], "name string")
    rows = df.select("name", F.array(*sc.asset_name(n)).alias("a"), sc.semantic_name(n).alias("s"), *[c.alias(k) for c, k in zip(sc.room_name(n), ("room", "level"), strict=True)]).collect()
    got = {r.name: r for r in rows}
    assert got[names[0]].a == ["TreeFactory", "12", "x", "3"] and got[names[1]].a == ["TreeFactory", "1", "asset", "2"] and got[names[3]].a == [None] * 4
    assert [got[x].s for x in names] == ["Tree", "Tree", "Grass", "Kole_Clouds", None, None, None]
    assert (got["kitchen_2/1"].room, got["kitchen_2/1"].level) == ("kitchen", 2) and got["Kole_Clouds"].level is None


def test_inverse_interpolation_undoes_interpolation(spark):
    table = F.array(*[F.lit(float(v)) for v in (1, 4, 4.5, 10)])
    df = spark.createDataFrame([(x / 10,) for x in range(31)], "t double")
    rows = df.select("t", sc.inverse_table_lerp(table, sc.table_lerp(table, F.col("t"))).alias("back")).collect()
    assert all(abs(r.t - r.back) < 1e-9 for r in rows)
    assert spark.range(1).select(sc.inverse_table_lerp(table, F.lit(0.5)).alias("low"), sc.inverse_table_lerp(table, F.lit(11.0)).alias("high")).first() == (None, None)


def test_hsv_round_trip(spark):
    df = spark.createDataFrame([(r / 4, g / 4, b / 4) for r in range(5) for g in range(5) for b in range(5)], "r double, g double, b double")
    back = sc.hsv_to_rgb(*sc.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))
    assert df.where(sum((F.abs(x - F.col(c)) for x, c in zip(back, "rgb", strict=True)), F.lit(0.0)) > 1e-9).count() == 0


def test_rows_beyond_the_tensor_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "k", i, *[float(i)] * 12) for i in range(10)], "obj int, key string, slot long, " + ", ".join(f"c{i} double" for i in range(12)))
    tensor = splits.tensors(rows).first().tensor
    assert len(tensor) == 8 and tensor[7][0] == 7.0
    assert sorted(r.slot for r in splits.tensor_rejects(rows).collect()) == [8, 9]

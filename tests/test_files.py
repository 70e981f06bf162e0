"""Real files: written, scanned, parsed."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointframe.sinks import text as out
from jointframe.sources import assets, files, logs
from jointframe.sources.text import documents, lines, listing


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


OBJ = """# comment
mtllib a.mtl
usemtl first
v 0 0 0
v 1 0 0
v 1 1 0
vt 0.5 0.5
vn 0 0 1
f 1 2 3
f 1/1 2/1 3/1
usemtl second
g grp one
f 1//1 2//1 3//1
f -1/1/1 2/1/1 3/1/1
"""


@pytest.mark.parametrize("split", [None, 40])
def test_obj(spark, tmp_path, split):
    """Also with a file cut into several splits."""
    write(str(tmp_path), "m/a.obj", OBJ)
    write(str(tmp_path), "m/b.obj", "v 9 9 9\nf 1 1 1\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    rec = assets.obj_records(lines(spark, str(tmp_path / "m"))).withColumn("path", F.element_at(F.split("path", "/"), -1)).where("path = 'a.obj'").cache()
    faces = {r.idx: [tuple(c) for c in r.corners] for r in assets.obj_faces(rec).collect()}
    assert faces[1] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)] and faces[2][0] == (1, 1, 0) and faces[3][0] == (1, 0, 1) and faces[4][0] == (-1, 1, 1)
    assert {(r.directive, r.value, r.n_faces) for r in assets.obj_materials(rec).collect()} == {("mtllib", "a.mtl", 0), ("usemtl", "first", 0), ("usemtl", "second", 2), ("g", "grp one", 2)}
    assert [(r.idx, r.x, r.y) for r in assets.obj_points(rec).orderBy("idx").collect()] == [(1, 0, 0), (2, 1, 0), (3, 1, 1)]
    assert assets.obj_points(rec, "vt").count() == 1 and assets.obj_points(rec, "vn").count() == 1
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_obj_write_and_read_back(spark, tmp_path):
    v = spark.createDataFrame([("p", i, float(i), 0.5, -1.0) for i in range(1, 4)], "path string, idx bigint, x double, y double, z double")
    corner = "array<struct<v:bigint,vt:bigint,vn:bigint>>"
    faces = spark.createDataFrame([("p", 1, [(1, 0, 2), (2, 0, 2), (3, 0, 2)])], f"path string, idx bigint, corners {corner}")
    mats = spark.createDataFrame([("p", 0, 0, "usemtl", "m1")], "path string, n_faces bigint, ord int, directive string, value string")
    out.write_lines(out.obj_lines(v, faces, materials=mats), ["sec", "pos", "sub"], str(tmp_path / "o"))
    rows = "".join(open(os.path.join(d, n)).read() for d, _, ns in sorted(os.walk(tmp_path / "o")) for n in sorted(ns) if n.startswith("part"))
    assert rows.splitlines() == ["v 1.000000 0.500000 -1.000000", "v 2.000000 0.500000 -1.000000", "v 3.000000 0.500000 -1.000000", "usemtl m1", "f 1//2 2//2 3//2"]


URDF = """<?xml version="1.0"?><robot name="r"><link name="world"/><link name="l_0"><visual><origin xyz="1 2 3"/><geometry><mesh filename="a.obj"/></geometry></visual>
<visual><geometry><box size="1"/></geometry></visual></link><link name="x_helper"/>
<joint name="j" type="revolute"><parent link="world"/><child link="l_0"/><axis xyz="0 0 2"/><limit lower="-1" upper="2"/></joint>
<joint name="k"><parent link="l_0"/><child link="x_helper"/></joint></robot>"""


def test_urdf(spark, tmp_path):
    write(str(tmp_path), "u/scene.urdf", URDF)
    parsed = assets.parse_urdf(documents(spark, str(tmp_path / "u"), "*.urdf"))
    links = {r.link: r for r in assets.link_rows(parsed).collect()}
    assert links["l_0"].n_visuals == 1 and (links["l_0"].part, links["l_0"].mesh, links["l_0"].v1) == (0, "a.obj", 2.0)
    assert links["x_helper"].is_helper and links["x_helper"].part is None
    joints = {r.joint: r for r in assets.joint_rows(parsed).collect()}
    assert (joints["j"].ax2, joints["j"].lower, joints["j"].upper) == (1.0, -1.0, 2.0)
    assert joints["k"].type == "fixed" and not joints["k"].axis_given and joints["k"].ax0 == 1.0 and joints["k"].upper == 0.0


def test_objects(spark, tmp_path):
    good = {"object_name": "o", "parts": [{"label": 0, "name": "a"}, {"name": "no label"}], "group_info": {"0": [0, 3], "1": [[1, 2], "0", [0, 0, 1, 0, 0, 0, 0, 1.5], "B"], "2": 7, "3": [4, "0", [1, 0, 0, 0, 0, 0, 0, 1], "A"]}}
    write(str(tmp_path), "j/1.json", json.dumps(good))
    write(str(tmp_path), "j/2.json", "{broken")
    docs = documents(spark, str(tmp_path / "j"), "*.json")
    parsed = assets.parse_objects(docs)
    assert [r.category for r in assets.object_rows(parsed).collect()] == ["Unknown"] and assets.rejected_objects(docs).count() == 1
    assert [(r.label, r.density, r.poisson) for r in assets.part_rows(parsed).collect()] == [(0, "1.0 g/cm^3", 0.3)]
    g = {r.gid: r for r in assets.group_rows(parsed).collect()}
    assert (g[0].kind, g[0].labels) == ("static", [0, 3]) and (g[2].kind, g[2].labels) == ("static", [7])
    assert (g[1].type, g[1].labels, g[1].parent, g[1].params[7]) == ("prismatic", [1, 2], 0, 1.5) and g[3].labels == [4]


def test_frame_names(spark):
    names = spark.createDataFrame([("Image_0_0_0048_1.png",), ("_0_1_0002_0.npy",), ("Image_7.png",)], "n string")
    got = [r.f for r in names.select(files.frame_name(F.col("n")).alias("f")).collect()]
    assert (got[0].dtype, got[0].frame, got[0].subcam, got[0].ext) == ("Image", 48, 1, "png") and got[1].resample == 1 and got[2] is None
    with pytest.raises(Exception, match="too many tokens"):
        spark.createDataFrame([("a_b_0_0_1_1.png",)], "n string").select(files.frame_name(F.col("n"))).collect()


def test_dense_arrays(spark, tmp_path):
    plain, packed = io.BytesIO(), io.BytesIO()
    np.save(plain, np.arange(6, dtype=np.float32).reshape(2, 3))
    np.savez(packed, vals=np.array([5, 9]), indices=np.array([[0, 1], [1, 1]], dtype=np.uint8))
    df = spark.createDataFrame([("a", bytearray(plain.getvalue())), ("b", bytearray(packed.getvalue()))], "f string, content binary")
    rows = {(r.f, r.y, r.x): r.value for r in files.decode_arrays(df, ["f"]).collect()}
    assert rows["a", 1, 2] == 5.0 and rows["b", 0, 0] == 5 and rows["b", 1, 0] == 9 and len(rows) == 10


def test_listing_and_refresh(spark, tmp_path):
    write(str(tmp_path), "l/Fac/3/scene.urdf", "x")
    write(str(tmp_path), "l/Fac/4/scene.urdf", "y")
    now = listing(spark, str(tmp_path / "l"), "*.urdf")
    assert {(r.factory, r.seed) for r in files.path_parts(now).collect()} == {("Fac", "3"), ("Fac", "4")}
    assert files.refresh(now, now.select("path", "modified")).count() == 0
    assert files.refresh(now, now.where("path like '%/3/%'").select("path", "modified")).count() == 1


def test_release_selection_fails_on_gaps(spark):
    want = spark.createDataFrame([(1, "Depth"), (2, "Depth")], "seed int, dtype string")
    have = spark.createDataFrame([(1, "Depth")], "seed int, dtype string")
    assert [r.file for r in files.release_selection(want.where("seed = 1"), have, ["seed", "dtype"]).collect()] == ["1_Depth"]
    with pytest.raises(Exception, match="not in the release"):
        files.release_selection(want, have, ["seed", "dtype"]).collect()


def test_stage_results_csv(spark, tmp_path):
    write(str(tmp_path), "c/a.csv", "name,ran,mem_at_finish,obj_count,instance_count\ntrees,True,10,2,3\nrocks,False,,,\n")
    assert [(r.name, r.ran, r.mem_at_finish) for r in logs.stage_results(spark, str(tmp_path / "c")).orderBy("name").collect()] == [("rocks", False, None), ("trees", True, 10)]


def test_configs_of_crashes(spark):
    scripts = spark.createDataFrame([("file:///a//s1/run_pipeline.sh", 0, i, x) for i, x in enumerate((
        "run --task fine", "run --task coarse -g desert simple -p a=1", "run --task finecpu -g forest -p b", "run --task fine -g late -p b"))] + [("/a/s2/other.sh", 0, 0, "--task fine -g x -p")],
        "path string, _blk long, seq long, line string")
    crashes = spark.createDataFrame([("/a/s1/logs/x.err", "coarse"), ("/a/s1/logs/y.err", "fine"), ("/a/s1/logs/y.err", "fine"), ("/a/s2/logs/z.err", "fine"), ("odd", "fine")], "log_path string, stage string")
    got = sorted((r.log_path, r.stage, r.configs or "", r.scenetype or "") for r in logs.with_configs(crashes, scripts).collect())
    assert got == [("/a/s1/logs/x.err", "coarse", "desert simple", "desert"), ("/a/s1/logs/y.err", "fine", "forest", "forest"), ("/a/s1/logs/y.err", "fine", "forest", "forest"), ("/a/s2/logs/z.err", "fine", "", ""), ("odd", "fine", "", "")]


def test_list_literals(spark):
    lists = [[], ["a"], ["it's", 'x "y"', "a, b", "back\\slash"], ["", "'", '"', """'mixed" one"""]]
    df = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(lists)], "i int, t string").orderBy("i")
    assert [r.v for r in df.select("i", logs.list_literal(df.t).alias("v")).orderBy("i").collect()] == lists


def test_obj_round_trip_by_line(spark):
    text = ["mtllib a.mtl", "mtllib b.mtl", "v 1.000000 2.000000 3.000000", "v 0.500000 0.000000 -1.000000", "v 0.000000 1.000000 0.000000", "o first", "usemtl m1", "f 1 2 3", "g part", "usemtl m2", "f 3 2 1"]
    src = spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "path string, seq long, line string")
    rec = assets.obj_records(src, ["seq"], blocked=False)
    d = assets.obj_materials(rec)
    lines_ = out.obj_lines(assets.obj_points(rec), assets.obj_faces(rec), materials=d.where("directive <> 'mtllib'"), libraries=d.where("directive = 'mtllib'"))
    assert [r.line for r in lines_.orderBy("sec", "pos", "sub").collect()] == text


def test_run_summary_of_two_paths_for_a_frame(spark):
    rows = spark.createDataFrame([(1, "Depth", "npy", 0, 0, 3, "b"), (1, "Depth", "npy", 0, 0, 3, "a"), (1, "Depth", "npy", 0, 0, 4, "c")], "scene int, dtype string, ext string, rig int, subcam int, frame int, path string")
    assert [r.text for r in out.run_summary(rows).collect()] == ['{"files":{"Depth":{"npy":{"0":{"0":{"0003":"a","0004":"c"}}}}},"stats":{"Max Frame":4}}']


def test_gpu_rows(spark, tmp_path):
    write(str(tmp_path), "g/nodes.txt", "n1 pvl gpu:a6000:8 257000\nn1 all gpu:a6000:8 257000\nn2 cs (null) 1000\n")
    assert [(r.node, r.gpu, r.n_gpu) for r in logs.gpu_rows(lines(spark, str(tmp_path / "g"))).collect()] == [("n1", "a6000", 8)]

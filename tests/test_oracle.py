"""Registered queries against their SQL on the smallest data; the full list runs in tools/check_oracle.py."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from jointframe.queries import load_all
from jointframe.session import Tables
from tools.check_oracle import NAMES, compare

FOLDER = "/root/testdata/sf0.001"
QUICK = """kinematic_closure world_poses seed_to_object material_class_earliest part_centroid split_dedup shard_assign valid_modes
mutation_expand object_json_scan urdf_joints obj_faces accounting_scan stage_stats trimmed_hist crash_reasons instance_boxes flow_occlusion
asof_tag relation_semi violation_report set_distance latest_state sessions start_finish_join""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES.split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    q = load_all()[name]
    assert compare(q.build(Tables(spark, FOLDER)).toPandas(), con.execute(q.sql).df()).startswith("ok")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Domain-shaped relations over the given tables.

Each adapter is one projection whose expressions mean the same in Spark and in
the SQL that checks it, so both sides start from equal rows. Eight consecutive
parts make one object; its kinematic tree is the binary heap over the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from jointframe.session import Tables


@dataclass(frozen=True)
class Adapter:
    table: str
    columns: dict[str, str]

    def __call__(self, t: Tables) -> DataFrame:
        return getattr(t, self.table).selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"(SELECT {cols} FROM {self.table})"


def _cycle(key: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} % {len(values)} {arms} ELSE {values[-1]} END"


_OBJ = "CAST(floor({k} / 8.0) AS BIGINT)"
_LABEL = "CAST({k} % 8 AS BIGINT)"

parts = Adapter("part", {
    "obj": _OBJ.format(k="p_partkey"),
    "label": _LABEL.format(k="p_partkey"),
    "name": "p_name",
    "factory": "p_type",
    "brand": "p_brand",
    "size": "CAST(p_size AS BIGINT)",
    "cents": "CAST(round(p_retailprice * 100) AS BIGINT)",
    "material": "concat(CASE WHEN p_size % 3 = 0 THEN 'Stainless Steel and ' WHEN p_size % 3 = 1 THEN "
                "'Oak ' ELSE '' END, p_name, CASE WHEN p_size % 5 = 0 THEN ' with rubber' WHEN p_size % 5 = 1 "
                "THEN ' glass' ELSE '' END)",
    "movement": "concat(p_name, CASE WHEN p_size % 4 = 0 THEN ' Rotates about its hinge' WHEN p_size % 4 = 1 "
                "THEN ' slides out' WHEN p_size % 4 = 2 THEN ' pivots but remains fixed in place' "
                "ELSE ' is part of the frame' END)",
})

# One joint per part: child link l_<label>, parent link of the heap, 'world' above label 0.
joints = Adapter("part", {
    "obj": _OBJ.format(k="p_partkey"),
    "joint": "concat('j_', CAST(p_partkey % 8 AS STRING))",
    "type": _cycle("p_size", "'revolute'", "'prismatic'", "'continuous'", "'fixed'"),
    "parent": "CASE WHEN p_partkey % 8 = 0 THEN 'world' ELSE concat('l_', CAST(CAST(floor((p_partkey % 8 - 1) "
              "/ 2.0) AS BIGINT) AS STRING)) END",
    "child": "concat('l_', CAST(p_partkey % 8 AS STRING))",
    "label": _LABEL.format(k="p_partkey"),
    "lower": "CASE WHEN p_partkey % 5 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "upper": "CAST((p_partkey * 7) % 23 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "ax0": "CASE WHEN p_partkey % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "ax1": "CASE WHEN p_partkey % 3 = 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "ax2": "CASE WHEN p_partkey % 3 = 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "o0": "CAST(p_size AS DOUBLE) / CAST(4 AS DOUBLE)",
    "o1": "CAST(p_partkey % 5 AS DOUBLE) / CAST(2 AS DOUBLE)",
    "o2": "CAST(1 AS DOUBLE)",
    "rpy0": "CAST(p_partkey % 6 AS DOUBLE) * CAST(0.3 AS DOUBLE)",
    "rpy1": "CAST(p_size % 5 AS DOUBLE) * CAST(0.2 AS DOUBLE)",
    "rpy2": "CAST(p_partkey % 7 AS DOUBLE) * CAST(0.25 AS DOUBLE)",
})

vertices = Adapter("lineitem", {
    "obj": _OBJ.format(k="l_partkey"),
    "part": _LABEL.format(k="l_partkey"),
    "ord1": "l_orderkey",
    "ord2": "CAST(l_linenumber AS BIGINT)",
    "ord3": "l_suppkey",
    "ord4": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "ord5": "l_partkey",
    "x": "CAST(round(l_quantity) AS DOUBLE)",
    "y": "CAST(round(l_discount * 100) AS DOUBLE)",
    "z": "CAST(round(l_tax * 100) AS DOUBLE)",
})
VERTEX_ORDER = ["ord1", "ord2", "ord3", "ord4", "ord5", "x", "y", "z"]

# Small frames: scene = supplier, frame = year, 8 x 8 pixels. Several fragments may fall on one pixel.
fragments = Adapter("lineitem", {
    "scene": "l_suppkey",
    "frame": "CAST(year(l_shipdate) AS BIGINT) - 1994",
    "y": "CAST(l_orderkey % 8 AS BIGINT)",
    "x": "CAST(l_partkey % 8 AS BIGINT)",
    "object_id": "CAST(l_linenumber AS BIGINT)",
    "instance_id": "CAST(l_orderkey % 3 AS BIGINT)",
    "tag": "l_returnflag",
    "depth": "CAST(round(l_quantity) AS DOUBLE)",
    "shade": "CAST(round(l_discount * 100) AS DOUBLE) / CAST(10 AS DOUBLE)",
})

jobs = Adapter("orders", {
    "job_id": "o_orderkey",
    "scene": "o_custkey",
    "stage": _cycle("o_orderkey", "'coarse'", "'populate'", "'fine'", "'render_1'", "'render_2'"),
    "state": "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END",
    "cpus": "CAST(o_orderkey % 8 + 1 AS BIGINT)",
    "gpus": "CAST(o_orderkey % 3 AS BIGINT)",
    "node": "concat('node', CAST(o_custkey % 40 AS STRING))",
    "start": "o_orderdate",
    "elapsed_s": "CAST(round(o_totalprice) AS BIGINT)",
    "priority": "o_orderpriority",
})

task_events = Adapter("events", {
    "event_id": "event_id",
    "scene": "user_id",
    "task": _cycle("event_id", "'coarse'", "'populate'", "'fine'", "'render'"),
    "ts": "ts",
    "event": "CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'running' WHEN 'click' THEN "
             "'running' WHEN 'purchase' THEN 'finished' ELSE 'failed' END",
    "value": "value",
})

# Scene objects: customers placed in the scene of their nation and hundred; the relation targets are suppliers.
scene_objects = Adapter("customer", {
    "scene": "CAST(floor(c_custkey / 50.0) AS BIGINT)",
    "obj": "c_custkey",
    "tag": "lower(c_mktsegment)",
    "active": "(c_custkey % 9 <> 0)",
    "x": "CAST((c_custkey * 13) % 47 AS DOUBLE)",
    "y": "CAST((c_custkey * 29) % 43 AS DOUBLE)",
    "z": "CAST((c_custkey * 5) % 7 AS DOUBLE)",
    "w": "CAST(1 + c_custkey % 4 AS DOUBLE)",
    "d": "CAST(1 + c_custkey % 3 AS DOUBLE)",
    "h": "CAST(1 + c_nationkey % 5 AS DOUBLE)",
    "yaw": "CAST(c_custkey % 8 AS DOUBLE) * CAST(0.7853981633974483 AS DOUBLE)",
})

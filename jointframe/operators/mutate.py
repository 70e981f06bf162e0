"""Controlled wrong variants of joints, with a record of what was changed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.functions import scalar as sc
from jointframe.operators.kinematics import joint_target, joint_value


def shifted_axis(axis: la.Vec) -> la.Vec:
    """The dominant axis (first on ties) moved on cyclically as a signed unit axis."""
    size = [F.abs(c) for c in axis]
    big = F.greatest(*size)
    which = F.when(size[0] == big, 0).when(size[1] == big, 1).otherwise(2)
    value = F.when(which == 0, axis[0]).when(which == 1, axis[1]).otherwise(axis[2])
    sign = F.when(value > 0, 1.0).otherwise(-1.0)
    return [F.when((which + 1) % 3 == i, sign).otherwise(0.0) for i in range(3)]


def with_tilted_axis(joints: DataFrame, axis: la.Vec, degrees: float = 45.0) -> DataFrame:
    """Add d0..2, the axis turned about a perpendicular: a·cos + (p × a)·sin.

    Done in steps, so that each intermediate vector is computed once.
    """
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = joints.withColumns({f"_u{i}": e for i, e in enumerate(la.normalise(axis))})
    unit = la.fields("_u", 3)
    out = out.withColumns({f"_p{i}": e for i, e in enumerate(la.perpendicular(unit))})
    across = la.cross(la.fields("_p", 3), unit)
    out = out.withColumns({f"d{i}": e for i, e in enumerate(la.add(la.scale(unit, c), la.scale(across, s)))})
    return out.drop(*[f"_{p}{i}" for p in "up" for i in range(3)])


def mutations(joints: DataFrame, keys: list[str], over: float = 2.5, detach: float = 0.5, jitter: float = 0.3) -> DataFrame:
    """One row per movable joint and mutation kind with the changed joint and a change text.

    ``invert_movers`` marks the kind that moves the complement of the moving
    parts, ``jitter_std`` the noise of the jitter kind.
    """
    axis = la.fields("ax", 3)
    out = with_tilted_axis(joints.where(F.col("type").isin(*fixed.MOVABLE)), axis).withColumn(
        "mutation", F.explode(F.array(*[F.lit(m) for m in fixed.MUTATIONS])))
    kind, slides = F.col("mutation"), F.col("type") == "prismatic"
    wrong_type, detached = kind == "wrong_joint_type", kind == "part_detach"
    factor = F.when(wrong_type, F.when(slides, 10.0).otherwise(0.1)).when(kind == "over_motion", over).otherwise(1.0)
    new_type = F.when(wrong_type, F.when(slides, "revolute").otherwise("prismatic")).when(detached, "prismatic").otherwise(F.col("type"))
    shifted, tilted = shifted_axis(axis), la.fields("d", 3)
    new_axis = [F.when(kind == "wrong_axis", s).when(kind == "wrong_direction", t).otherwise(a)
                for a, s, t in zip(axis, shifted, tilted)]
    target = joint_target(F.col("type"), F.col("lower"), F.col("upper"))
    change = (
        F.when(wrong_type | detached, F.concat(F.lit("type "), F.col("type"), F.lit(" -> "), new_type))
        .when(kind.isin("wrong_axis", "wrong_direction"), F.lit("axis"))
        .when(kind == "over_motion", F.lit("limits"))
        .when(kind == "wrong_parts_moving", F.lit("movers"))
        .otherwise(F.lit("noise"))
    )
    return out.select(
        *keys, "joint", "mutation", F.col("type").alias("old_type"), new_type.alias("type"),
        F.when(detached, 0.0).otherwise(F.col("lower") * factor).alias("lower"),
        F.when(detached, detach).otherwise(F.col("upper") * factor).alias("upper"),
        *[c.alias(f"ax{i}") for i, c in enumerate(new_axis)],
        (kind == "wrong_parts_moving").alias("invert_movers"),
        F.when(kind == "jitter", F.abs(target) * jitter).otherwise(0.0).alias("jitter_std"),
        change.alias("change"),
    )


def jittered(kind: Column, lower: Column, upper: Column, frame: Column, n_frames: int, *key: Column,
             std: float = 0.3) -> Column:
    """Joint value with keyed noise; values that are practically 0 stay."""
    base = joint_value(kind, lower, upper, frame, n_frames)
    noise = F.abs(joint_target(kind, lower, upper)) * std * sc.normal(*key, frame)
    return F.when((kind == "fixed") | (F.abs(base) < 1e-10), base).otherwise(base + noise)

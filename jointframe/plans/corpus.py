"""The corpus job: joints, parts and vertices of all objects to splits, tensors and metadata in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.operators import geometry as geo
from jointframe.operators import kinematics as kin
from jointframe.operators import splits as sp
from jointframe.session import durable

AXIS = [f"w{p}{i}" for p in "od" for i in range(3)]


@dataclass(frozen=True)
class Corpus:
    """Results per object: joints kept, split roles, active joints, tensor rows, normalisation frames."""

    joints: DataFrame
    roles: DataFrame
    active: DataFrame
    tensor: DataFrame
    frames: DataFrame


def build(joints: DataFrame, parts: DataFrame, vertices: DataFrame, threshold: float = 0.01,
          least_motion: float = fixed.MIN_NORMALISED_MOTION, faces: DataFrame | None = None) -> Corpus:
    """Closure, world axes, normalisation, motion filter, splits, collision promotion and tensors.

    ``joints`` is (obj, joint, type, parent, child, lower, upper, ax0..2, o0..2,
    rpy0..2), ``parts`` (obj, label), ``vertices`` (obj, part, x, y, z). With ``faces``
    (obj, part, face, p0..2, q0..2, s0..2) promotion compares area samples of
    them, else the vertices. Vertices are read several times; results that feed several branches are cut once.
    """
    frames = durable(geo.normal_frames(vertices, ["obj"]))
    moved = durable(kin.descendant_parts(joints, ["obj"]))
    axes = kin.world_axes(joints, kin.world_transforms(joints, ["obj"]), ["obj"]).select("obj", "joint", *AXIS)
    movable = joints.where(F.col("type").isin(*fixed.MOVABLE) & (F.abs(F.col("upper") - F.col("lower")) >= 1e-6))
    radius = geo.axis_radius(vertices, moved, axes)
    kept = geo.moving_enough(movable, radius, frames, least_motion).select("obj", "joint", "type", "lower", "upper")
    ordered = durable(sp.joint_ordinals(kept).join(axes, ["obj", "joint"]).join(frames.drop("flat"), "obj"))
    live = moved.join(ordered.select("obj", "joint"), ["obj", "joint"], "left_semi")
    moving, active = sp.build_splits(ordered.select("obj", "joint", "type", "ord"), live)
    roles, active = durable(sp.split_roles(moving, parts)), durable(active)
    asked = sp.promotable(roles, active)
    if faces is None:
        points = geo.normalise(vertices, frames, ["obj"]).select("obj", "part", *geo.AXES).distinct()
        hits = sp.contacts(durable(points), live, ordered.drop("ord"), asked, threshold)
    else:
        hits = sp.surface_contacts(faces, frames, live, ordered.drop("ord"), asked, threshold)
    roles, active = sp.promote(roles, active, live, hits)
    return Corpus(ordered, roles, active, sp.tensor_rows(active, ordered), frames)

"""Small vector and matrix algebra as Column expressions.

A vector is a list of 3 Columns, a 3x3 matrix a row-major list of 9 Columns, so
everything stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = list[Column]
Mat = list[Column]


def lits(values) -> list[Column]:
    return [F.lit(float(v)) for v in values]


IDENTITY = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def fields(prefix: str, n: int, source: Column | None = None) -> list[Column]:
    """Columns ``prefix0..``, or the fields of that name in a struct."""
    return [F.col(f"{prefix}{i}") if source is None else source[f"{prefix}{i}"] for i in range(n)]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s) -> Vec:
    return [x * s for x in a]


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalise(a: Vec, eps: float = 1e-8) -> Vec:
    """Unit vector; vectors no longer than ``eps`` stay as they are."""
    length = norm(a)
    return [F.when(length > eps, x / length).otherwise(x) for x in a]


def matvec(m: Mat, v: Vec) -> Vec:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def matmul(a: Mat, b: Mat) -> Mat:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def transpose(m: Mat) -> Mat:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def rpy_matrix(rpy: Vec) -> Mat:
    """Rz(yaw) · Ry(pitch) · Rx(roll)."""
    (cr, cp, cy), (sr, sp, sy) = [F.cos(a) for a in rpy], [F.sin(a) for a in rpy]
    # Rows of Ry · Rx; Rz then mixes the first two.
    top, middle, bottom = [cp, sp * sr, sp * cr], [F.lit(0.0), cr, -sr], [-sp, cp * sr, cp * cr]
    return [*sub(scale(top, cy), scale(middle, sy)), *add(scale(top, sy), scale(middle, cy)), *bottom]


def turn_matrix(axis: Vec, c: Column, s: Column) -> Mat:
    """Rotation about a unit axis from the cosine and sine of the angle: c·I + s·[a]x + (1 − c)·a·aᵀ."""
    x, y, z = axis
    d = 1 - c
    return [
        x * x * d + c, x * y * d - z * s, x * z * d + y * s,
        y * x * d + z * s, y * y * d + c, y * z * d - x * s,
        z * x * d - y * s, z * y * d + x * s, z * z * d + c,
    ]


def axis_angle_matrix(axis: Vec, angle: Column) -> Mat:
    return turn_matrix(axis, F.cos(angle), F.sin(angle))


def rigid_mul(a: tuple[Mat, Vec], b: tuple[Mat, Vec]) -> tuple[Mat, Vec]:
    """Composition a∘b of rigid transforms (rotation, translation)."""
    return matmul(a[0], b[0]), add(matvec(a[0], b[1]), a[1])


def about_point(rotation: Mat, origin: Vec) -> tuple[Mat, Vec]:
    """Rotation about a point as a rigid transform."""
    return rotation, sub(origin, matvec(rotation, origin))


def perpendicular(axis: Vec) -> Vec:
    """Unit vector across ``axis``, built from the world axis least aligned with it (first on ties)."""
    x, y, z = [F.abs(c) for c in axis]
    pick_x = (x <= y) & (x <= z)
    pick_y = ~pick_x & (y <= z)
    seed = [F.when(pick_x, 1.0).otherwise(0.0), F.when(pick_y, 1.0).otherwise(0.0),
            F.when(pick_x | pick_y, 0.0).otherwise(1.0)]
    return normalise(cross(axis, seed))

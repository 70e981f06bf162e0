"""Text helpers for the checking SQL: small matrix algebra written out."""

from __future__ import annotations


def of(alias: str, names: list[str]) -> list[str]:
    return [f"{alias}.{n}" for n in names]


def named(exprs: list[str], names: list[str]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names))


def add(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} + {y})" for x, y in zip(a, b)]


def _row(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"({x}) * {y}" for x, y in zip(a, b)) + ")"


def matvec(m: list[str], v: list[str]) -> list[str]:
    return [_row(m[3 * i : 3 * i + 3], v) for i in range(3)]


def matmul(a: list[str], b: list[str]) -> list[str]:
    return [_row(a[3 * i : 3 * i + 3], b[j::3]) for i in range(3) for j in range(3)]


def rpy(v: list[str]) -> list[str]:
    """Closed form of yaw · pitch · roll."""
    (cr, cp, cy), (sr, sp, sy) = [f"cos({a})" for a in v], [f"sin({a})" for a in v]
    return [
        f"{cy}*{cp}", f"{cy}*{sp}*{sr} - {sy}*{cr}", f"{cy}*{sp}*{cr} + {sy}*{sr}",
        f"{sy}*{cp}", f"{sy}*{sp}*{sr} + {cy}*{cr}", f"{sy}*{sp}*{cr} - {cy}*{sr}",
        f"-{sp}", f"{cp}*{sr}", f"{cp}*{cr}",
    ]


def axis_angle(k: list[str], angle: str) -> list[str]:
    """Closed form of a rotation about a unit axis."""
    c, s = f"cos({angle})", f"sin({angle})"
    x, y, z = k
    return [
        f"{c} + {x}*{x}*(1-{c})", f"{x}*{y}*(1-{c}) - {z}*{s}", f"{x}*{z}*(1-{c}) + {y}*{s}",
        f"{x}*{y}*(1-{c}) + {z}*{s}", f"{c} + {y}*{y}*(1-{c})", f"{y}*{z}*(1-{c}) - {x}*{s}",
        f"{x}*{z}*(1-{c}) - {y}*{s}", f"{y}*{z}*(1-{c}) + {x}*{s}", f"{c} + {z}*{z}*(1-{c})",
    ]

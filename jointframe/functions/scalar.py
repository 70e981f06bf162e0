"""Scalar expressions: hashing, seeded draws, interpolation, colour, formatting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jointframe import fixed


# -- hashing and seeded draws -------------------------------------------------------------

def stable_hash(*parts: Column) -> Column:
    """md5 of the joined parts modulo 2^32 − 1.

    2^32 is 1 modulo 2^32 − 1, so the value is the sum of the four 32-bit words of the digest.
    """
    digest = F.md5(F.concat(*[p.cast("string") for p in parts]))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return (words[0] + words[1] + words[2] + words[3]) % F.lit(4294967295)


def uniform(*key: Column) -> Column:
    """Draw in [0, 1) fixed by the key; unlike ``rand`` it survives repartitioning."""
    return stable_hash(*key) / F.lit(4294967295.0)


def uniform_between(lo, hi, *key: Column) -> Column:
    return uniform(*key) * (F.lit(hi) - F.lit(lo)) + F.lit(lo)


def normal(*key: Column) -> Column:
    """Standard normal by the Box–Muller transform on two keyed draws."""
    u = F.greatest(uniform(*key, F.lit("u")), F.lit(1e-12))
    v = uniform(*key, F.lit("v"))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def clipped_normal(mean, std, lo, hi, *key: Column) -> Column:
    return F.least(F.greatest(F.lit(mean) + F.lit(std) * normal(*key), F.lit(lo)), F.lit(hi))


def log_uniform(lo: float, hi: float, *key: Column) -> Column:
    return F.exp(uniform_between(math.log(lo), math.log(hi), *key))


def power10(lo: float, hi: float, *key: Column) -> Column:
    return F.pow(F.lit(10.0), uniform_between(float(lo), float(hi), *key))


def integer_between(lo: int, hi: int, *key: Column) -> Column:
    """Integer in [lo, hi]."""
    return (F.floor(uniform(*key) * (hi - lo + 1)) + lo).cast("bigint")


def bernoulli(p: float, *key: Column) -> Column:
    return uniform(*key) < p


def weighted_choice(options: Sequence[tuple[str, float]], *key: Column) -> Column:
    """Inverse of the cumulative weights."""
    total = sum(w for _, w in options)
    u, acc = uniform(*key), 0.0
    out = None
    for value, w in options[:-1]:
        acc += w / total
        hit = u < acc
        out = F.when(hit, value) if out is None else out.when(hit, value)
    last = F.lit(options[-1][0])
    return last if out is None else out.otherwise(last)


def wrapped_normal(mean, std, *key: Column) -> Column:
    """Normal angle in degrees wrapped into [0, 360)."""
    return F.pmod(F.lit(mean) + F.lit(std) * normal(*key), F.lit(360.0))


def sphere_elevation(lo_deg: float, hi_deg: float, *key: Column) -> Column:
    """Elevation in degrees, uniform over the sphere's area between two bounds."""
    lo, hi = math.sin(math.radians(lo_deg)), math.sin(math.radians(hi_deg))
    return F.degrees(F.asin(uniform_between(lo, hi, *key)))


# -- interpolation, rounding, arithmetic ---------------------------------------------------

def lerp(a: Column, b: Column, x: Column) -> Column:
    return a * (1 - x) + b * x


def table_lerp(values: Column, x: Column) -> Column:
    """Value of an array at a fractional 0-based index."""
    lo = F.floor(x)
    hi = F.least(lo + 1, (F.size(values) - 1).cast("bigint"))
    return lerp(F.get(values, lo.cast("int")), F.get(values, hi.cast("int")), x - lo)


def inverse_table_lerp(values: Column, d: Column) -> Column:
    """Fractional 0-based index at which an ascending table first reaches d; null outside of the table."""
    at = F.size(F.filter(values, lambda v: v < d))
    low, high = F.get(values, at - 1), F.get(values, at)
    return F.when(at == 0, F.when(d >= F.get(values, F.lit(0)), F.lit(0.0))).otherwise(at - 1 + (d - low) / (high - low))


def homogenise(p: Sequence[Column]) -> list[Column]:
    return [*p, F.lit(1.0)]


def dehomogenise(p: Sequence[Column]) -> list[Column]:
    return [x / p[-1] for x in p[:-1]]


def reflect_axis_angle(turn: Sequence[Column], n: Sequence[Column]) -> list[Column]:
    """(angle, axis) seen in a mirror with unit normal n: the axis is mirrored and the turn goes the other way."""
    angle, *axis = turn
    along = sum((a * b for a, b in zip(axis, n, strict=True)), F.lit(0.0))
    return [-angle, *[a - 2 * along * b for a, b in zip(axis, n, strict=True)]]


def smoothstep(x: Column) -> Column:
    c = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return c * c * (3 - 2 * c)


def nearest_step(x: Column, step: float) -> Column:
    return F.rint(x / step) * step


def wrap(x: Column, period: float) -> Column:
    return F.pmod(x, F.lit(period))


def rescale(x: Column, a0, a1, b0, b1) -> Column:
    return (x - a0) / (a1 - a0) * (b1 - b0) + b0


def safe_div(a: Column, b: Column) -> Column:
    """a/b with 0/0 = 0 and x/0 = 1."""
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, 0.0).otherwise(1.0)


def hinge(x: Column, low, high) -> Column:
    """Distance of x from [low, high]."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low - x, x - high, F.lit(0))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


# -- colour -------------------------------------------------------------------------------

def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """HSV in [0,1] to RGB in [0,1]."""
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))

    return [channel(5), channel(3), channel(1)]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """RGB to HSV, all in [0,1]; greys have hue 0, black also saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2.0).otherwise((r - g) / span + 4.0)
    return [F.when(span == 0, 0.0).otherwise(F.pmod(sector / 6.0, F.lit(1.0))), F.when(top == 0, 0.0).otherwise(span / top), top]


def srgb_to_linear(c: Column) -> Column:
    """Linear light of a channel; below 0 it is 0."""
    return F.when(c < 0, 0.0).when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def hex_to_rgb(text: Column) -> list[Column]:
    """'#rrggbb' to three values in [0,1]."""
    body = F.regexp_replace(text, "^#", "")
    return [F.conv(F.substring(body, 1 + 2 * i, 2), 16, 10).cast("double") / 255.0 for i in range(3)]


def label_colour(label: Column) -> list[Column]:
    """A fixed colour per label: hash-picked hue at full value."""
    return hsv_to_rgb((stable_hash(label) % 360).cast("double") / 360.0, F.lit(0.75), F.lit(1.0))


def palette_colour(components: Sequence[tuple[float, Sequence[float], Sequence[float]]], *key: Column) -> list[Column]:
    """Linear RGB from a mixture of (weight, mean hsv, row-major Cholesky factor).

    A component by weight, mean + L·z with z clipped to ±1, value kept in [0.1, 0.9].
    """
    pick = weighted_choice([(str(i), c[0]) for i, c in enumerate(components)], *key, F.lit("component")).cast("int") + 1
    z = [clamp(normal(*key, F.lit(f"z{i}")), -1.0, 1.0) for i in range(3)]
    def table(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), pick)
    hsv = []
    for i in range(3):
        shift = None
        for j in range(3):
            part = table([c[2][3 * i + j] for c in components]) * z[j]
            shift = part if shift is None else shift + part
        hsv.append(table([c[1][i] for c in components]) + shift)
    rgb = hsv_to_rgb(F.pmod(hsv[0], F.lit(1.0)), hsv[1], clamp(hsv[2], 0.1, 0.9))
    return [srgb_to_linear(clamp(c, 0.0, 1.0)) for c in rgb]


def joint_dynamics(params: Column, joint: Column) -> list[Column]:
    """stiffness, damping and friction of a joint from a map joint → map of values; 0 where missing."""
    own = F.try_element_at(params, joint)
    return [F.coalesce(F.try_element_at(own, F.lit(n)), F.lit(0.0)).alias(n) for n in ("stiffness", "damping", "friction")]


def encode_normal(n: Sequence[Column]) -> list[Column]:
    """Unit normal to 0..255; the zero normal stays 0."""
    empty = (n[0] == 0) & (n[1] == 0) & (n[2] == 0)
    return [F.when(empty, 0).otherwise(F.rint((c + 1) * 127.5).cast("int")) for c in n]


# -- text ---------------------------------------------------------------------------------

def byte_text(num: Column) -> Column:
    """Bytes with 1024 steps and one decimal."""
    out, size = None, num.cast("double")
    for i, unit in enumerate(["B", "KiB", "MiB", "GiB", "TiB"]):
        text = F.format_string(f"%.1f{unit}", F.bround(size / float(1024**i), 1))
        cond = F.abs(size) < float(1024 ** (i + 1))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.format_string("%.1fPiB", F.bround(size / float(1024**5), 1)))


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("bigint")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.format_string("%02d:%02d:%02d", hours, minutes, s % 60)


def memory_gb(text: Column) -> Column:
    """'123K', '12M', '1.5G' in gigabytes (decimal steps)."""
    num = F.regexp_extract(text, r"^([0-9.]+)[KMG]$", 1).try_cast("double")
    return F.when(text.endswith("K"), num / 1e6).when(text.endswith("M"), num / 1e3).when(text.endswith("G"), num)


def frame_suffix(rig: Column, resample: Column, frame: Column, subcam: Column) -> Column:
    return F.format_string("_%d_%d_%04d_%d", rig, resample, frame, subcam)


def seed_text(number: Column) -> Column:
    return F.lower(F.hex(number))


def snake_case(name: Column) -> Column:
    """Last path segment, CamelCase to snake_case."""
    leaf = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_replace(leaf, "(?<!^)(?=[A-Z][a-z])", "_"))


# -- names ---------------------------------------------------------------------------------

def _whole(name: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern that matches the whole name, else null."""
    return F.when(name.rlike(f"^(?:{pattern})$"), F.regexp_extract(name, f"^(?:{pattern})$", group))


def asset_name(name: Column) -> list[Column]:
    """(factory, factory seed, kind, asset seed) of the name of a spawned asset, null for other names."""
    return [_whole(name, fixed.ASSET_NAME, i) for i in range(1, 5)]


def group_name(name: Column) -> Column:
    return F.coalesce(*[_whole(name, p) for p in fixed.GROUP_NAMES])


def semantic_name(name: Column) -> Column:
    """The class of a name: its group's leading word without the factory and fineness marks, each word capitalised."""
    group = F.coalesce(group_name(name), name)
    word = F.coalesce(*[_whole(group, p) for p in fixed.SEMANTIC_NAMES])
    for mark in fixed.SEMANTIC_MARKS:
        word = F.replace(word, F.lit(mark), F.lit(""))
    return F.replace(F.initcap(F.replace(word, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


def room_name(name: Column) -> list[Column]:
    """(type, level) of a room name ``type_level/number``."""
    return [F.split_part(name, F.lit("_"), F.lit(1)), F.split_part(F.split_part(name, F.lit("/"), F.lit(1)), F.lit("_"), F.lit(2)).try_cast("bigint")]

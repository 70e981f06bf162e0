"""Annotation frames: pixel shares, boxes, occlusion, reprojection, tags, tracks.

Pixels are rows (keys…, y, x, value…). Images are read as rows only after the
columns and objects of interest are chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.functions import stats as st
from jointframe.plans.ordered import asof, neighbours, ranked
from jointframe.session import durable

PIXEL = ["y", "x"]
CAMERA = ["fx", "fy", "cx", "cy", *[f"r{i}" for i in range(9)], *[f"t{i}" for i in range(3)]]


def nearest_fragment(fragments: DataFrame, keys: Sequence[str], columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One fragment per pixel: the one with the smallest depth."""
    pick = F.min_by(F.struct("depth", *columns), F.struct("depth", *tie)).alias("_f")
    return fragments.groupBy(*keys, *PIXEL).agg(pick).select(*keys, *PIXEL, "_f.*")


def nearest_depth(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least depth per pixel, where nothing else of the fragment is asked for."""
    return fragments.groupBy(*keys, *PIXEL).agg(F.min("depth").alias("depth"))


# -- filters and statistics ---------------------------------------------------------------

def static_clips(pixels: DataFrame, keys: Sequence[str], frame: str, n_frames: int, colour: Sequence[str], alpha: str = "alpha",
                 iou_least: float = 0.98, mse_most: float = 0.001) -> DataFrame:
    """(keys…, iou, mse, static): first and middle frame compared by mask and colour; both masks empty is static."""
    mid = max(1, n_frames // 2)
    two = pixels.where(F.col(frame).isin(1, mid))
    def side(f: int) -> DataFrame:
        tag = "a" if f == 1 else "b"
        return two.where(F.col(frame) == f).select(*keys, *PIXEL, F.struct((F.col(alpha) > 0.5).alias("on"), *colour).alias(tag))
    both = side(1).join(side(mid), [*keys, *PIXEL], "full_outer")
    on = {s: F.coalesce(F.col(s)["on"], F.lit(False)) for s in "ab"}
    diff = None
    for c in colour:
        d = F.pow(F.coalesce(F.col("a")[c], F.lit(0.0)) - F.coalesce(F.col("b")[c], F.lit(0.0)), 2)
        diff = d if diff is None else diff + d
    union = on["a"] | on["b"]
    out = both.groupBy(*keys).agg(F.count_if(union).alias("_u"), F.count_if(on["a"] & on["b"]).alias("_i"),
                                  F.sum(F.when(union, diff)).alias("_d"))
    iou, mse = F.try_divide(F.col("_i").cast("double"), F.col("_u")), F.try_divide(F.col("_d"), F.col("_u") * len(colour))
    static = F.when(F.col("_u") == 0, True).when(iou < iou_least, False).otherwise(mse < mse_most)
    return out.select(*keys, F.coalesce(iou, F.lit(1.0)).alias("iou"), F.coalesce(mse, F.lit(0.0)).alias("mse"), static.alias("static"))


def dark_images(pixels: DataFrame, keys: Sequence[str], value: str, least: float = 20.0) -> DataFrame:
    """(keys…, mean, rejected, flagged): mean below 20 of 255 rejects a view, below 5 percent flags it."""
    return pixels.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumns(
        {"rejected": F.col("mean") < least, "flagged": F.col("mean") * 100.0 / 255.0 < 5})


def clean_flow(c: Column) -> Column:
    """−1 for flow that is not a number or larger than a thousand."""
    return F.when(F.isnan(c) | (F.abs(c) > 1e3), -1.0).otherwise(c)


def depth_valid(d: Column) -> Column:
    return (d > 1e-3) & (d < 1e4)


def depth_ranges(pixels: DataFrame, keys: Sequence[str], scale_low: float = 1.0) -> DataFrame:
    d = F.col("depth")
    ok = depth_valid(d)
    return pixels.groupBy(*keys).agg((F.min(F.when(ok, d)) * scale_low).alias("low"), F.max(F.when(ok, d)).alias("high"))


def depth_codes(pixels: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``code`` 0..255, linear between the range ends; invalid depth is 255."""
    span = F.col("high") - F.col("low")
    code = F.floor(F.coalesce(F.try_divide(F.col("depth") - F.col("low"), span), F.lit(0.0)) * 255)
    return pixels.join(ranges, list(keys)).withColumn("code", F.when(depth_valid(F.col("depth")), code).otherwise(255))


def shares(pixels: DataFrame, keys: Sequence[str], label: str, words: Sequence[str]) -> DataFrame:
    """(keys…, label, share): percent of pixels per dictionary label and frame; absent labels are 0.

    Pixels without a dictionary label count as ``untagged``. A frame's counts
    are folded into a map of its labels, at most one entry for each word of the
    dictionary, and what it lacks is filled in by an expression; the
    ``words`` of the dictionary are configuration and travel as literals.
    """
    named = F.when(F.col(label).isin(words), F.col(label)).otherwise("untagged").alias(label)
    counts = pixels.groupBy(*keys, named).agg(F.count("*").alias("_n"))
    frames = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(label, "_n"))).alias("_by"), F.sum("_n").alias("_all"))
    every = frames.withColumn(label, F.explode(F.array(*[F.lit(w) for w in [*words, "untagged"]])))
    return every.select(*keys, label, (100.0 * F.coalesce(F.try_element_at("_by", F.col(label)), F.lit(0)) / F.col("_all")).alias("share"))


def instance_boxes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """2-D box per key; keys without pixels have none."""
    return pixels.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def dictionary_codes(pixels: DataFrame, keys: Sequence[str], value: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Pixels with the 0-based ``code`` of their value, and the dictionary with the width of its codes in bits."""
    distinct = pixels.select(*keys, *value).distinct()
    words = ranked(distinct, keys, value, "_rn").withColumn("code", F.col("_rn") - 1).drop("_rn")
    size = words.groupBy(*keys).agg(F.count("*").alias("n"))
    width = F.when(F.col("n") <= 1 << 8, 8).when(F.col("n") <= 1 << 16, 16).otherwise(32)
    return pixels.join(words, [*keys, *value]), words.join(size.withColumn("bits", width), list(keys))


def visible(objects: DataFrame, pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects that own a pixel of their frame."""
    return objects.join(pixels.select(*keys).distinct(), list(keys), "left_semi")


def named_objects(objects: DataFrame, pixels: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Visible objects whose name contains the text in any case."""
    return visible(objects, pixels, keys).where(F.lower("name").contains(text.lower()))


def modalities(files: DataFrame, for_all: Sequence[str]) -> DataFrame:
    """Secondary cameras only keep the listed data types."""
    return files.where((F.col("cam") == 0) | F.col("dtype").isin(*for_all))


def missing_frames(files: DataFrame, spans: DataFrame, cams: Sequence[int], dtypes: Sequence[str]) -> DataFrame:
    """(scene, frame, cam, dtype) expected in the inclusive spans (scene, first, last) and not present."""
    want = spans.select("scene", F.explode(F.sequence("first", "last")).alias("frame"))
    want = want.withColumn("cam", F.explode(F.array(*[F.lit(c).cast("bigint") for c in cams])))
    want = want.withColumn("dtype", F.explode(F.array(*[F.lit(d) for d in dtypes])))
    return want.join(files, ["scene", "frame", "cam", "dtype"], "left_anti")


# -- cameras ------------------------------------------------------------------------------

def unproject(depth: Column, x: Column, y: Column, tag: str = "") -> la.Vec:
    """Camera-space point of a pixel: depth · K⁻¹ · (x, y, 1)."""
    fx, fy, cx, cy = [F.col(f"{tag}{n}") for n in CAMERA[:4]]
    return [(x - cx) / fx * depth, (y - cy) / fy * depth, depth]


def to_world(p: la.Vec, tag: str = "") -> la.Vec:
    return la.add(la.matvec(la.fields(f"{tag}r", 9), p), la.fields(f"{tag}t", 3))


def to_camera(p: la.Vec, tag: str = "") -> la.Vec:
    return la.matvec(la.transpose(la.fields(f"{tag}r", 9)), la.sub(p, la.fields(f"{tag}t", 3)))


def project(p: la.Vec, tag: str = "") -> list[Column]:
    """Pixel position and depth of a camera-space point; no position in the camera plane."""
    fx, fy, cx, cy = [F.col(f"{tag}{n}") for n in CAMERA[:4]]
    return [F.try_divide(fx * p[0], p[2]) + cx, F.try_divide(fy * p[1], p[2]) + cy, p[2]]


def tagged_camera(cams: DataFrame, keys: Sequence[str], frame: str, tag: str) -> DataFrame:
    return cams.select(*keys, F.col(frame).alias(f"{tag}_{frame}"), *[F.col(c).alias(f"{tag}{c}") for c in CAMERA])


def view_pairs(cams: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """All ordered pairs of different cameras of a scene; a scene is seen by a handful of cameras."""
    pair = tagged_camera(cams, keys, frame, "a").join(tagged_camera(cams, keys, frame, "b"), list(keys))
    return pair.where(F.col(f"a_{frame}") != F.col(f"b_{frame}"))


def _landing(rows: DataFrame, depth: Column, x: Column, y: Column, tag: str = "") -> DataFrame:
    """Add u, v (names with the tag): where a pixel of camera a lands in camera b."""
    rows = rows.withColumns({f"_w{tag}{i}": c for i, c in enumerate(to_world(unproject(depth, x, y, tag="a"), "a"))})
    rows = rows.withColumns({f"_c{tag}{i}": c for i, c in enumerate(to_camera(la.fields(f"_w{tag}", 3), "b"))})
    u, v, _ = project(la.fields(f"_c{tag}", 3), "b")
    return rows.withColumns({f"u{tag}": u, f"v{tag}": v})


def induced_flow(pixels: DataFrame, pairs: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """(keys…, a, b, y, x, u, v, fu, fv): where a pixel of camera a lands in camera b, and the flow there."""
    rows = pixels.withColumnRenamed(frame, f"a_{frame}").join(pairs, [*keys, f"a_{frame}"])
    rows = _landing(rows, F.col("depth"), F.col("x"), F.col("y"))
    return rows.select(*keys, f"a_{frame}", f"b_{frame}", *PIXEL, "u", "v", (F.col("u") - F.col("x")).alias("fu"), (F.col("v") - F.col("y")).alias("fv"))


#: Pixels along the side of a tile.
TILE = 8


#: Place of a tile in its image.
AT = ["_ty", "_tx"]


def tiles_of(image: DataFrame, keys: Sequence[str], values: Sequence[str], before: int, after: int) -> DataFrame:
    """(keys…, _ty, _tx, _tile): the image in tiles, each with its pixels' values by place.

    A tile holds its own pixels and a border of ``before`` and ``after`` pixels
    of its neighbours; a pixel stands in the image once.
    """
    wide = TILE + before + after

    def reached(c: str) -> Column:
        """The tiles along one axis that hold a pixel."""
        return F.explode(F.sequence(*[F.floor((F.col(c) + k) / TILE) for k in (-after, before)]))

    held = image.withColumn("_ty", reached("y")).withColumn("_tx", reached("x"))
    place = (F.col("y") - F.col("_ty") * TILE + before) * wide + F.col("x") - F.col("_tx") * TILE + before
    entries = F.collect_list(F.struct(place.cast("int").alias("k"), F.struct(*values).alias("v")))
    # Dealt out first: pixels of a tile come from many tasks, so partial lists would only be copied.
    return held.repartition(*keys, *AT).groupBy(*keys, *AT).agg(F.map_from_entries(entries).alias("_tile"))


def on_tiles(points: DataFrame, tiles: DataFrame, keys: Sequence[str], before: int, after: int) -> tuple[DataFrame, Callable[[int, int, str], Column]]:
    """Points (keys…, u, v) with the image tile they fall into, and a function (dx, dy, value) for the pixel so far from (⌊u⌋, ⌊v⌋).

    All that is looked up around a point is in one row of ``tiles_of``: pixels
    and points are exchanged once, and nothing is multiplied. Pixels that are
    missing or outside are null.
    """
    wide = TILE + before + after
    base = {c: F.floor(F.col(p)) for c, p in (("y", "v"), ("x", "u"))}
    placed = points.withColumns({f"_t{c}": F.floor(e / TILE) for c, e in base.items()})
    own = (base["y"] - F.col("_ty") * TILE + before) * wide + base["x"] - F.col("_tx") * TILE + before
    found = placed.join(tiles, [*keys, *AT], "left").withColumn("_own", own.cast("int")).drop(*AT)

    def pixel(dx: int, dy: int, value: str) -> Column:
        return F.try_element_at("_tile", F.col("_own") + dy * wide + dx)[value]

    return found, pixel


def bilinear(pixel: Callable[[int, int, str], Column], value: str, dx: int = 0, dy: int = 0) -> Column:
    """The image at a point of ``on_tiles``, or so many pixels from it."""
    wx, wy = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    rows = [(1 - wx) * pixel(dx, dy + k, value) + wx * pixel(dx + 1, dy + k, value) for k in (0, 1)]
    return (1 - wy) * rows[0] + wy * rows[1]


def covisibility(pixels: DataFrame, cams: DataFrame, keys: Sequence[str], frame: str, most: float = 1.0) -> DataFrame:
    """(keys…, a, b, score): share of pixels whose flow there and back misses by less than ``most`` pixels.

    Only depths are exchanged for the way back: a frame is cut into tiles once,
    its tiles meet the cameras of each pair, and the flow back is computed
    around the points that land there.
    """
    a, b = f"a_{frame}", f"b_{frame}"
    pairs = view_pairs(cams, keys, frame)
    flow = induced_flow(pixels, pairs, keys, frame).select(*keys, a, b, *PIXEL, "u", "v")
    tiles = tiles_of(pixels.select(*keys, F.col(frame).alias(a), *PIXEL, "depth"), [*keys, a], ["depth"], 0, 1).join(pairs, [*keys, a])
    tiles = tiles.select(*[F.col(c).alias({a: b, b: a}.get(c, c)) for c in tiles.columns])
    seen, pixel = on_tiles(flow, tiles, [*keys, a, b], 0, 1)
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    for dx, dy in corners:
        at = {"x": F.floor("u") + dx, "y": F.floor("v") + dy}
        seen = _landing(seen, pixel(dx, dy, "depth"), at["x"], at["y"], f"_{dx}{dy}")
        back = {f"g{e}{dx}{dy}": F.coalesce(F.col(f"{e}_{dx}{dy}") - at[c], F.lit(0.0)) for e, c in (("u", "x"), ("v", "y"))}
        seen = seen.withColumns(back)

    def missed(e: str, c: str) -> Column:
        return F.pow(bilinear(lambda dx, dy, value: F.col(f"{value}{dx}{dy}"), f"g{e}") + (F.col(e) - F.col(c)), 2)

    miss = F.sqrt(missed("u", "x") + missed("v", "y"))
    return seen.groupBy(*keys, a, b).agg((F.count_if(F.coalesce(miss < most, F.lit(False))) / F.count("*")).alias("score"))


def occlusion(pixels: DataFrame, following: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, y, x, visible): the moved pixel lies at or before the next depth at its target or one of the 4 neighbours.

    ``pixels`` has depth and flow f0 (x), f1 (y), f2 (depth), in half pixels;
    ``following`` the next depth. Targets outside the image see depth 0.
    """
    size = following.groupBy(*keys).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    moved = pixels.select(*keys, *PIXEL, (F.col("depth") + F.col("f2")).alias("target"), (F.col("x") + F.col("f0") * 2).alias("u"), (F.col("y") + F.col("f1") * 2).alias("v"))
    tiles = tiles_of(following.withColumnRenamed("depth", "next"), keys, ["next"], 1, 2)
    seen, found = on_tiles(moved.join(size, list(keys), "left"), tiles, keys, 1, 2)

    def pixel(dx: int, dy: int, value: str) -> Column:
        return F.coalesce(found(dx, dy, value), F.lit(0.0))

    hit = F.lit(False)
    for dx, dy in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)):
        inside = (F.col("u") + dx).between(0, F.col("_w")) & (F.col("v") + dy).between(0, F.col("_h"))
        hit = hit | (F.col("target") <= F.when(F.coalesce(inside, F.lit(False)), bilinear(pixel, "next", dx, dy)).otherwise(0.0))
    return seen.select(*keys, *PIXEL, ((F.col("target") >= 0) & hit).alias("visible"))


def depth_normals(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit normals n0..2 from the cross product of the steps to the right and lower neighbour. Needs both."""
    p = unproject(F.col("depth"), F.col("x"), F.col("y"))
    pts = pixels.select(*keys, *PIXEL, *[c.alias(f"p{i}") for i, c in enumerate(p)])
    def moved(dx: int, dy: int, tag: str) -> DataFrame:
        return pts.select(*keys, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), *[F.col(f"p{i}").alias(f"{tag}{i}") for i in range(3)])
    both = pts.join(moved(1, 0, "a"), [*keys, *PIXEL]).join(moved(0, 1, "b"), [*keys, *PIXEL])
    c = la.cross(la.sub(la.fields("a", 3), la.fields("p", 3)), la.sub(la.fields("b", 3), la.fields("p", 3)))
    raw = both.withColumns({f"_n{i}": e for i, e in enumerate(c)})
    n = la.normalise(la.fields("_n", 3))
    return raw.select(*keys, *PIXEL, *[e.alias(f"n{i}") for i, e in enumerate(n)])


def in_view(points: DataFrame, cams: DataFrame, keys: Sequence[str], width: float, height: float) -> DataFrame:
    """Points × cameras of their scene with pixel position, depth and an in-view flag."""
    both = points.join(cams, list(keys))
    c = to_camera([F.col(a) for a in "xyz"])
    both = both.withColumns({f"_c{i}": e for i, e in enumerate(c)})
    u, v, d = project(la.fields("_c", 3))
    both = both.withColumns({"u": u, "v": v, "d": d})
    ok = (F.col("d") > 0) & (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < width) & (F.col("v") < height)
    return both.withColumn("in_view", F.coalesce(ok, F.lit(False))).drop("_c0", "_c1", "_c2")


def view_distances(viewed: DataFrame, keys: Sequence[str], width: float, height: float, far: float, margin: float) -> DataFrame:
    """(keys…, mask, min_dist, min_vis): nearest depth and frustum distance over accepted views, 1e7 if none.

    A view accepts a point nearer than ``far`` whose distance to the clipped
    position in the frustum is below the margin.
    """
    cu, cv = F.greatest(F.least(F.col("u"), F.lit(width)), F.lit(0.0)), F.greatest(F.least(F.col("v"), F.lit(height)), F.lit(0.0))
    cd = F.greatest(F.col("d"), F.lit(0.0))
    rows = viewed.where("u is not null").withColumns({"_u": cu, "_v": cv, "_d": cd})
    clipped = to_world(unproject(F.col("_d"), F.col("_u"), F.col("_v")))
    rows = rows.withColumn("_vis", la.norm(la.sub([F.col(a) for a in "xyz"], clipped)))
    ok = (F.col("d") < far) & (F.col("_vis") < margin)
    return rows.groupBy(*keys).agg(F.bool_or(ok).alias("mask"), F.coalesce(F.min(F.when(ok, F.col("d"))), F.lit(1e7)).alias("min_dist"),
                                   F.coalesce(F.min(F.when(ok, F.col("_vis"))), F.lit(1e7)).alias("min_vis"))


def camera_quality(hits: DataFrame, keys: Sequence[str], n_pixels: int, cover: tuple[float, float], ratios: dict[str, tuple[float, float]],
                   close: float, close_most: float, nearest: float) -> DataFrame:
    """(keys…, coverage, score, keep) of camera proposals from ray hits (keys…, tag, dist)."""
    d = F.col("dist")
    out = hits.groupBy(*keys).agg(F.count("dist").alias("_n"), F.min("dist").alias("_min"), F.stddev_pop("dist").alias("_std"), F.count_if(d < close).alias("_close"),
                                  *[F.count_if(F.col("tag") == t).alias(f"_t_{t}") for t in ratios])
    coverage = F.col("_n") / float(n_pixels)
    keep = coverage.between(*cover) & (F.col("_n") > 0) & (F.col("_min") >= nearest) & (F.col("_close") / F.col("_n") <= close_most)
    for t, (lo, hi) in ratios.items():
        keep = keep & (F.col(f"_t_{t}") / float(n_pixels)).between(lo, hi)
    return out.select(*keys, coverage.alias("coverage"), (F.col("_std") + 1.5 * F.col("_min")).alias("score"), keep.alias("keep"))


def box_views(corners: DataFrame, cams: DataFrame, keys: Sequence[str], box: Sequence[str]) -> DataFrame:
    """Pixel position of the 8 corners per box and camera; boxes with a corner behind the camera are dropped.

    The depth test is one aggregate per box; nothing but eight rows meet.
    """
    rows = in_view(corners, cams, keys, 1e18, 1e18)
    front = rows.groupBy(*keys, *box).agg(F.min("d").alias("_near")).where("_near > 0").drop("_near")
    return rows.join(front, [*keys, *box], "left_semi")


def face_turn(q: Sequence[Sequence[Column]]) -> Column:
    """Cross product of the edges from the first corner of a projected face to the second and third."""
    (ax, ay), (bx, by), (cx, cy) = q
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def box_faces(views: DataFrame, box: Sequence[str]) -> DataFrame:
    """(box…, face, facing) from the projected corners (box…, corner, u, v), in whole pixels; a face seen edge-on does not face."""
    at = [F.max(F.when(F.col("corner") == k, F.struct(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))).alias(f"_c{k}") for k in range(8)]
    seen = [face_turn([(F.col(f"_c{k}.u"), F.col(f"_c{k}.v")) for k in face[:3]]) * sign < 0 for face, sign in zip(fixed.BOX_FACES, fixed.BOX_SIGNS, strict=True)]
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("face"), c.alias("facing")) for i, c in enumerate(seen)])
    return views.groupBy(*box).agg(*at).select(*box, F.inline(rows))


# -- tags, identity, tracks ---------------------------------------------------------------

def tag_ids(names: DataFrame, order: Sequence[str]) -> DataFrame:
    """(tag, id): ids 1.. by first appearance."""
    first = names.groupBy("tag").agg(F.min(F.struct(*order)).alias("_first"))
    return ranked(first.select("tag", "_first.*"), [], [*order, "tag"], "id").select("tag", "id")


def combined_tag(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), ".")


def faces_with_tags(faces: DataFrame, dictionary: DataFrame, required: Sequence[str], negated: Sequence[str] = ()) -> DataFrame:
    """Faces whose combined tag has all required and no negated names; ``dictionary`` is (id, tags)."""
    ok = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "tags")) == 0
    if negated:
        ok = ok & ~F.arrays_overlap("tags", F.array(*[F.lit(n) for n in negated]))
    return faces.join(dictionary.where(ok).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")


def mesh_identity(meshes: DataFrame) -> DataFrame:
    """(scene, name, n_verts, frame, first_frame): a mesh keeps its identity while its instances overlap those of the frame before.

    ``meshes`` is (scene, frame, name, n_verts, instance). A mesh of a frame
    that shares no instance with the same (name, n_verts) one frame earlier
    starts anew; the identity is the frame of the latest start.
    """
    keys = ["scene", "name", "n_verts"]
    own = meshes.select(*keys, "frame", "instance").distinct()
    before = own.withColumn("frame", F.col("frame") + 1)
    linked = own.join(before, [*keys, "frame", "instance"], "left_semi").select(*keys, "frame").distinct()
    all_ = own.select(*keys, "frame").distinct()
    starts = all_.join(linked, [*keys, "frame"], "left_anti").select(*keys, F.col("frame").alias("_at"), F.col("frame").alias("first_frame"))
    probes = all_.select(*keys, F.col("frame").alias("_at"), F.col("frame").alias("_id"))
    return asof(probes, starts, keys, "_at", "first_frame", "_id").select(*keys, F.col("_at").alias("frame"), "first_frame")


def keyframe_values(keys_: DataFrame, frames: DataFrame, ident: Sequence[str]) -> DataFrame:
    """(ident…, frame, value, slope): channel values between keyframes.

    ``keys_`` is (ident…, at, value, interp, h1x, h1y, h2x, h2y), where h1 is
    the handle after this key and h2 the one before the next. CONSTANT holds,
    LINEAR goes straight, BEZIER follows the cubic. Before the first and after
    the last key the value holds. ``frames`` is (ident…, frame).
    """
    nxt = neighbours(keys_, ident, ["at"], {"_at1": "at", "_v1": "value"}, ahead=True)
    seg = F.struct("at", "value", "interp", "h1x", "h1y", "h2x", "h2y", F.col("_at1").alias("at1"), F.col("_v1").alias("v1"))
    facts = nxt.select(*ident, F.col("at").cast("double").alias("_t"), seg.alias("seg"))
    first = keys_.groupBy(*ident).agg(F.min_by("value", "at").alias("_first"))
    probes = frames.select(*ident, F.col("frame").cast("double").alias("_t"), "frame")
    hit = asof(probes, facts, ident, "_t", "seg", "frame").join(first, list(ident))
    s, t = F.col("seg"), F.col("_t")
    inside = s["at1"].isNotNull()
    slope = F.when(inside & (s["interp"] == "LINEAR"), (s["v1"] - s["value"]) / (s["at1"] - s["at"])).otherwise(0.0)
    curved = inside & (s["interp"] == "BEZIER")
    curve = st.bezier_value(F.when(curved, t), *[F.coalesce(c.cast("double"), F.lit(0.0)) for c in (
        s["at"], s["h1x"], s["h2x"], s["at1"], s["value"], s["h1y"], s["h2y"], s["v1"])])
    value = (F.when(s.isNull(), F.col("_first")).when(curved, curve)
             .otherwise(s["value"] + slope * (t - s["at"])))
    return hit.select(*ident, F.col("frame").cast("bigint").alias("frame"), value.alias("value"), slope.alias("slope"))


def clean_tracks(points: DataFrame, ident: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Points of tracks that have a number in every frame."""
    bad = None
    for v in values:
        b = F.isnan(v) | F.col(v).isNull()
        bad = b if bad is None else bad | b
    broken = points.where(bad).select(*ident).distinct()
    return points.join(broken, list(ident), "left_anti")


def grid_tracks(steps: DataFrame, keys: Sequence[str], height: int, width: int, side: int = fixed.TRACK_GRID, margin: int = fixed.TRACK_MARGIN) -> DataFrame:
    """(keys…, gy, gx, frame, x, y): tracks that start on an even grid of ``side`` by ``side`` points of an image.

    ``steps`` is (keys…, frame, row, col, dx, dy) with twice the image's resolution in row and col. Tracks without
    a number in some frame leave as a whole. The grid has side² rows whatever the data.
    """
    def at(size: int) -> list[int]:
        return [int(margin + i / (side - 1) * (size - 2 * margin)) for i in range(side)]
    grid = steps.sparkSession.createDataFrame([(y, x, 2 * y, 2 * x) for y in at(height) for x in at(width)], "gy long, gx long, row long, col long")
    placed = steps.join(F.broadcast(grid.distinct()), ["row", "col"]).select(*keys, "gy", "gx", "frame", (F.col("gx") + F.col("dx")).alias("x"), (F.col("gy") + F.col("dy")).alias("y"))
    return clean_tracks(placed, [*keys, "gy", "gx"], ["x", "y"])


def block_size(folders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, first, last, block): frame bounds and the step between the first two frame folders."""
    w = Window.partitionBy(*keys).orderBy("frame")
    distinct = folders.select(*keys, "frame").distinct()
    two = distinct.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").groupBy(*keys).agg((F.max("frame") - F.min("frame")).alias("block"))
    return distinct.groupBy(*keys).agg(F.min("frame").alias("first"), F.max("frame").alias("last")).join(two, list(keys))

"""Body / moving splits, collision promotion, joint tensors, consistency checks.

A split is kept as rows (obj, key, label), so no set is ever gathered in one
task; sets are compared through their size and two 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.functions import points as pts
from jointframe.operators import geometry as geo
from jointframe.plans.ordered import ranked
from jointframe.session import durable


def joint_ordinals(joints: DataFrame) -> DataFrame:
    """Add ``ord`` 0.. by joint name inside each object."""
    return ranked(joints, ["obj"], ["joint"], "ord").withColumn("ord", F.col("ord") - 1)


def candidate_splits(ordered: DataFrame, moved: DataFrame) -> DataFrame:
    """(obj, key, prio, joint, label): every part that moves under every possible split.

    default moves all joints, anim0/1/2 one joint type, anim<10+i> the i-th
    joint of an object with several.
    """
    # An object has several joints if it has one of ordinal 1.
    several = ordered.where("ord = 1").select("obj", F.lit(True).alias("_s"))
    mode = F.create_map(*[x for k, v in fixed.TYPE_MODES.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    def entry(key: Column, prio: Column) -> Column:
        return F.struct(key.alias("key"), prio.cast("bigint").alias("prio"))
    own = entry(F.concat(F.lit("anim"), (F.col("ord") + 10).cast("string")), F.col("ord") + 10)
    keys = F.array_compact(F.array(
        entry(F.lit("default"), F.lit(0)),
        entry(F.concat(F.lit("anim"), mode.cast("string")), mode + 1),
        F.when(F.col("_s"), own),
    ))
    per_joint = ordered.join(several, "obj", "left").select("obj", "joint", keys.alias("_k"))
    # Multiplied last. These rows compress well: by their bytes on disk, a table of millions would be sent to every task.
    met = moved.join(per_joint.hint("merge"), ["obj", "joint"]).select("obj", "joint", "label", F.explode("_k").alias("_k"))
    return met.select("obj", "_k.*", "joint", "label")


def build_splits(ordered: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moving parts (obj, key, label) and active joints (obj, key, joint) of the kept splits.

    Of several splits with one moving set, the first in priority stays.
    """
    rows = candidate_splits(ordered, moved)
    sets = rows.select("obj", "key", "prio", "label").distinct()
    digest = sets.groupBy("obj", "key", "prio").agg(
        F.count("*").alias("_n"),
        F.bit_xor(F.xxhash64("label")).alias("_d1"),
        F.bit_xor(F.xxhash64("label", F.lit("second"))).alias("_d2"),
    )
    kept = digest.groupBy("obj", "_n", "_d1", "_d2").agg(F.min_by("key", "prio").alias("key")).select("obj", "key")
    moving = sets.join(kept, ["obj", "key"], "left_semi").select("obj", "key", "label")
    active = rows.select("obj", "key", "joint").distinct().join(kept, ["obj", "key"], "left_semi")
    return moving, active


def split_roles(moving: DataFrame, parts: DataFrame) -> DataFrame:
    """(obj, key, label, role): body = all parts minus the moving ones."""
    keys = moving.select("obj", "key").distinct()
    every = keys.join(parts.select("obj", "label").distinct(), "obj")
    flag = moving.withColumn("_m", F.lit(True))
    return every.join(flag, ["obj", "key", "label"], "left").select(
        "obj", "key", "label", F.when(F.col("_m"), "moving").otherwise("body").alias("role"))


FRACTIONS = (0.5, 0.75, 1.0)


def joint_poses(joints: DataFrame, fractions: tuple[float, ...] = FRACTIONS, keep: Sequence[str] = ()) -> DataFrame:
    """(obj, joint, keep…, r0..8, t0..2): how points in normalised space move with a joint at fractions of its full range.

    ``joints`` carries type, range, axis origin wo0..2 and direction wd0..2, and the frame mx, my, mz, scale.
    """
    span = F.abs(F.col("upper") - F.col("lower"))
    at = joints.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in fractions]))).select(
        "obj", "joint", *keep, (F.col("type") == "prismatic").alias("_slides"), (span * F.col("_f")).alias("_q"), "scale",
        *[c.alias(f"a{i}") for i, c in enumerate(la.normalise(la.fields("wd", 3)))],
        *[((F.col(f"wo{i}") - F.col(f"m{a}")) * F.col("scale")).alias(f"p{i}") for i, a in enumerate(geo.AXES)],
    )
    turn = F.when(F.col("_slides"), 0.0).otherwise(F.col("_q"))
    at = at.withColumns({"_c": F.cos(turn), "_s": F.sin(turn)})
    axis = la.fields("a", 3)
    at = at.select("obj", "joint", *keep, "_slides", "_q", "scale", *[f"a{i}" for i in range(3)], *[f"p{i}" for i in range(3)],
                   *[c.alias(f"r{i}") for i, c in enumerate(la.turn_matrix(axis, F.col("_c"), F.col("_s")))])
    # One small matrix per joint and fraction is finished here, before it meets the points.
    _, about = la.about_point(la.fields("r", 9), la.fields("p", 3))
    slide = la.scale(axis, F.col("_q") * F.col("scale"))
    return at.select("obj", "joint", *keep, *[f"r{i}" for i in range(9)],
                     *[F.when(F.col("_slides"), m).otherwise(b).alias(f"t{i}") for i, (m, b) in enumerate(zip(slide, about))])


def posed_points(points: DataFrame, moved: DataFrame, joints: DataFrame,
                 fractions: tuple[float, ...] = FRACTIONS, within: bool = False) -> DataFrame:
    """Points (obj, joint, x, y, z) of a joint's parts at fractions of its full range.

    ``joints`` is that of ``joint_poses``; points are in normalised space. With ``within``
    it also has a box lo_x..hi_z, and points that leave it are dropped.
    """
    ends = [f"{e}_{a}" for a in geo.AXES for e in ("lo", "hi")] if within else []
    at = joint_poses(joints, fractions, ends)
    rows = points.withColumnRenamed("part", "label").join(moved.join(at, ["obj", "joint"]), ["obj", "label"])
    posed = la.add(la.matvec(la.fields("r", 9), geo.xyz()), la.fields("t", 3))
    out = rows.select("obj", "joint", *ends, *[c.alias(a) for c, a in zip(posed, geo.AXES)])
    for a in geo.AXES if within else ():
        out = out.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return out.select("obj", "joint", *geo.AXES)


def promotable(roles: DataFrame, active: DataFrame) -> DataFrame:
    """(obj, joint, label): the pairs whose contact ``promote`` asks for, an active joint and a body part of one split."""
    bodies = roles.where("role = 'body'").select("obj", "key", "label")
    return active.where("key <> 'default'").join(bodies, ["obj", "key"]).select("obj", "joint", "label").distinct()


#: Ends of the shares of the points that are posed in the rounds of ``contacts``, in 64ths.
ROUNDS = (4, 16, 64)


def contacts(points: DataFrame, moved: DataFrame, joints: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (obj, joint, label) with a posed point of the joint closer than the threshold to a resting point of the label.

    One contact settles a pair, so a sixteenth of the points is posed first,
    and more of them only for joints with pairs that are still open; in the last
    round all have been. Posed points outside the object's box touch nothing.
    ``points`` (obj, part, x, y, z) is read several times.
    """
    key = ["obj", "joint", "label"]
    rest = points.withColumnRenamed("part", "label")
    bounds = geo.boxes(points, ["obj"])
    bounds = bounds.select("obj", *[(F.col(f"{e}_{a}") + s * threshold).alias(f"{e}_{a}") for e, s in (("lo", -1), ("hi", 1)) for a in geo.AXES])
    boxed = durable(joints.join(bounds, "obj"))
    share = F.pmod(F.xxhash64(*geo.AXES), F.lit(64))
    open_, found, low = durable(pairs), [], 0
    for high in ROUNDS:
        some = points.where((share >= low) & (share < high))
        posed = durable(posed_points(some, moved.join(open_.select("obj", "joint").distinct(), ["obj", "joint"], "left_semi"), boxed, within=True))
        asked = rest if not low else durable(rest.join(open_.select("obj", "label").distinct(), ["obj", "label"], "left_semi"))
        found.append(durable(geo.near_in_cells(asked, posed, ["obj"], "label", "joint", threshold, among=open_).select(*key)))
        open_, low = durable(open_.join(found[-1], key, "left_anti")), high
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


#: Objects with at most so many points, counted once for each joint that moves them and each that may touch them, are done whole by one task.
WHOLE = 1 << 19


def surface_contacts(triangles: DataFrame, frames: DataFrame, moved: DataFrame, joints: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``contacts`` over area samples of the triangles (obj, part, face, p0..2, q0..2, s0..2) in the frames of their objects.

    Samples are many times the triangles. So the triangles and joints of an object meet in one task, which
    draws, poses and compares its points there, and no point is exchanged or written. Objects too large
    for that have their points written and compared in cells.
    """
    keep = ["obj", "part"]
    faces = durable(geo.sample_counts(triangles, keep, "face"), ended=True)
    asked = durable(pairs)
    moving = durable(moved.join(asked.select("obj", "joint").distinct(), ["obj", "joint"], "left_semi"))
    sizes = faces.groupBy("obj", F.col("part").alias("label")).agg(F.sum("_n").alias("_n"))
    work = moving.unionByName(asked).join(sizes, ["obj", "label"]).groupBy("obj").agg(F.sum("_n").alias("_n"))
    large = durable(work.where(F.col("_n") > WHOLE).select("obj"), ended=True)
    if large.isEmpty():
        return durable(_contacts_by_object(faces, frames, moving, joints, asked, threshold), ended=True)
    few, many = [[df.join(large, "obj", kind) for df in (faces, frames, moving, joints, asked)] for kind in ("left_anti", "left_semi")]
    whole = durable(_contacts_by_object(*few, threshold), ended=True)
    # Frames join the faces, which are few, and not the points.
    points = geo.in_frame(geo.drawn_points(many[0].join(many[1], "obj"), keep, "face", carry=geo.FRAME), keep)
    return whole.unionByName(contacts(durable(points), *many[2:], threshold))


def _contacts_by_object(faces: DataFrame, frames: DataFrame, moved: DataFrame, joints: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The contacts of objects that one task can hold, each object in one call."""
    poses = joint_poses(joints.join(pairs.select("obj", "joint").distinct(), ["obj", "joint"], "left_semi"))
    poses = poses.select("obj", "joint", F.array(*la.fields("r", 9), *la.fields("t", 3)).alias("pose"))
    links = frames.select("obj", F.struct(*geo.FRAME).alias("frame"))
    for rows in (poses, *[df.select("obj", "joint", "label", F.lit(a).alias("asked")) for df, a in ((moved, False), (pairs, True))]):
        links = links.unionByName(rows, True)
    # Points are drawn in the task, so tasks are not to be joined to few by the bytes of the faces.
    tasks = int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ident = F.concat(*[F.col(c).cast("string") for c in ("obj", "part", "face")]).alias("_ident")
    dealt = faces.repartition(tasks, "obj").select("obj", "part", "_n", ident, *[f"{c}{i}" for c in "pqs" for i in range(3)])
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    met = dealt.groupBy("obj").cogroup(links.repartition(tasks, "obj").groupBy("obj"))
    return met.applyInArrow(_object_contacts(threshold), ", ".join(f"{c} {kind[c]}" for c in ("obj", "joint", "label")))


def _object_contacts(threshold: float):
    """A function of the faces and links of one object that tells its contacts."""
    def run(faces: pa.Table, links: pa.Table) -> pa.Table:
        frame = next((f for f in links.column("frame").to_pylist() if f), None)
        links = links.filter(links.column("joint").is_valid()).combine_chunks()
        none = links.slice(0, 0).select(["obj", "joint", "label"])
        if not faces.num_rows or not links.num_rows or not frame:
            return none
        name = links.column("joint").combine_chunks().dictionary_encode()
        joint, is_pose = name.indices.to_numpy(), links.column("label").is_null().to_numpy()
        part = faces.column("part").to_numpy()
        labels = np.unique(part)
        wanted = links.column("label").fill_null(0).to_numpy()
        # Labels by number; links to parts without faces have no points to meet.
        at = np.searchsorted(labels, wanted).clip(max=len(labels) - 1)
        linked = ~is_pose & (labels[at] == wanted)
        asks = linked & links.column("asked").fill_null(False).to_numpy()
        moves = linked & ~asks
        if not asks.any() or not moves.any():
            return none
        poses = links.column("pose").combine_chunks().drop_null().flatten().to_numpy().reshape(-1, 12)
        posing = joint[is_pose]
        needed = np.zeros(len(labels), bool)
        needed[at[linked]] = True
        faces = faces.filter(pa.array(needed[np.searchsorted(labels, part)])).combine_chunks()
        row, xyz = geo.drawn_in_frame(faces, faces.column("_ident").combine_chunks(), frame)
        label = np.searchsorted(labels, faces.column("part").to_numpy())[row]
        rests = np.zeros(len(labels), bool)
        rests[at[asks]] = True
        still = rests[label]
        resting = pts.Resting(xyz[:, still], label[still], len(labels), threshold)
        found: list[tuple[int, int]] = []
        for j in np.unique(joint[asks]):
            mine, asked = np.zeros((2, len(labels)), bool)
            mine[at[moves & (joint == j)]], asked[at[asks & (joint == j)]] = True, True
            posed = xyz[:, mine[label]]
            r = poses[posing == j]
            posed = np.stack([((r[:, 3 * i, None] * posed[0] + r[:, 3 * i + 1, None] * posed[1] + r[:, 3 * i + 2, None] * posed[2]) + r[:, 9 + i, None]).ravel() for i in range(3)])
            found += [(j, k) for k in np.flatnonzero(resting.touched(posed, asked))]
        ids = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"obj": pa.repeat(links.column("obj")[0], len(ids)), "joint": name.dictionary.take(pa.array(ids[:, 0])), "label": pa.array(labels[ids[:, 1]], links.schema.field("label").type)})
    return run


def promote(roles: DataFrame, active: DataFrame, moved: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles and active joints after collision promotion.

    ``hits`` is (obj, joint, label): posed parts of ``joint`` touch the resting
    part ``label``. A passive joint that owns a hit body part of a split gives
    all its body parts to the moving side and becomes active. The default
    split stays.
    """
    extra = active.where("key <> 'default'")
    touched = (
        extra.join(hits, ["obj", "joint"]).select("obj", "key", "label").distinct()
        .join(roles.where("role = 'body'").select("obj", "key", "label"), ["obj", "key", "label"], "left_semi")
    )
    owners = moved.withColumnRenamed("joint", "owner")
    passive = (
        touched.join(owners, ["obj", "label"]).select("obj", "key", F.col("owner").alias("joint")).distinct()
        .join(active, ["obj", "key", "joint"], "left_anti")
    )
    gained = passive.join(moved, ["obj", "joint"]).select("obj", "key", "label").distinct().withColumn("_p", F.lit(True))
    new_roles = roles.join(gained, ["obj", "key", "label"], "left").select(
        "obj", "key", "label", F.when(F.col("_p"), "moving").otherwise(F.col("role")).alias("role"))
    return new_roles, active.unionByName(passive)


def tensor_rows(active: DataFrame, joints: DataFrame) -> DataFrame:
    """Joint tensor as rows (obj, key, slot, c0..c11), slots in joint order, all of them.

    Columns: normalised origin, unit direction, one-hot type, range from 0, exists flag.
    """
    w = Window.partitionBy("obj", "key").orderBy("ord")
    origin = [(F.col(f"wo{i}") - F.col(f"m{a}")) * F.col("scale") for i, a in enumerate(geo.AXES)]
    hot = [(F.col("type") == k).cast("double") for k in fixed.MOVABLE]
    cells = [*origin, *la.fields("wd", 3), *hot, F.lit(0.0), F.abs(F.col("upper") - F.col("lower")), F.lit(1.0)]
    return (
        active.join(joints, ["obj", "joint"]).withColumn("_rn", F.row_number().over(w))
        .select("obj", "key", (F.col("_rn") - 1).cast("bigint").alias("slot"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    )


def tensors(rows: DataFrame, n_max: int = 8) -> DataFrame:
    """(obj, key, tensor): fixed [n_max, 12] float arrays, zero padded. The file format ends at n_max rows; ``tensor_rejects`` has the others."""
    rows = rows.where(F.col("slot") < n_max)
    row = F.array(*[F.col(f"c{i}").cast("float") for i in range(12)])
    listed = rows.groupBy("obj", "key").agg(F.array_sort(F.collect_list(F.struct("slot", row.alias("row")))).alias("_l"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), 12), n_max)
    filled = F.slice(F.concat(F.transform("_l", lambda s: s["row"]), zero), 1, n_max)
    return listed.select("obj", "key", filled.alias("tensor"))


def tensor_rejects(rows: DataFrame, n_max: int = 8) -> DataFrame:
    """Rows that do not fit the file format."""
    return rows.where(F.col("slot") >= n_max)


def text_mismatches(roles: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts of the default split whose role and movement text disagree.

    ``parts`` is (obj, label, is_moving).
    """
    both = roles.where("key = 'default'").join(parts, ["obj", "label"])
    moving = F.col("role") == "moving"
    kind = F.when(moving & ~F.col("is_moving"), "moving_but_text_static").when(~moving & F.col("is_moving"), "static_but_text_moving")
    return both.select("obj", "label", kind.alias("kind")).where("kind is not null")

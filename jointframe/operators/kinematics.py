"""Kinematic graphs: closures, depths, world transforms, forward kinematics.

Edges are rows of (keys…, parent, child); a child has one parent inside its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import linalg as la
from jointframe.plans.ordered import ranked
from jointframe.plans.recursion import all_above, below_roots, depths, fold_down, path_order
from jointframe.session import durable


def roots(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links that are a parent and never a child."""
    parents = edges.select(*keys, F.col("parent").alias("link")).distinct()
    children = edges.select(*keys, F.col("child").alias("link"))
    return parents.join(children, [*keys, "link"], "left_anti")


def edge_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every edge with the edge above it (null at a root)."""
    above = edges.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("grandparent"))
    return edges.join(above, [*keys, "parent"], "left")


def ancestor_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, node, ancestor, dist) for every strict ancestor; cycles end."""
    return all_above(edges, keys)


def links_of(edges: DataFrame, keys: Sequence[str], *columns: Column | str) -> DataFrame:
    """(keys…, node, up, columns…): the child links as nodes, ``up`` null below a root."""
    return below_roots(edges.select(*keys, F.col("child").alias("node"), F.col("parent").alias("up"), *columns), keys)


def descendant_parts(joints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, joint, label): the parts moved by each joint, its own child link included.

    A part link is named ``l_<label>``; helper links carry no part.
    """
    edges = joints.select(*keys, "parent", "child")
    pairs = ancestor_pairs(edges, keys).select(*keys, "node", F.col("ancestor").alias("link"))
    own = joints.select(*keys, F.col("child").alias("node"), F.col("child").alias("link"))
    under = own.unionByName(pairs)
    named = under.withColumn("label", F.regexp_extract("node", r"^l_(\d+)$", 1).try_cast("bigint"))
    by_link = joints.select(*keys, "joint", F.col("child").alias("link"))
    return by_link.join(named.where("label is not null"), [*keys, "link"]).select(*keys, "joint", "label")


def movable(joints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joints of a movable type, with a range and at least one part below them."""
    kept = joints.where(F.col("type").isin(*fixed.MOVABLE) & (F.abs(F.col("upper") - F.col("lower")) >= 1e-6))
    return kept.join(descendant_parts(joints, keys).select(*keys, "joint").distinct(), [*keys, "joint"], "left_semi")


def significant(joints: DataFrame) -> DataFrame:
    """Joints whose range is large enough to be seen."""
    span = F.abs(F.col("upper") - F.col("lower"))
    least = F.when(F.col("type") == "prismatic", fixed.MIN_PRISMATIC_RANGE).otherwise(fixed.MIN_ROTARY_RANGE)
    return joints.where(F.col("type").isin(*fixed.MOVABLE) & (span >= least))


def link_depth(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, node, depth): number of joints between a link and its root; links of a cycle have none."""
    return depths(links_of(edges, keys), keys)


POSE = [f"r{i}" for i in range(9)] + [f"t{i}" for i in range(3)]


def _chained(upper, lower) -> list[Column]:
    """The pose of a frame inside another one."""
    m, v = la.rigid_mul(*[([of(f"r{i}") for i in range(9)], [of(f"t{i}") for i in range(3)]) for of in (upper, lower)])
    return [*m, *v]


def world_transforms(joints: DataFrame, keys: Sequence[str], use_rpy: bool = True) -> DataFrame:
    """World pose of every child link: rotation r0..r8 (row major) and translation t0..t2."""
    turn = la.rpy_matrix(la.fields("rpy", 3)) if use_rpy else la.lits(la.IDENTITY)
    own = [c.alias(p) for c, p in zip([*turn, *la.fields("o", 3)], POSE)]
    return fold_down(links_of(joints, keys, *own), keys, POSE, _chained).withColumnRenamed("node", "link")


def world_axes(joints: DataFrame, poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joints with world axis origin wo0..2 and unit direction wd0..2.

    Origin and direction live in the parent's frame; parents without a pose are roots.
    """
    frame = poses.select(*keys, F.col("link").alias("parent"), *[f"r{i}" for i in range(9)], *[f"t{i}" for i in range(3)])
    joined = joints.join(frame, [*keys, "parent"], "left")
    m = [F.coalesce(c, i) for c, i in zip(la.fields("r", 9), la.lits(la.IDENTITY))]
    t = [F.coalesce(c, F.lit(0.0)) for c in la.fields("t", 3)]
    origin = la.add(t, la.matvec(m, la.fields("o", 3)))
    direction = la.normalise(la.matvec(m, la.normalise(la.fields("ax", 3))))
    return joined.select(
        *[joints[c] for c in joints.columns if c not in (*keys, "parent")], *keys, "parent",
        *[c.alias(f"wo{i}") for i, c in enumerate(origin)], *[c.alias(f"wd{i}") for i, c in enumerate(direction)],
    )


def joint_target(kind: Column, lower: Column, upper: Column) -> Column:
    """The limit of larger magnitude (upper on ties); 1 for a continuous joint without range; 0 if fixed."""
    far = F.when(F.abs(upper) >= F.abs(lower), upper).otherwise(lower)
    return (
        F.when(kind.isin("revolute", "prismatic"), far)
        .when((kind == "continuous") & (F.abs(upper - lower) > 1e-6), far)
        .when(kind == "continuous", 1.0)
        .otherwise(0.0)
    )


def joint_value(kind: Column, lower: Column, upper: Column, frame: Column, n_frames: int) -> Column:
    """Round trip 0 → target → 0 over the frames 1..n."""
    t = (frame - 1) / float(max(n_frames - 1, 1))
    return F.sin(t * F.pi()) * joint_target(kind, lower, upper)


#: Rounds of doubling before frames are multiplied: a row then holds the motions of the last 2^3 joints.
CHAIN_ROUNDS = 3


def joint_chains(links: DataFrame, keys: Sequence[str], motion: Sequence[str], rounds: int = CHAIN_ROUNDS) -> DataFrame:
    """(keys…, node, up, path): the last 2^rounds joints down to each link, uppermost first; ``up`` is the link above them, null from a root on."""
    chains = links.select(*keys, "node", "up", F.array(F.struct(*motion)).alias("path"))
    for _ in range(rounds):
        if chains.where("up IS NOT NULL").isEmpty():
            break
        above = chains.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_path"))
        longer = F.coalesce(F.concat("_path", "path"), "path").alias("path")
        chains = durable(chains.join(above, [*keys, "up"], "left").select(*keys, "node", F.col("_next").alias("up"), longer))
    return chains


def _moved(joint: Column, frame: Column, n_frames: int, value) -> tuple[Column, list[Column], list[Column]]:
    """A joint's turn, axis and shift at a frame."""
    q = value(joint["type"], joint["lower"], joint["upper"], frame, n_frames)
    turn = F.when(joint["type"].isin("revolute", "continuous"), q).otherwise(0.0)
    slide = F.when(joint["type"] == "prismatic", q).otherwise(0.0)
    axis = la.fields("ax", 3, joint)
    return turn, axis, la.add(la.fields("o", 3, joint), la.scale(axis, slide))


def forward_kinematics(joints: DataFrame, keys: Sequence[str], n_frames: int, value=joint_value) -> DataFrame:
    """World translation t0..t2 and rotation r0..r8 of every link at the frames 1..n.

    The joints above each link are gathered first, without frames; frames are
    multiplied last, so none is exchanged or written. Links deeper than a row's
    joints are folded on in rounds of doubled distance, frame by frame.
    ``value(kind, lower, upper, frame, n)`` may be any Column-valued function.
    """
    axis = [c.alias(f"ax{i}") for i, c in enumerate(la.normalise(la.fields("ax", 3)))]
    motion = ["type", "lower", "upper", *[f"o{i}" for i in range(3)], *[f"ax{i}" for i in range(3)]]
    links = durable(links_of(joints, keys, *motion[:6], *axis))
    chains = joint_chains(links, keys, motion)
    deep = chains.where("up IS NOT NULL").select(*keys).distinct()
    if deep.isEmpty():
        return _posed_chains(chains, keys, n_frames, value).drop("up").withColumnRenamed("node", "link")
    # Only trees with a link that deep are folded frame by frame.
    shallow, below = [chains.join(deep, list(keys), kind) for kind in ("left_anti", "left_semi")] if keys else [chains.limit(0), chains]
    folded = fold_down(_posed_chains(below, keys, n_frames, value), [*keys, "frame"], POSE, _chained)
    return _posed_chains(shallow, keys, n_frames, value).drop("up").unionByName(folded).withColumnRenamed("node", "link")


def _posed_chains(chains: DataFrame, keys: Sequence[str], n_frames: int, value) -> DataFrame:
    """(keys…, frame, node, up, pose): the motions of each row's joints at the frames 1..n, folded into one pose."""
    longest = chains.agg(F.max(F.size("path"))).first()[0] or 1
    # Frames make many rows of one, so a small table is dealt out to all tasks first.
    tasks = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chains.repartition(tasks, *keys, "node").withColumn("frame", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_frames).cast("bigint"))))
    # The first joint's pose, then one more joint a step; rows with fewer joints stay as they are.
    for i in range(longest):
        turn, ax, shift = _moved(F.get("path", F.lit(i)), F.col("frame"), n_frames, value)
        rows = rows.withColumns({"_c": F.cos(turn), "_s": F.sin(turn), **{f"_a{k}": c for k, c in enumerate(ax)}, **{f"_t{k}": c for k, c in enumerate(shift)}})
        own = dict(zip(POSE, [*la.turn_matrix(la.fields("_a", 3), F.col("_c"), F.col("_s")), *la.fields("_t", 3)]))
        if i == 0:
            rows = rows.withColumns(own)
            continue
        rows = rows.withColumns({f"_own_{p}": c for p, c in own.items()})
        chained = _chained(F.col, lambda p: F.col(f"_own_{p}"))
        rows = rows.withColumns({p: F.when(F.size("path") > i, c).otherwise(F.col(p)) for p, c in zip(POSE, chained)})
    return rows.select(*keys, "frame", "node", "up", *POSE)


def frozen_links(edges: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Links strictly below a chosen joint's child link; used when one selector picked several joints."""
    pairs = ancestor_pairs(edges, keys)
    heads = chosen.select(*keys, F.col("child").alias("ancestor")).distinct()
    return pairs.join(heads, [*keys, "ancestor"], "left_semi").select(*keys, F.col("node").alias("link")).distinct()


def breadth_first_numbers(edges: DataFrame, keys: Sequence[str], sibling: str) -> DataFrame:
    """(keys…, link, depth, number): links numbered 0.. by depth, then by the siblings on the way down."""
    placed = path_order(links_of(edges, keys, sibling), keys, sibling).withColumnRenamed("node", "link")
    return ranked(placed, keys, ["depth", "name", "link"], "_rn").select(*keys, "link", "depth", (F.col("_rn") - 1).alias("number"))

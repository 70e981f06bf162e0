"""Work planning: job lists, modes, selectors, shards, completeness, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.operators.kinematics import significant
from jointframe.plans.ordered import ranked, running_sum


def generated_jobs(factories: DataFrame, n_seeds: int, first: int, source: str) -> DataFrame:
    """(factory, seed, source): every factory with a run of seeds."""
    return factories.select("factory", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + n_seeds - 1).cast("bigint"))).alias("seed"),
                            F.lit(source).alias("source"))


def catalogue_jobs(ids: DataFrame, source: str) -> DataFrame:
    return ids.select("factory", F.col("object_id").alias("seed"), F.lit(source).alias("source"))


def shard(rows: DataFrame, order: Sequence[str], shards: int, name: str = "shard") -> DataFrame:
    """Contiguous shards of ceil(N / shards) rows in the given total order."""
    numbered = ranked(rows, [], order, "_rn")
    size = numbered.agg(F.ceil(F.count("*") / shards).alias("_size"))
    return numbered.crossJoin(F.broadcast(size)).withColumn(
        name, F.floor((F.col("_rn") - 1) / F.col("_size"))).drop("_rn", "_size")


def valid_modes(objects: DataFrame, joints: DataFrame, most: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, factory, mode): animation modes an object can use.

    ``objects`` is (keys…, factory); ``joints`` (keys…, type); ``most`` a
    configuration table (factory, max_mode), 0 if missing. Modes 0, 1, 2 need a
    joint of their type, higher ones none. Objects with joints but without any
    valid mode get all modes, objects without joints none.
    """
    types = joints.where(F.col("type").isin(*fixed.MOVABLE)).groupBy(*keys).agg(
        *[F.bool_or(F.col("type") == k).alias(f"_{k}") for k in fixed.MOVABLE])
    ranged = objects.join(most, "factory", "left").withColumn("max_mode", F.coalesce("max_mode", F.lit(0)))
    both = ranged.join(types, list(keys))
    allowed = F.sequence(F.lit(0).cast("bigint"), F.col("max_mode").cast("bigint"))
    ok = F.array(*[F.col(f"_{k}") for k in fixed.TYPE_MODES])
    valid = F.filter(allowed, lambda m: F.coalesce(F.get(ok, m.cast("int")), F.lit(True)))
    modes = F.when(F.size(valid) > 0, valid).otherwise(allowed)
    return both.select(*keys, "factory", F.explode(modes).alias("mode"))


def render_plan(split_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, key, mode, view, moving): views to render per split.

    default is mode 3, anim<n> mode n; single-type and default splits take two
    fixed views, per-joint splits one, and all take one orbit.
    """
    mode = F.when(F.col("key") == "default", F.lit(3)).otherwise(F.regexp_extract("key", r"^anim(\d+)$", 1).try_cast("int"))
    def view(name: str, moving: bool) -> Column:
        return F.struct(F.lit(name).alias("view"), F.lit(moving).alias("moving"))
    one = F.array(view("hemi_00", False), view("orbit_00", True))
    two = F.array(view("hemi_00", False), view("hemi_08", False), view("orbit_00", True))
    rows = split_keys.withColumn("mode", mode.cast("bigint")).where("mode is not null")
    return rows.select(*keys, "key", "mode", F.explode(F.when(F.col("mode") >= 10, one).otherwise(two)).alias("_v")).select(
        *keys, "key", "mode", "_v.*")


def video_mode(name: Column) -> Column:
    """Animation mode of a finished ``…_nobg.mp4`` file; 0 without a suffix, null for other tags."""
    tag = F.when(name.contains("_anim"), F.regexp_extract(name, r"_anim(\d+)_nobg\.mp4$", 1)).otherwise("0")
    return tag.try_cast("bigint")


def completeness(jobs: DataFrame, files: DataFrame, keys: Sequence[str], expected: int = fixed.EXPECTED_VIEWS) -> DataFrame:
    """Jobs (keys…, mode) with their number of finished videos and a complete flag. ``files`` is (keys…, name)."""
    done = files.where(F.col("name").endswith("_nobg.mp4"))
    counts = done.groupBy(*keys, video_mode(F.col("name")).alias("mode")).agg(F.count("*").alias("n_videos"))
    out = jobs.join(counts, [*keys, "mode"], "left").withColumn("n_videos", F.coalesce("n_videos", F.lit(0).cast("bigint")))
    return out.withColumn("complete", F.col("n_videos") >= expected)


def named_views_complete(folders: DataFrame, files: DataFrame, keys: Sequence[str], views: Sequence[str] = fixed.RENDER_VIEWS, variants: Sequence[str] = fixed.RENDER_VARIANTS) -> DataFrame:
    """Folders (keys…) with the number of wanted ``<view>_<variant>.mp4`` they hold and whether that is all of them.

    ``files`` is (keys…, name); a name twice counts once, other names do not. Without variants every folder is complete.
    """
    wanted = [f"{view}_{variant}.mp4" for view in views for variant in variants]
    # One bit a name, so that partial aggregation needs no set of names.
    bit = F.coalesce(*[F.when(F.col("name") == name, F.lit(1 << i)) for i, name in enumerate(wanted)], F.lit(0)).cast("bigint")
    held = files.groupBy(*keys).agg(F.bit_count(F.bit_or(bit)).cast("bigint").alias("n_files"))
    out = folders.select(*keys).distinct().join(held, list(keys), "left").withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("bigint")))
    return out.withColumn("complete", F.col("n_files") == len(wanted))


def pending(jobs: DataFrame, files: DataFrame, keys: Sequence[str], expected: int = fixed.EXPECTED_VIEWS) -> DataFrame:
    """Jobs that are not finished yet."""
    done = completeness(jobs, files, keys, expected).where("complete").select(*keys, "mode")
    return jobs.join(done, [*keys, "mode"], "left_anti")


def select_joints(joints: DataFrame, selectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, mode, joint): joints animated per mode.

    ``joints`` is (keys…, factory, joint, type, lower, upper, ax0..2, depth) of
    the joints above moving parts. ``selectors`` is a configuration table
    (factory, mode, type, kind, arg): kind all, ordinal (arg a position by
    depth and name, negative from the end), axis (arg x, y, z) or sign (arg +
    or -). Selectors of a mode add up; a mode that selects nothing animates all.
    """
    big = ranked(significant(joints), [*keys, "type"], ["depth", "joint"], "_up")
    count = big.groupBy(*keys, "type").agg(F.max("_up").alias("_n"))
    pool = big.join(count, [*keys, "type"])
    target = F.when(F.abs("upper") >= F.abs("lower"), F.col("upper")).otherwise(F.col("lower"))
    at = F.col("arg").try_cast("int")
    kind = F.col("kind")
    hit = (
        (kind == "all")
        | ((kind == "ordinal") & (F.col("_up") - 1 == F.when(at >= 0, at).otherwise(F.col("_n") + at)))
        | ((kind == "axis") & (F.abs(F.when(F.col("arg") == "x", F.col("ax0")).when(F.col("arg") == "y", F.col("ax1")).otherwise(F.col("ax2"))) > 0.5))
        | ((kind == "sign") & F.when(F.col("arg") == "+", target > 0).otherwise(target < 0))
    )
    modes = selectors.select("factory", "mode").distinct()
    chosen = pool.join(selectors, ["factory", "type"]).where(hit).select(*keys, "mode", "joint").distinct()
    wanted = joints.select(*keys, "factory").distinct().join(modes, "factory")
    empty = wanted.join(chosen.select(*keys, "mode").distinct(), [*keys, "mode"], "left_anti")
    return chosen.unionByName(empty.join(joints.select(*keys, "joint"), list(keys)).select(*keys, "mode", "joint"))


def progress(finished: DataFrame, total: int | Column, ts: str, ident: str) -> DataFrame:
    """Add done count, elapsed seconds since the first finish and the estimated rest."""
    numbered = ranked(finished, [], [ts, ident], "done")
    first = numbered.agg(F.min(ts).alias("_t0"), F.count("*").alias("_all"))
    total = F.lit(total) if isinstance(total, int) else total
    elapsed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))
    return numbered.crossJoin(F.broadcast(first)).withColumn("elapsed", elapsed / 1e6).withColumn(
        "eta", F.col("elapsed") / F.col("done") * (total - F.col("done"))).drop("_t0", "_all")


def round_robin(items: DataFrame, index: str, weights: Sequence[tuple[str, int]]) -> DataFrame:
    """Add ``config``: item i takes the first config whose cumulative weight exceeds i mod Σw."""
    if not all(isinstance(w, int) for _, w in weights):
        raise ValueError(f"round robin needs integer weights, got {weights}")
    at = F.pmod(F.col(index), F.lit(sum(w for _, w in weights)))
    out, acc = None, 0
    for name, w in weights:
        acc += w
        out = F.when(at < acc, name) if out is None else out.when(at < acc, name)
    return items.withColumn("config", out)


def frame_blocks(scenes: DataFrame, first: str, last: str, view_block: int, camera_block: int) -> DataFrame:
    """Nested frame blocks with inclusive ends: view blocks, and camera blocks inside each."""
    out = scenes.withColumn("view_start", F.explode(F.sequence(F.col(first), F.col(last), F.lit(view_block).cast("bigint"))))
    out = out.withColumn("view_end", F.least(F.col(last), F.col("view_start") + view_block - 1))
    out = out.withColumn("cam_start", F.explode(F.sequence("view_start", "view_end", F.lit(camera_block).cast("bigint"))))
    return out.withColumn("cam_end", F.least("view_end", F.col("cam_start") + camera_block - 1))


def camera_path(views: DataFrame, n_frames: int, distance: float, centre=(0.0, 0.0, 0.0)) -> DataFrame:
    """Camera position per frame 1..n for views (elev0, azim0, elev1, azim1) in degrees."""
    out = views.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(n_frames))))
    t = (F.col("frame") - 1) / float(max(n_frames - 1, 1))
    elev = F.radians(F.col("elev0") + (F.col("elev1") - F.col("elev0")) * t)
    azim = F.radians(F.col("azim0") + (F.col("azim1") - F.col("azim0")) * t)
    return out.withColumns({
        "x": distance * F.cos(elev) * F.cos(azim) + centre[0],
        "y": distance * F.cos(elev) * F.sin(azim) + centre[1],
        "z": distance * F.sin(elev) + centre[2],
        "frame": F.col("frame").cast("bigint"),
    })


def backlog(scenes: DataFrame, cap: int) -> DataFrame:
    """Launch order of unfinished, uncrashed scenes: most in-flight plus done first, up to the queue cap.

    ``scenes`` is (scene, running, done, queued_next, finished, crashed).
    """
    open_ = scenes.where(~F.col("finished") & ~F.col("crashed")).withColumn("inflight", F.col("running") + F.col("done"))
    open_ = open_.withColumn("_back", -F.col("inflight"))
    return running_sum(open_, [], ["_back", "scene"], {"queued": F.col("queued_next")}).where(
        F.col("queued") <= cap).drop("_back")

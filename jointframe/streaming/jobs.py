"""Job-state monitoring on Structured Streaming.

Events are rows (scene, task, ts, event, event_id). Jobs that need to remember
keys for good keep nothing in the stream's state: every micro-batch is folded
by built-in aggregates, which combine on the map side, so a hot scene sends one
partial row per task, and merged into the buckets of a ``KeyedTable`` that its
keys fall into. Scenes that are over leave the live table. A batch that is run
again after a failure changes nothing. Windows, sessions and joins use
watermarks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jointframe.plans.ordered import in_blocks, neighbours, running_max, running_sum
from jointframe.session import durable, ensure_checkpoint_dir
from jointframe.streaming.tables import KeyedTable

STATES = {"submitted": "queued", "running": "running", "finished": "succeeded", "failed": "crashed", "cancelled": "cancelled"}


# -- sources and sinks --------------------------------------------------------------------

def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Stream over parquet files of a folder; each file is read once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def work_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is available into parquet and return the table.

    Files are committed exactly once. Run again with the same folder to take up
    new input only.
    """
    spark = stream.sparkSession
    out, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is available, one micro-batch after the other; the folder remembers where it stands."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(step).start().awaitTermination()


# -- state --------------------------------------------------------------------------------

def state_of(event: Column) -> Column:
    out = None
    for name, state in STATES.items():
        out = F.when(event == name, state) if out is None else out.when(event == name, state)
    return out.otherwise("not_queued")


def last_events(events: DataFrame) -> DataFrame:
    """(scene, task, last: the latest event with its ts and id)."""
    return events.groupBy("scene", "task").agg(F.max(F.struct("ts", "event_id", "event")).alias("last"))


def as_states(last: DataFrame) -> DataFrame:
    return last.select("scene", "task", state_of(F.col("last.event")).alias("state"), "last.ts")


def latest_states(events: DataFrame) -> DataFrame:
    """(scene, task, state, ts): the latest event decides."""
    return as_states(last_events(events))


LAST = "last struct<ts: timestamp, event_id: bigint, event: string>"


def latest_states_stream(events: DataFrame, folder: str, buckets: int = 16) -> DataFrame:
    """The same over a stream: each micro-batch is merged into the buckets of its scenes."""
    spark = events.sparkSession
    table = KeyedTable(spark, f"{folder}/table", f"scene bigint, task string, {LAST}", ["scene", "task"], buckets)

    def step(batch: DataFrame, number: int) -> None:
        table.update(number, last_events(batch), lambda both: both.groupBy("scene", "task").agg(F.max("last").alias("last")))

    run_batches(events, folder, step)
    return as_states(table.read())


def state_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, state, task, n) per tumbling window."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window), state_of(F.col("event")).alias("state"), "task").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "state", "task", "n")


def first_crashes(events: DataFrame, folder: str, buckets: int = 16) -> DataFrame:
    """(scene, task, batch) of crashes over a stream, each reported once for good with the micro-batch that saw it first."""
    spark = events.sparkSession
    table = KeyedTable(spark, f"{folder}/table", "scene bigint, task string, batch bigint", ["scene", "task"], buckets)

    def step(batch: DataFrame, number: int) -> None:
        if not table.done(number):
            new = durable(batch.where("event = 'failed'").select("scene", "task").distinct())
            known = table.read(table.touched(new)).select("scene", "task")
            table.append(number, new.join(known, ["scene", "task"], "left_anti").withColumn("batch", F.lit(number)))

    run_batches(events, folder, step)
    return table.read()


def last_by_task(events: DataFrame, tasks: Sequence[tuple[str, str]]) -> DataFrame:
    """One row a scene: the latest event of each task of the list as a column of the task's name."""
    event = F.struct("ts", "event_id", "event")
    return events.groupBy("scene").agg(*[F.max(F.when(F.col("task") == name, event)).alias(name) for name, _ in tasks])


def chain_of(per: DataFrame, tasks: Sequence[tuple[str, str]]) -> DataFrame:
    """The progress of each scene of ``last_by_task``; see ``scene_chain``."""
    prev, stopped = F.lit("succeeded"), F.lit(False)
    reached, state, fatal = F.lit("none"), F.lit("succeeded"), F.lit(False)
    running = F.lit(False)
    for i, (name, condition) in enumerate(tasks):
        own = F.coalesce(state_of(F.col(f"{name}.event")), F.lit("not_queued"))
        if condition == "prev_succeeded":
            stopped = stopped | (prev != "succeeded")
            runs = ~stopped
        elif condition == "prev_failed":
            runs = ~stopped & (prev == "crashed")
        else:
            runs = ~stopped
        fallback = i + 1 < len(tasks) and tasks[i + 1][1] == "prev_failed"
        reached, state = F.when(runs, F.lit(name)).otherwise(reached), F.when(runs, own).otherwise(state)
        fatal = fatal | (runs & (own == "crashed") & F.lit(not fallback))
        running = running | (runs & own.isin("queued", "running"))
        prev = F.when(runs, own).otherwise(prev)
    finished = (reached == tasks[-1][0]) & (state == "succeeded")
    return per.select("*", reached.alias("reached"), state.alias("state"), fatal.alias("fatal"),
                      finished.alias("finished"), (fatal & ~running).alias("crashed"))


def scene_chain(events: DataFrame, tasks: Sequence[tuple[str, str]]) -> DataFrame:
    """(scene, reached, state, fatal, finished, crashed): progress of each scene through an ordered task list.

    ``tasks`` is (name, condition) with condition prev_succeeded, prev_failed or
    prev_redundant. A scene stops at the first task whose condition asks for
    success and does not find it; a prev_failed task is skipped unless the one
    before failed. A failure is fatal unless a prev_failed fallback follows.
    The chain is a pure function of the latest event per task.
    """
    return chain_of(last_by_task(events, tasks), tasks).select("scene", "reached", "state", "fatal", "finished", "crashed")


def outcome() -> Column:
    return F.when(F.col("crashed"), "crashed").otherwise("done").alias("outcome")


def terminations(chain: DataFrame) -> DataFrame:
    """(scene, outcome) of scenes that are done or crashed for good."""
    return chain.where("finished or crashed").select("scene", outcome())


class SceneBoard:
    """All scenes under way and those that are over, brought forward by one poll per micro-batch.

    ``live`` holds the latest event per task of scenes under way. A scene whose
    chain is finished or crashed at a poll moves to ``over`` with its outcome
    and the number of the poll, and later events of it are not looked at. Both
    tables are read and written only in the buckets of the poll's scenes, so
    what a poll costs does not grow with the scenes that are over.

    If a poll is broken off between the two tables, the next attempt finds its
    scenes in ``over`` already and takes them out of ``live`` by that.
    """

    def __init__(self, spark: SparkSession, folder: str, tasks: Sequence[tuple[str, str]], buckets: int = 16):
        self.folder, self.tasks = folder, list(tasks)
        lasts = ", ".join(f"{name} {LAST.split(' ', 1)[1]}" for name, _ in tasks)
        self.live = KeyedTable(spark, f"{folder}/live", f"scene bigint, {lasts}", ["scene"], buckets)
        self.over = KeyedTable(spark, f"{folder}/over", "scene bigint, outcome string, poll bigint, reached string, state string, fatal boolean", ["scene"], buckets)

    def poll(self, events: DataFrame, number: int) -> None:
        if self.live.done(number):
            return
        new = durable(last_by_task(events, self.tasks))
        touched = self.live.touched(new)
        over = self.over.read(touched).select("scene")
        both = self.live.read(touched).unionByName(new).join(over, "scene", "left_anti")
        merged = both.groupBy("scene").agg(*[F.max(name).alias(name) for name, _ in self.tasks])
        chain = durable(chain_of(merged, self.tasks))
        ended = F.col("finished") | F.col("crashed")
        self.over.append(number, chain.where(ended).select("scene", outcome(), F.lit(number).alias("poll"), "reached", "state", "fatal"))
        self.live.replace(number, touched, chain.where(~ended))

    def run(self, events: DataFrame) -> SceneBoard:
        run_batches(events, self.folder, self.poll)
        return self

    def snapshot(self) -> DataFrame:
        """(scene, reached, state, fatal, all_done): every scene; all_done is null while it is under way."""
        live = chain_of(self.live.read(), self.tasks).select("scene", "reached", "state", "fatal", F.lit(None).cast("string").alias("all_done"))
        return live.unionByName(self.over.read().select("scene", "reached", "state", "fatal", F.col("outcome").alias("all_done")))

    def seed_lists(self) -> DataFrame:
        """(scene, outcome, poll): the finished and the crashed seeds."""
        return self.over.read().select("scene", "outcome", "poll")

    def write_lists(self, folder: str) -> None:
        """One seed a line, in text folders ``finished_seeds`` and ``crashed_seeds``."""
        for kind, name in (("done", "finished_seeds"), ("crashed", "crashed_seeds")):
            self.over.read().where(F.col("outcome") == kind).select(F.col("scene").cast("string")).write.mode("overwrite").text(f"{folder}/{name}")


# -- time ---------------------------------------------------------------------------------

def throughput(events: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, n) finished tasks per tumbling or sliding window."""
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.where("event = 'finished'").withWatermark("ts", delay).groupBy(win).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(scene, start, end, n): bursts of activity split by idle time; a session leaves when the watermark passes it."""
    out = events.withWatermark("ts", delay).groupBy("scene", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("scene", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def batch_sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """(scene, session, start, last, n) over stored events; a busy scene is split into blocks."""
    rows = in_blocks(events.select("scene", "ts", "event_id"), ["scene"], ["ts", "event_id"])
    prev = neighbours(rows, ["scene"], ["ts", "event_id"], {"_p": "ts"}, blocked=True)
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))
    new = F.when(F.col("_p").isNull() | (micros("ts") - micros("_p") > gap_seconds * 1_000_000), 1).otherwise(0).cast("bigint")
    numbered = running_sum(prev.withColumn("_new", new), ["scene"], ["ts", "event_id"], {"session": F.col("_new")}, blocked=True)
    return numbered.groupBy("scene", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))


def late_rows(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Events that come later than the allowed delay behind the newest event before them, in arrival order.

    These are the rows a watermark of that delay may drop; they belong in the side table.
    """
    seen = running_max(events.withColumn("_all", F.lit(0)), ["_all"], ["event_id"], "ts", "_newest").drop("_all")
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))
    return seen.where(micros("_newest") - micros("ts") > delay_seconds * 1_000_000).drop("_newest")


def ends_of(events: DataFrame) -> DataFrame:
    """(scene, task, f, g): the last failure and the last finish of each task."""
    return events.groupBy("scene", "task").agg(*[F.max(F.when(F.col("event") == e, F.col("ts"))).alias(c) for e, c in (("failed", "f"), ("finished", "g"))])


def corrected(ends: DataFrame, delay_seconds: int) -> DataFrame:
    """(scene, task, state): a finish counts over an earlier failure only if it came within the delay."""
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))
    in_time = (micros("g") - micros("f")).between(0, delay_seconds * 1_000_000)
    state = (F.when(F.col("f").isNull() & F.col("g").isNull(), "open").when(F.col("f").isNull(), "succeeded")
             .when(F.col("g").isNull(), "crashed").when(in_time, "succeeded").otherwise("crashed"))
    return ends.select("scene", "task", state.alias("state"))


def corrected_states(events: DataFrame, folder: str, delay_seconds: int, buckets: int = 16) -> DataFrame:
    """The same over a stream, with both ends merged into the buckets of each micro-batch's tasks."""
    table = KeyedTable(events.sparkSession, f"{folder}/table", "scene bigint, task string, f timestamp, g timestamp", ["scene", "task"], buckets)

    def step(batch: DataFrame, number: int) -> None:
        table.update(number, ends_of(batch), lambda both: both.groupBy("scene", "task").agg(F.max("f").alias("f"), F.max("g").alias("g")))

    run_batches(events, folder, step)
    return corrected(table.read(), delay_seconds)


def ramp_alerts(events: DataFrame, config: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, n, allowed, over): tasks in flight per window against the warm-up ramp.

    ``config`` is one static row (begin, warmup_s, most); the ramp allows
    ceil(min(elapsed / warmup, 1) · most), and ``most`` at once without warm-up.
    """
    live = events.where("event in ('submitted', 'running')").withWatermark("ts", delay)
    counted = live.groupBy(F.window("ts", window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
    def secs(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    part = F.when(F.col("warmup_s") > 0, F.least((secs("end") - secs("begin")) / F.col("warmup_s"), F.lit(1.0))).otherwise(1.0)
    allowed = F.ceil(part * F.col("most"))
    return counted.crossJoin(F.broadcast(config)).select("start", "n", allowed.alias("allowed"), (F.col("n") > allowed).alias("over"))


def start_finish(starts: DataFrame, finishes: DataFrame, within_seconds: int, delay: str = "1 hour") -> DataFrame:
    """(scene, task, start_id, finish_id, secs): starts paired with finishes that follow within the limit.

    Works for streams and tables. The key carries a time bucket, and finishes
    are sent to their bucket and the one before, so a busy task is spread over
    many keys instead of one.
    """
    def bucket(c: str) -> Column:
        return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / within_seconds)
    s = starts.withWatermark("ts", delay) if starts.isStreaming else starts
    f = finishes.withWatermark("ts", delay) if finishes.isStreaming else finishes
    s = s.select(F.col("scene").alias("s_scene"), F.col("task").alias("s_task"), F.col("ts").alias("s_ts"), F.col("event_id").alias("start_id"), bucket("ts").alias("s_bucket"))
    f = f.select("scene", "task", F.col("ts").alias("f_ts"), F.col("event_id").alias("finish_id"), F.explode(F.array(bucket("ts"), bucket("ts") - 1)).alias("bucket"))
    same = (F.col("s_scene") == F.col("scene")) & (F.col("s_task") == F.col("task")) & (F.col("s_bucket") == F.col("bucket"))
    span = F.expr(f"f_ts >= s_ts AND f_ts <= s_ts + INTERVAL {within_seconds} SECONDS")
    secs = (F.unix_micros(F.col("f_ts").cast("timestamp")) - F.unix_micros(F.col("s_ts").cast("timestamp"))) / 1e6
    return s.join(f, same & span).select("scene", "task", "start_id", "finish_id", secs.alias("secs"))

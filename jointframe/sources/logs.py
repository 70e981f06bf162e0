"""Run logs to tables: accounting, queues, memory, stage times, crashes, counts, inventories, tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.functions import scalar as sc
from jointframe.sources.text import matches, tokens

# Fixed line formats.
ACCOUNTING = r"^([0-9]+) +(\S+) +(\S+) +([0-9]+) +([A-Z_]+) +(node[0-9]+) +(\S+).*$"
QUEUED = r"([0-9]+) +(\S+) +(\([a-zA-Z]+\))"
PEAK = r"([0-9]+)\.0 +.* +([0-9]*.?[0-9]*[KMG])"
STAGE = r"\[INFO\] \| \[(.*?)\] finished in (?:([0-9]+) days?, )?([0-9]+):([0-9]+):([0-9]+)"
CRASH = r"""^\S*\s.*\s(.*\/([a-zA-Z0-9]*)\/logs\/(.*))\sreason=["'](.*)["']\snode='(.*)'"""
NODE = r"(\S+) +(\S+) +([0-9]+)/[0-9]+/[0-9]+/([0-9]+)"


def _matched(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """One row per match with its groups in ``m``; lines without a match are dropped."""
    return lines.withColumn("m", F.explode(matches(F.col("line"), pattern, groups)))


def _group(i: int) -> Column:
    return F.get("m", F.lit(i - 1))


def accounting_rows(lines: DataFrame) -> DataFrame:
    """Started jobs; lines of another shape are dropped, a missing gpu count is 0."""
    rows = _matched(lines, ACCOUNTING, 7).withColumn("res", F.str_to_map(_group(3), F.lit(","), F.lit("=")))
    start = F.to_timestamp_ntz(_group(7), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    elapsed = _group(4).cast("bigint")
    return rows.select(
        _group(1).cast("bigint").alias("job_id"), _group(2).alias("name"), F.col("res")["mem"].alias("req_mem"),
        F.col("res")["cpu"].try_cast("bigint").alias("cpu"), F.coalesce(F.try_element_at("res", F.lit("gpu")), F.lit("0")).try_cast("bigint").alias("gpu"),
        elapsed.alias("elapsed_s"), _group(5).alias("state"), _group(6).alias("node"), start.alias("start"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), elapsed)).alias("end"))


def queued_rows(lines: DataFrame, prefix: str) -> DataFrame:
    """Jobs that wait, restricted to the run's name prefix; the reason is their state."""
    return _matched(lines, QUEUED, 3).select(
        _group(1).cast("bigint").alias("job_id"), _group(2).alias("name"), _group(3).alias("state")).where(F.col("name").startswith(prefix))


def peak_memory_rows(lines: DataFrame) -> DataFrame:
    """(job_id, gb): the peak of the last step line of a job, in gigabytes."""
    return _matched(lines, PEAK, 2).select(_group(1).cast("bigint").alias("job_id"), sc.memory_gb(_group(2)).alias("gb"))


def stage_rows(lines: DataFrame) -> DataFrame:
    """(path, stage, secs) of finished stages; stages under a second are dropped."""
    def part(i: int) -> Column:
        return F.coalesce(_group(i).try_cast("bigint"), F.lit(0))
    secs = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    return _matched(lines, STAGE, 5).select("path", _group(1).alias("stage"), secs.alias("secs")).where("secs >= 1")


def crash_rows(lines: DataFrame) -> DataFrame:
    """(log_path, job_id, stage, reason, node); the stage ends at the first dot or underscore."""
    stage = F.substring_index(F.substring_index(_group(3), ".", 1), "_", 1)
    return _matched(lines, CRASH, 5).select(
        _group(1).alias("log_path"), _group(2).alias("job_id"), stage.alias("stage"), _group(4).alias("reason"), _group(5).alias("node"))


def crash_rejects(lines: DataFrame) -> DataFrame:
    return lines.where((F.length("line") > 0) & ~F.col("line").rlike(CRASH))


def _folder(path: Column, tail: str) -> Column:
    """The folder above a tail, as an absolute path without scheme and doubled slashes; null if the path ends otherwise."""
    plain = F.regexp_replace(F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:/*", "/"), "/{2,}", "/")
    return F.nullif(F.regexp_extract(plain, f"^(.+)/{tail}$", 1), F.lit(""))


def script_tasks(lines: DataFrame, name: str = "run_pipeline.sh") -> DataFrame:
    """(folder, _blk, seq, line, configs) of the lines of run scripts that start a task with configurations (``-g … -p``)."""
    told = lines.where(F.col("line").contains("--task ") & F.col("line").rlike("-g.*-p"))
    return told.select(_folder(F.col("path"), name.replace(".", "[.]")).alias("folder"), "_blk", "seq", "line", F.trim(F.regexp_extract("line", "-g(.*)-p", 1)).alias("configs"))


def with_configs(crashes: DataFrame, scripts: DataFrame) -> DataFrame:
    """Crash rows with ``configs`` and ``scenetype``: from the first line of their scene's run script that starts their stage; null without one.

    A log lies in the folder ``logs`` of its scene, the script beside that. The
    stage may be the beginning of the task's name. The scene type is the first
    configuration.
    """
    own = crashes.withColumn("_folder", _folder(F.col("log_path"), "logs/[^/]*"))
    wanted = own.select(F.col("_folder").alias("folder"), "stage").distinct()
    hits = wanted.join(script_tasks(scripts), "folder").where(F.contains("line", F.concat(F.lit("--task "), "stage")))
    first = hits.groupBy(F.col("folder").alias("_folder"), "stage").agg(F.min_by("configs", F.struct("_blk", "seq")).alias("configs"))
    return own.join(first, ["_folder", "stage"], "left").drop("_folder").withColumn("scenetype", F.substring_index("configs", " ", 1))


def polycount_rows(lines: DataFrame) -> DataFrame:
    """(path, key, value) of lines with exactly one colon; thousands separators are removed."""
    kv = lines.select("path", F.split("line", ":").alias("kv")).where(F.size("kv") == 2)
    value = F.replace(F.trim(F.get("kv", F.lit(1))), F.lit(","), F.lit(""))
    return kv.select("path", F.trim(F.get("kv", F.lit(0))).alias("key"), value.try_cast("bigint").alias("value"))


def list_literal(text: Column) -> Column:
    """A Python list literal of strings as an array; a string stands in quotes of either kind, with backslash escapes of quotes and backslashes."""
    quoted = F.regexp_extract_all(text, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    return F.transform(quoted, lambda q: F.regexp_replace(F.substr(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))


STAGE_SCHEMA = "name string, ran boolean, mem_at_finish bigint, obj_count bigint, instance_count bigint"


def stage_results(spark, path: str) -> DataFrame:
    """Stage result CSV files with their path; what does not fit its type is null, and ``corrupt`` then holds the line."""
    read = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return read.schema(f"{STAGE_SCHEMA}, corrupt string").csv(path).withColumn("path", F.input_file_name())


def scene_db(spark, path: str, schema: str, lists: Sequence[str] = ("configs",)) -> DataFrame:
    """A scene table from CSV files whose ``lists`` columns hold list literals."""
    rows = spark.read.option("header", "true").option("escape", '"').schema(schema).csv(path)
    return rows.withColumns({c: list_literal(F.col(c)) for c in lists})


def node_rows(lines: DataFrame) -> DataFrame:
    """(node, partition, alloc_cpus, total_cpus); the catch-all partition is ignored."""
    return _matched(lines, NODE, 4).select(
        _group(1).alias("node"), _group(2).alias("partition"), _group(3).cast("bigint").alias("alloc_cpus"),
        _group(4).cast("bigint").alias("total_cpus")).where("partition <> 'all'")


def gpu_rows(lines: DataFrame) -> DataFrame:
    """(node, partition, gpu, n_gpu, mem_mb) of lines ``node partition gpu:type:n memory``."""
    t = lines.select(tokens(F.col("line")).alias("t")).where(F.size("t") == 4)
    gres = F.get("t", F.lit(2))
    return t.select(
        F.get("t", F.lit(0)).alias("node"), F.get("t", F.lit(1)).alias("partition"),
        F.regexp_extract(gres, r"gpu:([^:]+):([0-9]+)", 1).alias("gpu"),
        F.regexp_extract(gres, r"gpu:([^:]+):([0-9]+)", 2).try_cast("bigint").alias("n_gpu"),
        F.get("t", F.lit(3)).try_cast("bigint").alias("mem_mb")).where("partition <> 'all' and gpu <> ''")


TUM = ["t", "x", "y", "z", "qx", "qy", "qz", "qw"]
IMU = ["t", "rv_x", "rv_y", "rv_z", "a_x", "a_y", "a_z"]


def track_rows(lines: DataFrame, names: list[str]) -> DataFrame:
    """Space-separated tracks (pose or inertial); header lines are skipped."""
    t = lines.select("path", tokens(F.col("line")).alias("t")).where(F.size("t") == len(names))
    cols = [F.get("t", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]
    return t.select("path", *cols).where(F.col(names[0]).isNotNull())


def survey_answers(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add ``answer``: A, B, yes, unsure or other."""
    c = F.col(label)
    return rows.withColumn("answer", F.when(c.contains("Program A"), "A").when(c.contains("Program B"), "B")
                           .when(c.contains("Yes"), "yes").when(c.contains("Not Sure"), "unsure").otherwise("other"))

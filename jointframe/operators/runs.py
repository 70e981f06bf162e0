"""Run analytics: stage times, resources, crashes, comparisons, surveys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.functions import stats as st
from jointframe.plans.ordered import exact_percentiles, neighbours
from jointframe.session import durable

PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def with_peak_memory(jobs: DataFrame, memory: DataFrame) -> DataFrame:
    """Jobs with ``gb``; −1 where no peak is known."""
    return jobs.join(memory, "job_id", "left").withColumn("gb", F.coalesce("gb", F.lit(-1.0)))


def stage_shares(stages: DataFrame, jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of a completed job's time per stage in percent."""
    done = jobs.where("state = 'COMPLETED'").select(*keys, "elapsed_s")
    return stages.join(done, list(keys)).withColumn("share", 100.0 * F.col("secs") / F.col("elapsed_s"))


def stage_statistics(stages: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and exact percentiles per key."""
    mean = stages.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(exact_percentiles(stages, keys, value, PERCENTILES), list(keys))


def stage_occurrence(stages: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per stage: total, percent of all scene time, percent of its step's time, occurrence per finished scene.

    ``stages`` is (scene, step, stage, secs) and ``scenes`` the finished scenes.
    """
    kept = stages.join(scenes.select("scene"), "scene", "left_semi")
    per = kept.groupBy("step", "stage").agg(F.sum("secs").alias("total"), F.countDistinct("scene").alias("_n"))
    step = per.groupBy("step").agg(F.sum("total").alias("_step"))
    whole = per.agg(F.sum("total").alias("_all"))
    count = scenes.agg(F.count("*").alias("_scenes"))
    return (per.join(step, "step").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(count))
            .select("step", "stage", "total", (100.0 * F.col("total") / F.col("_all")).alias("pct_scene"),
                    (100.0 * F.col("total") / F.col("_step")).alias("pct_step"), (F.col("_n") / F.col("_scenes")).alias("occurrence")))


def scene_durations(jobs: DataFrame) -> DataFrame:
    """Per scene: elapsed of the first (coarse) and second (fine) job by id, the span to the last end and both shares.

    Scenes need a render job after the first two. Only two rows per scene are
    ranked; the limit works before the shuffle.
    """
    w = Window.partitionBy("scene").orderBy("job_id")
    first = jobs.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").groupBy("scene").agg(
        F.max(F.when(F.col("_rn") == 1, F.struct("start_s", "elapsed_s"))).alias("coarse"),
        F.max(F.when(F.col("_rn") == 2, F.struct("job_id", "elapsed_s"))).alias("fine"))
    rest = jobs.join(first.where("fine is not null"), "scene").where(F.col("job_id") > F.col("fine.job_id")).groupBy("scene").agg(
        F.max(F.col("start_s") + jobs["elapsed_s"]).alias("_end"))
    span = F.col("_end") - F.col("coarse.start_s")
    return first.join(rest, "scene").select(
        "scene", F.col("coarse.elapsed_s").alias("coarse_s"), F.col("fine.elapsed_s").alias("fine_s"), span.alias("span_s"),
        F.try_divide(100.0 * F.col("coarse.elapsed_s"), span).alias("coarse_pct"), F.try_divide(100.0 * F.col("fine.elapsed_s"), span).alias("fine_pct"))


def drop_tail(jobs: DataFrame, names: Sequence[str], key: str = "scene") -> DataFrame:
    """Jobs without the trailing runs whose name contains each of ``names`` in turn."""
    for name in names:
        last = jobs.where(~F.col("stage").contains(name)).groupBy(key).agg(F.max("job_id").alias("_last"))
        jobs = jobs.join(last, key).where(F.col("job_id") <= F.col("_last")).drop("_last")
    return jobs


def resources(jobs: DataFrame) -> DataFrame:
    """Per scene: peak memory, elapsed, cpu and gpu time."""
    return jobs.groupBy("scene").agg(
        F.max("gb").alias("max_gb"), F.sum("elapsed_s").alias("elapsed_s"),
        F.sum(F.col("elapsed_s") * F.col("cpus")).alias("cpu_s"), F.sum(F.col("elapsed_s") * F.col("gpus")).alias("gpu_s"))


def trimmed_histogram(rows: DataFrame, value: str, width: float, cut: float = 0.99) -> DataFrame:
    """(bin, n, unit): counts below the cut percentile, in millions if the largest kept value passes a million."""
    limit = exact_percentiles(rows, [], value, {"_cut": cut})
    kept = rows.select(F.col(value).cast("double").alias("_v")).crossJoin(F.broadcast(limit)).where("_v < _cut")
    large = kept.agg((F.max("_v") > 1e6).alias("_large"))
    scaled = kept.crossJoin(F.broadcast(large)).withColumn("_v", F.when(F.col("_large"), F.col("_v") / 1e6).otherwise(F.col("_v")))
    return scaled.groupBy(F.floor(F.col("_v") / width).alias("bin"), F.when(F.col("_large"), "M").otherwise("").alias("unit")).agg(
        F.count("*").alias("n"))


def crash_frequency(crashes: DataFrame) -> DataFrame:
    """Counts over all combinations of reason, stage and scene type, totals included."""
    return crashes.cube("reason", "stage", "scenetype").agg(F.count("*").alias("n"))


def sample_per_group(rows: DataFrame, keys: Sequence[str], ident: Sequence[str], n: int, seed: str) -> DataFrame:
    """Up to n rows per key, picked by keyed hash; the rank limit works before the shuffle."""
    pick = sc.stable_hash(F.lit(seed), *[F.col(c) for c in ident])
    w = Window.partitionBy(*keys).orderBy("_pick", *ident)
    return rows.withColumn("_pick", pick).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_pick", "_rn")


def random_rows(rows: DataFrame, ident: Sequence[str], k: int, seed: str) -> DataFrame:
    """k rows without replacement, fixed by the seed."""
    return rows.withColumn("_pick", sc.stable_hash(F.lit(seed), *[F.col(c) for c in ident])).orderBy("_pick", *ident).limit(k).drop("_pick")


def stage_deltas(stages: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Change of each value against the previous stage that ran; the first has none."""
    ran = stages.where("ran")
    out = neighbours(ran, keys, order, {f"_p_{v}": v for v in values})
    return out.withColumns({f"d_{v}": F.col(v) - F.col(f"_p_{v}") for v in values}).drop(*[f"_p_{v}" for v in values])


def stage_changes(stages: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], by: str) -> DataFrame:
    """The deltas of stages that ran and changed ``by``; a stage without a predecessor or without a change is left out."""
    return stage_deltas(stages, keys, order, values).where(F.col(f"d_{by}") != 0)


def compare_runs(a: DataFrame, b: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Full outer join of two runs with _a and _b columns; the category comes from a."""
    left = a.select(F.col(key), "category", *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(F.col(key), *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, key, "full_outer")


def _tokens(name: Column) -> Column:
    """Characters with their occurrence numbers, so that shared tokens count shared characters with multiplicity."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    def token(c: Column, i: Column) -> Column:
        return F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string"))
    return F.transform(chars, token)


def _prefixes(names: DataFrame, col: str, use: DataFrame, need: float) -> DataFrame:
    """(col, toks, tok): the least used tokens of each name, as many as names with ``need`` of it in common cannot all miss.

    Of n tokens, at least ⌈need·n⌉ must be shared, so one of the first
    n − ⌈need·n⌉ + 1 is, in any order that both sides keep.
    """
    each = names.select(col, F.explode("toks").alias("tok")).join(use, "tok")
    # A name's tokens are its characters, so this list is as short as the name.
    ordered = each.groupBy(col).agg(F.array_sort(F.collect_list(F.struct("uses", "tok"))).alias("_o"))
    n = F.size("_o")
    take = F.greatest(n - F.ceil(n * need - 1e-9).cast("int") + 1, F.lit(1))
    firsts = ordered.select(col, F.explode(F.slice("_o", F.lit(1), take)).alias("_t")).select(col, F.col("_t.tok").alias("tok"))
    return firsts.join(names, col)


def _by_characters(a: DataFrame, b: DataFrame, c: float, measure: str) -> DataFrame:
    """Candidate pairs for low cutoffs, at which no longer piece of a name need be shared: by the rarest characters."""
    need = c / (2.0 - c) if measure == "lcs" else c
    left, right = [durable(df.withColumn("toks", _tokens(F.col(df.columns[0])))) for df in (a, b)]
    use = left.select(F.explode("toks").alias("tok")).union(right.select(F.explode("toks"))).groupBy("tok").agg(F.count("*").alias("uses"))
    la, lb = F.length("name_a"), F.length("name_b")
    lp = _prefixes(left, "name_a", use, need).withColumnRenamed("toks", "ta")
    rp = _prefixes(right, "name_b", use, need).withColumnRenamed("toks", "tb")
    shared = F.size(F.array_intersect("ta", "tb"))
    enough = 2 * shared >= c * (la + lb) - 1e-9 if measure == "lcs" else shared >= c * F.greatest(la, lb) - 1e-9
    return lp.join(rp, "tok").where(F.least(la, lb) >= need * F.greatest(la, lb) - 1e-9).where(enough).select("name_a", "name_b").distinct()


#: Letters of a segment, as far as a name has enough of them.
SEGMENT = 3


def _by_segments(a: DataFrame, b: DataFrame, c: float, measure: str) -> DataFrame:
    """Candidate pairs by an index of segments.

    A pair that reaches the cutoff is ``t`` edits apart at most, which follows
    from its lengths. A name of b is cut into more than t segments; t edits
    leave all but t of them whole, so of any t + 1, here the rarest ones, one
    stands in the name of a, moved by what the edits before it add or take. A
    name of a looks up its substrings at these few places. Frequent segments,
    such as a brand that thousands of names share, are looked at only if a name
    has no rarer ones.
    """
    need = c / (2.0 - c) if measure == "lcs" else c

    def edits(la: Column, lb: Column) -> Column:
        return F.floor((1 - c) * ((la + lb) if measure == "lcs" else F.greatest(la, lb)) + 1e-9).cast("int")

    def partners(n: Column) -> Column:
        """The lengths that a partner may have."""
        return F.sequence(F.ceil(need * n - 1e-9).cast("int"), F.floor(n / need + 1e-9).cast("int"))

    def cuts(df: DataFrame) -> DataFrame:
        """One row a segment of names of length ``lb`` that bear ``t`` edits: its number, place from 0 and length."""
        n = F.greatest(F.col("t") + 1, F.floor(F.col("lb") / SEGMENT).cast("int"))
        df = df.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        at = [F.floor((F.col("i") + k) * F.col("lb") / F.col("_n")).cast("int") for k in (0, 1)]
        return df.withColumns({"at": at[0], "len": at[1] - at[0]}).drop("_n")

    la, lb = F.length("name_a"), F.length("name_b")
    shapes = b.where(lb > 0).select("name_b", lb.alias("lb"), F.explode(F.array_distinct(F.transform(partners(lb), lambda n: edits(n, lb)))).alias("t"))
    key = ["lb", "t", "i", "piece"]
    pieces = durable(cuts(shapes).select("name_b", "lb", "t", "i", F.substr("name_b", F.col("at") + 1, F.col("len")).alias("piece")))
    ranked_ = pieces.join(pieces.groupBy(*key).agg(F.count("*").alias("uses")), key)
    # A name has few segments, so this list is as short as the name.
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("uses", "i", "piece"))), F.lit(1), F.col("t") + 1)
    index = ranked_.groupBy("name_b", "lb", "t").agg(rarest.alias("_r")).select("name_b", "lb", "t", F.explode("_r").alias("_s")).select("name_b", "lb", "t", "_s.i", "_s.piece")
    probes = a.where(la > 0).select("name_a", la.alias("la"), F.explode(partners(la)).alias("lb")).withColumn("t", edits(F.col("la"), F.col("lb")))
    more = F.col("la") - F.col("lb")
    moves = F.sequence(F.ceil((more - F.col("t")) / 2).cast("int"), F.floor((more + F.col("t")) / 2).cast("int"))
    probes = cuts(probes.where((F.col("lb") > 0) & (F.abs(more) <= F.col("t")))).withColumn("_move", F.explode(moves)).withColumn("at", F.col("at") + F.col("_move"))
    probes = probes.where((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.col("la")))
    probes = probes.select("name_a", "lb", "t", "i", F.substr("name_a", F.col("at") + 1, F.col("len")).alias("piece")).distinct()
    return probes.join(index, key).select("name_a", "name_b").distinct()


def fuzzy_matches(a: DataFrame, b: DataFrame, cutoff: float, measure: str = "lcs") -> DataFrame:
    """(name_a, name_b, score): the best name of b per name of a with a score ≥ cutoff (percent); ties take the first name.

    ``lcs`` is 100·2·LCS/(la+lb), ``levenshtein`` 100·(1 − distance/longer).
    Distinct names meet through an index that loses no pair that can reach the
    cutoff, of segments or, if the cutoff leaves no whole segment, of characters;
    candidates are then scored exactly. Names without a letter match nothing.
    """
    c = cutoff / 100.0
    a, b = [durable(df.select(n).distinct()) for df, n in ((a, "name_a"), (b, "name_b"))]
    pairs = (_by_segments if c / (2.0 - c) > 0.5 else _by_characters)(a, b, c, measure)
    if measure == "lcs":
        score = st.lcs_ratio("name_a", "name_b")
    else:
        score = 100.0 * (1.0 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b")))
    best = pairs.withColumn("score", score).where(F.col("score") >= cutoff).groupBy("name_a").agg(
        F.min_by(F.struct("name_b", "score"), F.struct(-F.col("score"), "name_b")).alias("m"))
    return best.select("name_a", "m.name_b", "m.score")


def fuzzy_merge(a: DataFrame, b: DataFrame, key: str, cutoff: float = 1.0) -> DataFrame:
    """Rows of a with the best matching row of b, names compared in snake case; unmatched rows of a stay."""
    left = a.select([F.col(c).alias(f"{c}_a") for c in a.columns]).withColumn("_sa", sc.snake_case(F.col(f"{key}_a")))
    right = b.select([F.col(c).alias(f"{c}_b") for c in b.columns]).withColumn("_sb", sc.snake_case(F.col(f"{key}_b")))
    best = fuzzy_matches(left.select(F.col("_sa").alias("name_a")), right.select(F.col("_sb").alias("name_b")), cutoff)
    best = best.withColumnsRenamed({"name_a": "_sa", "name_b": "_sb"})
    return left.join(best, "_sa", "left").join(right, "_sb", "left").drop("_sa", "_sb")


def crash_reason(log: Column, missing: Column) -> Column:
    """Fixed phrases first, else the listed error messages that are not ignored, else a generic text."""
    out = None
    for phrase, reason in fixed.CRASH_PHRASES:
        hit = log.contains(phrase)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    # Only whole lines that hold an error mark meet the pattern: it backtracks badly on long text without one.
    marked = F.filter(F.split(log, "\n"), lambda x: x.contains("rror:"))
    pattern = r"(?s)([^.]*[Ee]rror):(.*)$"
    found = F.transform(F.filter(marked, lambda x: x.rlike(pattern)), lambda x: F.struct(
        F.regexp_extract(x, pattern, 1).alias("e"), F.regexp_extract(x, pattern, 2).alias("m")))
    def told(x: Column) -> Column:
        ignored = x["e"].isin(*fixed.IGNORED_ERRORS)
        for text in fixed.IGNORED_MESSAGES:
            ignored = ignored | x["m"].contains(text)
        return ~ignored
    texts = F.transform(F.filter(found, told), lambda x: F.concat(x["e"], F.lit(": "), x["m"]))
    return out.otherwise(F.when(F.size(texts) > 0, F.array_join(texts, ",")).otherwise(missing))


def preferences(answers: DataFrame, keys: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """Share of A with its exact interval, pooled share and error rate per study."""
    n = {a: F.count_if(F.col("answer") == a).alias(a) for a in ("A", "B", "yes", "unsure")}
    out = answers.groupBy(*keys).agg(*n.values(), F.count("*").alias("n"))
    out = out.withColumn("share", F.try_divide(F.col("A").cast("double"), F.col("A") + F.col("B"))).withColumn(
        "pooled", F.col("A") / F.col("n")).withColumn("error_rate", F.try_divide(F.col("yes").cast("double"), F.col("n") - F.col("unsure")))
    ci = F.when(F.col("A") + F.col("B") > 0, st.exact_interval("A", F.greatest(F.col("A") + F.col("B"), F.lit(1)), F.lit(alpha)))
    return out.withColumn("ci", ci).select(*keys, *n, "n", "share", "pooled", "error_rate", "ci.low", "ci.high")


def gpu_inventory(nodes: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """GPUs per type and partition."""
    return nodes.groupBy("gpu").pivot("partition", list(partitions)).agg(F.sum("n_gpu")).na.fill(0)


def node_lines(lines: DataFrame) -> DataFrame:
    """(node, partition, gres, total_mb) with gpu and n_gpu, null where the node has none, and n_cpus, the total after the last slash."""
    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract("gres", f"^(?:{pattern})$", i), F.lit(""))
    return lines.select("node", "partition", "total_mb", group(fixed.GRES_GPU, 1).alias("gpu"),
                        group(fixed.GRES_GPU, 2).cast("bigint").alias("n_gpu"), group(fixed.GRES_CPUS, 1).cast("bigint").alias("n_cpus"))


def nodes_with(nodes: DataFrame, gpus: Sequence[str] | None = None) -> DataFrame:
    """(gpu, node) once each, of the given types or of all; rows of the partition of all nodes do not count."""
    own = nodes.where((F.col("partition") != "all") & F.col("gpu").isNotNull())
    return (own if gpus is None else own.where(F.col("gpu").isin(*gpus))).select("gpu", "node").distinct()


def memory_per_cpu(nodes: DataFrame, shared: Sequence[str]) -> DataFrame:
    """(node, gb): whole gigabytes a processor of the nodes in shared partitions; the largest if lines differ, null without processors."""
    gb = F.try_divide(F.col("total_mb") / 1024, F.col("n_cpus")).cast("bigint")
    return nodes.where(F.col("partition").isin(*shared)).groupBy("node").agg(F.max(gb).alias("gb"))


def run_totals(jobs: DataFrame) -> DataFrame:
    """Scenes, succeeded scenes and generation time (coarse + populate + fine) per run."""
    made = F.col("stage").isin("coarse", "populate", "fine")
    per = jobs.groupBy("run", "scene").agg(F.bool_and(F.col("state") == "COMPLETED").alias("ok"), F.sum(F.when(made, F.col("elapsed_s")).otherwise(0)).alias("t"))
    return per.groupBy("run").agg(F.count("*").alias("n_scenes"), F.count_if("ok").alias("n_ok"), F.sum("t").alias("generation_s"))


def processing_order(items: DataFrame) -> DataFrame:
    """Add ``rank`` 0 for local folders, 1 for archives, else 2, and sort by it."""
    return items.withColumn("rank", F.when(F.col("has_folder"), 0).when(F.col("has_archive"), 1).otherwise(2)).orderBy("rank", "name")


def _glob(path: Column, glob: str) -> Column:
    """Whether a path as a whole meets a glob with * and ?."""
    return path.rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$")


def retention(files: DataFrame, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    """(path, action): the first matching rule in order decides; files without a rule are ``uncovered``.

    ``rules`` is configuration: (ord, glob, action).
    """
    action = F.when(F.lit(False), F.lit(""))
    for _, glob, name in sorted(rules):
        action = action.when(_glob(F.col("path"), glob), F.lit(name))
    return files.select("path", action.otherwise(F.lit("uncovered")).alias("action"))


def unmet_mandatory(files: DataFrame, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    """Mandatory globs without any file."""
    must = [glob for _, glob, name in sorted(rules) if name == "KEEP_MANDATORY"]
    if not must:
        return files.sparkSession.createDataFrame([], "glob string")
    met = files.agg(*[F.coalesce(F.bool_or(_glob(F.col("path"), glob)), F.lit(False)).alias(f"m{i}") for i, glob in enumerate(must)])
    pairs = F.array(*[F.struct(F.lit(glob).alias("glob"), F.col(f"m{i}").alias("met")) for i, glob in enumerate(must)])
    return met.select(F.explode(pairs).alias("g")).where(~F.col("g.met")).select("g.glob")

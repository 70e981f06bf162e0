"""Run-analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.operators import runs
from jointframe.queries.catalog import hash_sql, values
from jointframe.registry import query
from jointframe.session import Tables
from jointframe.sources import logs

JB, P = ad.jobs.sql, ad.parts.sql


def jobs(t: Tables) -> DataFrame:
    return ad.jobs(t).withColumn("start_s", F.unix_seconds(F.col("start").cast("timestamp")))


def peak(t: Tables) -> DataFrame:
    """Peak memory per job from the order lines."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_quantity").alias("gb"))


@query("J07", f"SELECT j.job_id, coalesce(m.gb, -1.0) AS gb FROM {JB} j LEFT JOIN (SELECT l_orderkey AS job_id, max(l_quantity) AS gb FROM lineitem GROUP BY 1) m USING (job_id)")
def peak_memory_join(t: Tables) -> DataFrame:
    return runs.with_peak_memory(jobs(t), peak(t)).select("job_id", "gb")


@query("J08", f"""
SELECT l.l_orderkey AS job_id, l.l_linenumber AS ord, round(100.0 * l.l_quantity * 100 / j.elapsed_s, 6) AS share FROM lineitem l
JOIN {JB} j ON j.job_id = l.l_orderkey AND j.state = 'COMPLETED'""")
def stage_share_of_job(t: Tables) -> DataFrame:
    stages = t.lineitem.selectExpr("l_orderkey AS job_id", "l_linenumber AS ord", "l_quantity * 100 AS secs")
    return runs.stage_shares(stages, jobs(t), ["job_id"]).select("job_id", "ord", F.round("share", 6).alias("share"))


@query("A15", f"""
SELECT stage, CAST(sum(elapsed_s) AS DOUBLE) / count(*) AS mean, {", ".join(f"round(quantile_cont(elapsed_s, {p}), 4) AS {n}" for n, p in runs.PERCENTILES.items())}
FROM {JB} GROUP BY stage""")
def stage_stats(t: Tables) -> DataFrame:
    out = runs.stage_statistics(jobs(t), ["stage"], "elapsed_s")
    return out.select("stage", "mean", *[F.round(n, 4).alias(n) for n in runs.PERCENTILES])


@query("A16 J17", f"""
WITH s AS (SELECT scene, priority AS step, stage, elapsed_s AS secs FROM {JB}), f AS (SELECT DISTINCT scene FROM {JB} WHERE state = 'COMPLETED'),
k AS (SELECT * FROM s WHERE scene IN (SELECT scene FROM f)),
p AS (SELECT step, stage, sum(secs) AS total, count(DISTINCT scene) AS n FROM k GROUP BY step, stage)
SELECT step, stage, CAST(total AS BIGINT) AS total, round(100.0 * total / (SELECT sum(total) FROM p), 6) AS pct_scene,
  round(100.0 * total / sum(total) OVER (PARTITION BY step), 6) AS pct_step, round(n / (SELECT count(*) FROM f), 6) AS occurrence FROM p""")
def stage_share(t: Tables) -> DataFrame:
    stages = jobs(t).select("scene", F.col("priority").alias("step"), "stage", F.col("elapsed_s").alias("secs"))
    done = jobs(t).where("state = 'COMPLETED'").select("scene").distinct()
    out = runs.stage_occurrence(stages, done)
    return out.select("step", "stage", "total", *[F.round(c, 6).alias(c) for c in ("pct_scene", "pct_step", "occurrence")])


@query("A17", f"""
WITH r AS (SELECT scene, job_id, epoch_us(start) // 1000000 AS s, elapsed_s AS e, row_number() OVER (PARTITION BY scene ORDER BY job_id) AS rn FROM {JB}),
g AS (SELECT scene, max(CASE WHEN rn = 1 THEN s END) AS t0, max(CASE WHEN rn = 1 THEN e END) AS c, max(CASE WHEN rn = 2 THEN e END) AS f,
  max(CASE WHEN rn > 2 THEN s + e END) AS t1 FROM r GROUP BY scene HAVING count(*) > 2)
SELECT scene, c AS coarse_s, f AS fine_s, t1 - t0 AS span_s, round(100.0 * c / nullif(t1 - t0, 0), 6) AS coarse_pct, round(100.0 * f / nullif(t1 - t0, 0), 6) AS fine_pct FROM g""")
def scene_durations(t: Tables) -> DataFrame:
    out = runs.scene_durations(jobs(t))
    return out.withColumns({c: F.round(c, 6) for c in ("coarse_pct", "fine_pct")})


_TAIL = f"""
m AS (SELECT j.*, coalesce(m.gb, -1.0) AS gb FROM {JB} j LEFT JOIN (SELECT l_orderkey AS job_id, max(l_quantity) AS gb FROM lineitem GROUP BY 1) m USING (job_id)),
a AS (SELECT *, max(CASE WHEN NOT contains(stage, 'render_2') THEN job_id END) OVER (PARTITION BY scene) AS k FROM m),
b AS (SELECT *, max(CASE WHEN NOT contains(stage, 'render_1') THEN job_id END) OVER (PARTITION BY scene) AS k2 FROM a WHERE job_id <= k),
c AS (SELECT * FROM b WHERE job_id <= k2)"""


@query("A18", f"""WITH {_TAIL}
SELECT scene, max(gb) AS max_gb, CAST(sum(elapsed_s) AS BIGINT) AS elapsed_s, CAST(sum(elapsed_s * cpus) AS BIGINT) AS cpu_s, CAST(sum(elapsed_s * gpus) AS BIGINT) AS gpu_s FROM c GROUP BY scene""")
def resource_rollup(t: Tables) -> DataFrame:
    """Resources per scene without trailing resample jobs."""
    rows = runs.drop_tail(runs.with_peak_memory(jobs(t), peak(t)), ["render_2", "render_1"])
    return runs.resources(rows)


@query("A19", """
WITH q AS (SELECT quantile_cont(l_extendedprice * 100, 0.99) AS c FROM lineitem), k AS (SELECT l_extendedprice * 100 AS v FROM lineitem, q WHERE l_extendedprice * 100 < c),
m AS (SELECT max(v) > 1e6 AS large FROM k)
SELECT CAST(floor((CASE WHEN large THEN v / 1e6 ELSE v END) / 0.25) AS BIGINT) AS bin, CASE WHEN large THEN 'M' ELSE '' END AS unit, CAST(count(*) AS BIGINT) AS n FROM k, m GROUP BY ALL""")
def trimmed_hist(t: Tables) -> DataFrame:
    return runs.trimmed_histogram(t.lineitem.select((F.col("l_extendedprice") * 100).alias("v")), "v", 0.25)


@query("A20", f"""
SELECT coalesce(priority, 'all') AS reason, coalesce(stage, 'all') AS stage, coalesce(node, 'all') AS scenetype, CAST(count(*) AS BIGINT) AS n FROM {JB}
WHERE state = 'FAILED' GROUP BY CUBE (priority, stage, node)""")
def crash_cube(t: Tables) -> DataFrame:
    crashes = jobs(t).where("state = 'FAILED'").select(F.col("priority").alias("reason"), "stage", F.col("node").alias("scenetype"))
    return runs.crash_frequency(crashes).select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("reason", "stage", "scenetype")], "n")


@query("A21", f"SELECT coalesce(state, 'all') AS state, coalesce(stage, 'all') AS stage, CAST(count(*) AS BIGINT) AS n FROM {JB} GROUP BY ROLLUP (state, stage)")
def state_rollup(t: Tables) -> DataFrame:
    return jobs(t).rollup("state", "stage").agg(F.count("*").alias("n")).select(
        *[F.coalesce(c, F.lit("all")).alias(c) for c in ("state", "stage")], "n")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("A22", f"""
SELECT concat('gpu', CAST(size % 7 AS STRING)) AS gpu, {", ".join(f"CAST(coalesce(sum(label) FILTER (factory = '{f}'), 0) AS BIGINT) AS {f}" for f in TYPES)} FROM {P} GROUP BY size % 7""")
def inventory_pivot(t: Tables) -> DataFrame:
    rows = ad.parts(t).select(F.concat(F.lit("gpu"), (F.col("size") % 7).cast("string")).alias("gpu"), F.col("factory").alias("partition"), F.col("label").alias("n_gpu"))
    return runs.gpu_inventory(rows, TYPES)


_NODES = """SELECT DISTINCT concat('node', CAST(l_suppkey AS STRING)) AS node,
  CASE l_linenumber % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'own' WHEN 2 THEN 'lent' ELSE 'guests' END AS "partition",
  concat('1/2/0/', CAST(l_suppkey % 60 + 4 AS STRING), CASE WHEN l_suppkey % 5 = 0 THEN '(null)' ELSE concat('gpu:rtx_', CAST(l_suppkey % 7 AS STRING), ':', CAST(l_suppkey % 8 + 1 AS STRING), '(S:0-1)') END) AS gres,
  64000 + l_suppkey * 1000 AS total_mb FROM lineitem WHERE l_suppkey % 3 > 0 OR l_linenumber % 4 = 0"""
_NODE_GROUPS = """g AS (SELECT *, regexp_extract(gres, '^.*gpu:([^:]+):([0-9]+).*$', 1) AS gpu, regexp_extract(gres, '^.+/([0-9]+)[^/]+$', 1) AS cpus FROM n)"""


def _nodes(t: Tables) -> DataFrame:
    return runs.node_lines(t.spark.sql(_NODES.replace('"partition"', "`partition`").replace("FROM lineitem", "FROM {lines}"), lines=t.lineitem))


@query("A22", f"""
WITH n AS ({_NODES}), {_NODE_GROUPS} SELECT DISTINCT gpu, node FROM g WHERE "partition" <> 'all' AND gpu <> ''""")
def gpu_nodes(t: Tables) -> DataFrame:
    """The nodes of each GPU type."""
    return runs.nodes_with(_nodes(t))


@query("A22", f"""
WITH n AS ({_NODES}), {_NODE_GROUPS} SELECT node, max(CAST(trunc(total_mb / 1024.0 / CAST(cpus AS BIGINT)) AS BIGINT)) AS gb FROM g WHERE "partition" IN ('own', 'lent') GROUP BY node""")
def node_memory(t: Tables) -> DataFrame:
    """Memory a processor of the nodes in shared partitions."""
    return runs.memory_per_cpu(_nodes(t), ["own", "lent"])


@query("J26 S23", f"""
SELECT j.job_id, coalesce(n.part, 'none') AS part FROM {JB} j LEFT JOIN (SELECT concat('node', CAST(s_suppkey AS STRING)) AS node, concat('p', CAST(s_nationkey AS STRING)) AS part FROM supplier) n USING (node)""")
def job_partition(t: Tables) -> DataFrame:
    nodes = t.supplier.selectExpr("concat('node', CAST(s_suppkey AS STRING)) AS node", "concat('p', CAST(s_nationkey AS STRING)) AS part")
    return jobs(t).join(nodes, "node", "left").select("job_id", F.coalesce("part", F.lit("none")).alias("part"))


@query("S24 A23", """
SELECT source AS study, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS a, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS BIGINT) AS b,
  CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS unsure, count(*) FILTER (quality = 1 AND toxic = 0) / (count(*) FILTER (toxic = 0)) AS share,
  count(*) FILTER (quality = 1 AND toxic = 0) / count(*) AS pooled FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def preference_share(t: Tables) -> DataFrame:
    return _survey(t).select("study", F.col("A").alias("a"), F.col("B").alias("b"), "unsure", "share", "pooled")


_CHANCES = "[exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})) FOR k IN range(0, n + 1)]"
_TAIL = "list_sum(list_filter({t}, lambda x: x <= {t}[a + 1] * (1 + 1e-7)))"


# Both ends by bisection on the two-sided test: below and above the share, where counts as unlikely as the one seen have one percent.
@query("A23 F05", f"""
WITH RECURSIVE c AS (SELECT source AS study, count(*) FILTER (quality = 1 AND toxic = 0) AS a, count(*) FILTER (toxic = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
b(study, a, n, i, l0, l1, h0, h1) AS (SELECT study, a, n, 0, 0.0::DOUBLE, a / n, a / n, 1.0::DOUBLE FROM c WHERE n > 0
  UNION ALL SELECT study, a, n, i + 1, CASE WHEN {_TAIL.format(t="low")} < 0.01 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN {_TAIL.format(t="low")} < 0.01 THEN l1 ELSE (l0 + l1) / 2 END,
    CASE WHEN {_TAIL.format(t="high")} < 0.01 THEN h0 ELSE (h0 + h1) / 2 END, CASE WHEN {_TAIL.format(t="high")} < 0.01 THEN (h0 + h1) / 2 ELSE h1 END
  FROM (SELECT *, {_CHANCES.format(p="greatest((l0 + l1) / 2, 1e-300)")} AS low, {_CHANCES.format(p="least((h0 + h1) / 2, 1 - 1e-16)")} AS high FROM b) WHERE i < 50)
SELECT c.study, a / n AS share, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM c LEFT JOIN (SELECT study, CASE WHEN a = 0 THEN 0.0 ELSE (l0 + l1) / 2 END AS low, CASE WHEN a = n THEN 1.0 ELSE (h0 + h1) / 2 END AS high FROM b WHERE i = 50) USING (study)""")
def preference_interval(t: Tables) -> DataFrame:
    """Exact 99 % intervals."""
    return _survey(t).select("study", "share", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _survey(t: Tables) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "Not Sure").when(F.col("quality") == 1, "Program A is better").otherwise("Program B is better")
    rows = t.labels.join(t.documents.select("doc_id", F.col("source").alias("study")), "doc_id").select("study", label.alias("label"))
    return runs.preferences(logs.survey_answers(rows), ["study"])


@query("W04", f"""
WITH r AS (SELECT scene, job_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY scene ORDER BY job_id) AS d_elapsed_s, cpus - lag(cpus) OVER (PARTITION BY scene ORDER BY job_id) AS d_cpus
  FROM {JB} WHERE state <> 'FAILED') SELECT * FROM r WHERE d_elapsed_s IS NOT NULL""")
def stage_delta(t: Tables) -> DataFrame:
    rows = jobs(t).withColumn("ran", F.col("state") != "FAILED")
    out = runs.stage_deltas(rows, ["scene"], ["job_id"], ["elapsed_s", "cpus"])
    return out.select("scene", "job_id", "d_elapsed_s", "d_cpus").where("d_elapsed_s is not null")


@query("W04", f"""
WITH r AS (SELECT scene, job_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY scene ORDER BY job_id) AS d_elapsed_s, cpus - lag(cpus) OVER (PARTITION BY scene ORDER BY job_id) AS d_cpus
  FROM {JB} WHERE state <> 'FAILED') SELECT * FROM r WHERE d_cpus <> 0""")
def stage_changes(t: Tables) -> DataFrame:
    """Stages that ran and changed the number of CPUs."""
    rows = jobs(t).withColumn("ran", F.col("state") != "FAILED")
    return runs.stage_changes(rows, ["scene"], ["job_id"], ["elapsed_s", "cpus"], "cpus").select("scene", "job_id", "d_elapsed_s", "d_cpus")


@query("J09", f"""
WITH a AS (SELECT scene AS name, min(stage) AS category, sum(elapsed_s) AS secs FROM {JB} WHERE gpus = 0 GROUP BY scene),
b AS (SELECT scene AS name, sum(elapsed_s) AS secs FROM {JB} WHERE gpus = 1 GROUP BY scene)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.category, '-') AS category, CAST(coalesce(a.secs, -1) AS BIGINT) AS secs_a, CAST(coalesce(b.secs, -1) AS BIGINT) AS secs_b
FROM a FULL OUTER JOIN b ON a.name = b.name""")
def compare_runs(t: Tables) -> DataFrame:
    def run(g: int) -> DataFrame:
        return jobs(t).where(F.col("gpus") == g).groupBy(F.col("scene").alias("name")).agg(F.min("stage").alias("category"), F.sum("elapsed_s").alias("secs"))
    out = runs.compare_runs(run(0), run(1), "name", ["secs"])
    return out.select("name", F.coalesce("category", F.lit("-")).alias("category"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("secs_a", "secs_b")])


_NA = f"(SELECT DISTINCT concat(name, ' ', brand) AS name_a FROM {P})"
_NB = f"(SELECT DISTINCT concat(substr(name, 2), 's ', brand) AS name_b FROM {P})"


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = ad.parts(t)
    a = p.select(F.concat_ws(" ", "name", "brand").alias("name_a"))
    return a, p.select(F.concat(F.expr("substr(name, 2)"), F.lit("s "), F.col("brand")).alias("name_b"))


@query("J10", f"""
WITH s AS (SELECT name_a, name_b, 100.0 * (1.0 - CAST(levenshtein(name_a, name_b) AS DOUBLE) / greatest(length(name_a), length(name_b))) AS score FROM {_NA}, {_NB})
SELECT name_a, name_b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) AS rn FROM s WHERE score >= 85) WHERE rn = 1""")
def fuzzy_match(t: Tables) -> DataFrame:
    return runs.fuzzy_matches(*_names(t), 85.0, "levenshtein").withColumn("score", F.round("score", 6))


# Longest common subsequence over the bits of a row: bit i is 0 where letter i of name_a ends a longer one.
@query("J10 F05", f"""
WITH a AS (SELECT name_a, length(name_a) AS la, (CAST(1 AS BIGINT) << length(name_a)) - 1 AS everything, string_split(name_a, '') AS letters FROM {_NA}),
m AS (SELECT name_a, map_from_entries(list((letter, bits))) AS bits_of FROM (SELECT name_a, letters[i] AS letter, CAST(sum(CAST(1 AS BIGINT) << (i - 1)) AS BIGINT) AS bits FROM a, unnest(range(1, la + 1)) u(i) GROUP BY ALL) GROUP BY name_a),
b AS (SELECT name_b, length(name_b) AS lb, string_split(name_b, '') AS letters FROM {_NB}),
p AS (SELECT name_a, name_b, la, lb, la - bit_count(list_reduce(list_prepend(everything, [coalesce(bits_of[c], 0) FOR c IN b.letters]),
  lambda r, h: ((r + (r & h)) | (r - (r & h))) & everything)) AS common FROM a JOIN m USING (name_a), b WHERE 2 * least(la, lb) >= 0.88 * (la + lb)),
s AS (SELECT *, 200.0 * CAST(common AS DOUBLE) / (la + lb) AS score FROM p)
SELECT name_a, name_b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b) AS rn FROM s WHERE score >= 88) WHERE rn = 1""")
def fuzzy_match_lcs(t: Tables) -> DataFrame:
    """By the ratio of the longest common subsequence."""
    return runs.fuzzy_matches(*_names(t), 88.0, "lcs").withColumn("score", F.round("score", 6))


_LOG = ("concat(text, CASE doc_id % 9 WHEN 0 THEN ' System is out of GPU memory' WHEN 1 THEN ' DUE TO TIME LIMIT' WHEN 2 THEN ' SIGCONT' "
        "WHEN 3 THEN '{nl}ValueError: bad shape{nl}srun: error: task 0{nl}KeyError: none{nl}' WHEN 4 THEN '{nl}CalledProcessError: exit 1{nl}' "
        "WHEN 5 THEN '{nl}MemError: Not freed memory blocks 3{nl}' WHEN 6 THEN '{nl}TypeError: last line' WHEN 7 THEN '{nl}AError: b{nl}{nl}srun: error: x{nl}OSError: disk' ELSE '' END)")
_SQL_LOG = "(SELECT doc_id, " + _LOG.replace("{nl}", "' || chr(10) || '") + " AS log FROM documents)"
_SQL_CASE = " ".join(f"WHEN contains(log, '{p}') THEN '{r}'" for p, r in fixed.CRASH_PHRASES)


@query("P28", f"""
WITH e AS (SELECT doc_id, log, regexp_extract_all(log || chr(10), '([^\\.\\n]*[Ee]rror):(.*)\\n', 1) AS e, regexp_extract_all(log || chr(10), '([^\\.\\n]*[Ee]rror):(.*)\\n', 2) AS m FROM {_SQL_LOG}),
k AS (SELECT doc_id, log, list_filter(list_zip(e, m), lambda x: x[1] NOT IN ('FailedProcessError', 'CalledProcessError', 'srun: error', 'FailedJobError') AND NOT contains(x[2], 'Not freed memory blocks')) AS z FROM e)
SELECT doc_id, CASE {_SQL_CASE} WHEN len(z) > 0 THEN array_to_string(list_transform(z, lambda x: concat(x[1], ': ', x[2])), ',') ELSE 'unknown' END AS reason FROM k""")
def crash_reasons(t: Tables) -> DataFrame:
    log = F.expr(_LOG.replace("{nl}", "\\n"))
    return t.documents.select("doc_id", log.alias("log")).select("doc_id", runs.crash_reason(F.col("log"), F.lit("unknown")).alias("reason"))


@query("O02", f"""
SELECT stage, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, stage) AS BIGINT) AS place FROM {JB} GROUP BY stage""")
def report_ordering(t: Tables) -> DataFrame:
    """Report rows with their place; there is one row per stage name."""
    from pyspark.sql import Window
    per = jobs(t).groupBy("stage").agg(F.count("*").alias("n"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "stage")).cast("bigint"))


@query("O04", f"""
SELECT priority AS reason, job_id FROM (SELECT priority, job_id, row_number() OVER (PARTITION BY priority ORDER BY {hash_sql("'s1'", "job_id")}, job_id) AS rn FROM {JB} WHERE state = 'FAILED') WHERE rn <= 10""")
def crash_examples(t: Tables) -> DataFrame:
    rows = jobs(t).where("state = 'FAILED'").select(F.col("priority").alias("reason"), "job_id")
    return runs.sample_per_group(rows, ["reason"], ["job_id"], 10, "s1")


@query("O05", f"SELECT page_id, url FROM pages ORDER BY {hash_sql(chr(39) + 's2' + chr(39), 'page_id')}, page_id LIMIT 50")
def random_files(t: Tables) -> DataFrame:
    return runs.random_rows(t.pages.select("page_id", "url"), ["page_id"], 50, "s2")


@query("O08", """
SELECT c_custkey AS name, CAST(CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS rank FROM customer""")
def release_order(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("c_custkey AS name", "c_acctbal > 0 AND c_custkey % 3 = 0 AS has_folder", "c_custkey % 2 = 0 AS has_archive")
    return runs.processing_order(rows).select("name", "rank")


@query("O10", "SELECT split_part(url, '/', 3) AS folder, min(url) AS path FROM pages GROUP BY 1")
def one_per_folder(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.split("url", "/")[2].alias("folder")).agg(F.min("url").alias("path"))


GLOBS = [(0, "*index*", "KEEP_MANDATORY"), (1, "http://*.com/*", "KEEP"), (2, "https://m.*", "DELETE"), (3, "http*://*/en/*", "DELETE"), (4, "*#absent#*", "KEEP_MANDATORY")]
_RX = "(VALUES (0, '^.*index.*$', 'KEEP_MANDATORY'), (1, '^http://.*\\.com/.*$', 'KEEP'), (2, '^https://m\\..*$', 'DELETE'), (3, '^http.*://.*/en/.*$', 'DELETE'))"


@query("P27 U07", f"""
WITH f AS (SELECT DISTINCT url FROM pages), h AS (SELECT f.url, r.action, row_number() OVER (PARTITION BY f.url ORDER BY r.ord) AS rn FROM f JOIN {_RX} r(ord, rx, action) ON regexp_matches(f.url, r.rx))
SELECT f.url AS path, coalesce(h.action, 'uncovered') AS action FROM f LEFT JOIN h ON h.url = f.url AND h.rn = 1""")
def file_retention(t: Tables) -> DataFrame:
    return runs.retention(t.pages.select(F.col("url").alias("path")).distinct(), GLOBS)


@query("P27", "SELECT g AS glob FROM (VALUES ('*index*', 'index'), ('*#absent#*', '#absent#')) v(g, s) WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(url, s))")
def unmet_mandatory(t: Tables) -> DataFrame:
    return runs.unmet_mandatory(t.pages.select(F.col("url").alias("path")), GLOBS)


@query("A49", f"""
WITH p AS (SELECT priority AS run, scene, bool_and(state = 'COMPLETED') AS ok, sum(CASE WHEN stage IN ('coarse', 'populate', 'fine') THEN elapsed_s ELSE 0 END) AS t FROM {JB} GROUP BY 1, 2)
SELECT run, CAST(count(*) AS BIGINT) AS n_scenes, CAST(count(*) FILTER (ok) AS BIGINT) AS n_ok, CAST(sum(t) AS BIGINT) AS generation_s FROM p GROUP BY run""")
def run_totals(t: Tables) -> DataFrame:
    return runs.run_totals(jobs(t).withColumn("run", F.col("priority")))


# Names of all kinds from the parts; both engines read the expression.
_NAME = ("CASE p_partkey % 7 WHEN 0 THEN concat(split_part(p_name, ' ', 1), 'Factory(', CAST(p_partkey AS STRING), ').spawn_placeholder_', lower(split_part(p_type, ' ', 2)), '(', CAST(p_size AS STRING), ')') "
         "WHEN 1 THEN concat(split_part(p_name, ' ', 1), 'Factory(', CAST(p_partkey AS STRING), ').spawn_asset(', CAST(p_size AS STRING), ')') "
         "WHEN 2 THEN concat('scatter:', split_part(p_name, ' ', 1), '_fine(', CAST(p_size AS STRING), ')') WHEN 3 THEN concat(split_part(p_type, ' ', 1), '_fine') "
         "WHEN 4 THEN concat(lower(split_part(p_type, ' ', 2)), '_', CAST(p_partkey % 3 AS STRING), '/', CAST(p_size AS STRING)) WHEN 5 THEN p_name ELSE '' END")


def _full(pattern: str, group: int, name: str = "name") -> str:
    return f"CASE WHEN regexp_full_match({name}, '{pattern}') THEN regexp_extract({name}, '^(?:{pattern})$', {group}) END"


@query("P30", f"""
WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part),
g AS (SELECT *, coalesce({", ".join(_full(p, 1) for p in fixed.GROUP_NAMES)}) AS grp FROM n),
s AS (SELECT *, coalesce(grp, name) AS whole FROM g),
w AS (SELECT *, replace(replace(coalesce({", ".join(_full(p, 1, "whole") for p in fixed.SEMANTIC_NAMES)}), 'Factory', ''), '_fine', '') AS word FROM s)
SELECT p_partkey, name, {", ".join(f"{_full(fixed.ASSET_NAME, i)} AS {c}" for i, c in enumerate(("factory", "factory_seed", "kind", "asset_seed"), 1))}, grp,
  array_to_string(list_transform(string_split(word, '_'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '_') AS semantic,
  split_part(name, '_', 1) AS room_type, TRY_CAST(split_part(split_part(name, '/', 1), '_', 2) AS BIGINT) AS room_level FROM w""")
def name_parsing(t: Tables) -> DataFrame:
    n = F.col("name")
    parts = [*sc.asset_name(n), sc.group_name(n), sc.semantic_name(n), *sc.room_name(n)]
    names = ("factory", "factory_seed", "kind", "asset_seed", "grp", "semantic", "room_type", "room_level")
    return t.part.select("p_partkey", F.expr(_NAME).alias("name")).select("p_partkey", "name", *[c.alias(k) for c, k in zip(parts, names, strict=True)])


@query("X28", f"""
SELECT job_id, printf('%02d:%02d:%02d', elapsed_s // 3600, elapsed_s % 3600 // 60, elapsed_s % 60) AS clock,
  CASE WHEN elapsed_s < 1024 THEN printf('%.1fB', CAST(elapsed_s AS DOUBLE)) WHEN elapsed_s < 1048576 THEN printf('%.1fKiB', elapsed_s / 1024.0) ELSE printf('%.1fMiB', elapsed_s / 1048576.0) END AS bytes FROM {JB}""")
def value_formatting(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", sc.clock_text(F.col("elapsed_s")).alias("clock"), sc.byte_text(F.col("elapsed_s")).alias("bytes"))

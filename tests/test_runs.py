import numpy as np
import pytest
from pyspark.sql import functions as F

from jointframe.functions import scalar as sc
from jointframe.functions import stats as st
from jointframe.operators import plan as pl
from jointframe.operators import runs


def two_sided(k, n, p):
    from math import comb

    pmf = np.array([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
    return pmf[pmf <= pmf[k] * (1 + 1e-7)].sum()


@pytest.mark.parametrize("k,n,p", [(3, 10, 0.2), (7, 10, 0.5), (0, 12, 0.1), (12, 12, 0.7), (20, 50, 0.5), (5, 40, 0.3)])
def test_binomial_test(k, n, p):
    assert st.binomial_test(k, n, p) == pytest.approx(two_sided(k, n, p), rel=1e-6)


@pytest.mark.parametrize("k,n", [(3, 10), (25, 60), (0, 8), (8, 8)])
def test_interval_inverts_the_test(k, n):
    low, high = st.binomial_interval(k, n, 0.01)
    assert low <= k / n <= high
    if k > 0:
        assert two_sided(k, n, low + 1e-6) >= 0.01 * 0.999 and two_sided(k, n, max(low - 1e-3, 1e-9)) < 0.01 * 1.6
    if k < n:
        assert two_sided(k, n, high - 1e-6) >= 0.01 * 0.999


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("measure", ["lcs", "levenshtein"])
def test_fuzzy_brute_force(spark, measure):
    rng = np.random.default_rng(1)
    def word():
        return "".join(rng.choice(list("abcdeexyz_"), rng.integers(4, 12)))
    a = sorted({word() for _ in range(60)})
    b = sorted({w[: -1] + "q" if i % 2 else word() for i, w in enumerate(a)})
    A, B = (spark.createDataFrame([(w,) for w in ws], f"name_{t} string") for ws, t in ((a, "a"), (b, "b")))
    if measure == "lcs":
        score = {(x, y): 200.0 * lcs(x, y) / (len(x) + len(y)) for x in a for y in b}
    else:
        rows = A.crossJoin(B).select("name_a", "name_b", F.levenshtein("name_a", "name_b").alias("d")).collect()
        score = {(r.name_a, r.name_b): 100.0 * (1 - r.d / max(len(r.name_a), len(r.name_b))) for r in rows}
    for cutoff in (60.0, 85.0):
        want = {}
        for x in a:
            best = min(((-score[x, y], y) for y in b if score[x, y] >= cutoff), default=None)
            if best:
                want[x] = best[1]
        assert {r.name_a: r.name_b for r in runs.fuzzy_matches(A, B, cutoff, measure).collect()} == want


@pytest.mark.parametrize("measure", ["lcs", "levenshtein"])
def test_segment_candidates_stay_few(spark, measure):
    """Names with a brand in common: four times the names, no more candidates for each."""
    rng = np.random.default_rng(3)
    def names(n):
        return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 16)) + f" Brand#{i % 5}" for i in range(n)]
    per = []
    for n in (300, 1200):
        x = names(n)
        a = spark.createDataFrame([(v,) for v in x], "name_a string")
        b = spark.createDataFrame([(v[:4] + "-" + v[5:],) for v in x], "name_b string")
        pairs = runs._by_segments(a, b, 0.9, measure).collect()
        assert {(v, v[:4] + "-" + v[5:]) for v in x} <= {tuple(r) for r in pairs}
        per.append(len(pairs) / n)
    assert per[1] < 3 and per[1] < 2 * per[0]


def test_fuzzy_merge_keeps_unmatched(spark):
    a = spark.createDataFrame([("run/BigTree", 1), ("run/zzz", 2)], "name string, v int")
    b = spark.createDataFrame([("other/big_tree", 7)], "name string, w int")
    got = {r.name_a: r.w_b for r in runs.fuzzy_merge(a, b, "name", 80.0).collect()}
    assert got == {"run/BigTree": 7, "run/zzz": None}


def test_bezier(spark):
    df = spark.createDataFrame([(float(t), 0.0, 1.0, 2.0, 3.0, 0.0, 1.0, 2.0, 3.0) for t in (0, 1, 1.5, 3)], ", ".join(f"c{i} double" for i in range(9)))
    got = [r.v for r in df.select(st.bezier_value(*[f"c{i}" for i in range(9)]).alias("v")).collect()]
    assert got == pytest.approx([0, 1, 1.5, 3], abs=1e-9)


def test_shards_cover_the_plan_once(spark):
    df = pl.shard(spark.range(23), ["id"], 5).groupBy("shard").count().orderBy("shard").collect()
    assert [(r.shard, r["count"]) for r in df] == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 3)]


def test_draws_do_not_depend_on_partitions(spark):
    k = F.col("id")
    a = spark.range(0, 200, 1, 2).select(k, sc.normal(k).alias("z")).orderBy("id").collect()
    b = spark.range(0, 200, 1, 7).repartition(5).select(k, sc.normal(k).alias("z")).orderBy("id").collect()
    assert a == b
    z = np.array([r.z for r in spark.range(5000).select(sc.normal(k).alias("z")).collect()])
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


def test_round_robin(spark):
    got = [r.config for r in pl.round_robin(spark.range(7), "id", [("a", 2), ("b", 1)]).orderBy("id").collect()]
    assert got == ["a", "a", "b", "a", "a", "b", "a"]
    with pytest.raises(ValueError):
        pl.round_robin(spark.range(2), "id", [("a", 0.5)])


def test_selector_last_ordinal(spark):
    cols = "obj int, factory string, joint string, type string, lower double, upper double, ax0 double, ax1 double, ax2 double, depth int"
    j = spark.createDataFrame([(1, "f", n, "prismatic", 0., 1., 1., 0., 0., d) for n, d in (("a", 1), ("b", 2), ("c", 2))], cols)
    sel = spark.createDataFrame([("f", 0, "prismatic", "ordinal", "-1"), ("f", 1, "prismatic", "ordinal", "0"), ("f", 2, "revolute", "all", "")],
                                "factory string, mode int, type string, kind string, arg string")
    got = sorted((r.mode, r.joint) for r in pl.select_joints(j, sel, ["obj"]).collect())
    assert got == [(0, "c"), (1, "a"), (2, "a"), (2, "b"), (2, "c")]


def test_palette_range_and_share(spark):
    comps = [(0.7, (0.1, 0.5, 0.6), (0.0,) * 9), (0.3, (0.6, 0.4, 0.5), (0.0,) * 9)]
    rows = spark.range(4000).select(*[c.alias(n) for c, n in zip(sc.palette_colour(comps, F.col("id")), "rgb")]).toPandas()
    assert rows.min().min() >= 0 and rows.max().max() <= 1
    assert rows.value_counts().iloc[0] / 4000 == pytest.approx(0.7, abs=0.03)


def test_last_line_of_a_log_counts(spark):
    logs = spark.createDataFrame([(1, "a\nKeyError: x"), (2, "a\nKeyError: x\n"), (3, ""), (4, "srun: error: y\nOSError: z")], "id int, log string")
    got = {r.id: r.reason for r in logs.select("id", runs.crash_reason(F.col("log"), F.lit("unknown")).alias("reason")).collect()}
    assert got == {1: "KeyError:  x", 2: "KeyError:  x", 3: "unknown", 4: "OSError:  z"}


def test_beta_of_large_counts():
    assert abs(st.beta_cdf(1e10, 1e10 + 1, 0.5) - 0.5) < 4e-6
    near = st.beta_cdf(999.0, 1500.0, 0.41), st.beta_cdf(1001.0, 1500.0, 0.41)
    assert near[0] > st.beta_cdf(1000.0, 1500.0, 0.41) > near[1]


def test_globs_meet_whole_paths(spark):
    files = spark.createDataFrame([("a/b.txt",), ("a/b.txt.bak",), ("x.y",)], "path string")
    rules = [(1, "*.txt", "KEEP"), (0, "a/?.txt", "DELETE"), (2, "x?y", "KEEP_MANDATORY"), (3, "none", "KEEP_MANDATORY")]
    assert {tuple(r) for r in runs.retention(files, rules).collect()} == {("a/b.txt", "DELETE"), ("a/b.txt.bak", "uncovered"), ("x.y", "KEEP_MANDATORY")}
    assert [r[0] for r in runs.unmet_mandatory(files, rules).collect()] == ["none"]
    assert runs.unmet_mandatory(files, []).count() == 0


def test_node_listing(spark):
    rows = [("n1", "own", "1/2/0/16gpu:a_1:4(S:0-1)", 65536), ("n1", "all", "1/2/0/16gpu:b:2", 65536), ("n2", "guests", "0/0/0/8gpu:a_1:1", 1000),
            ("n3", "own", "0/0/0/0(null)", 1000), ("n4", "lent", "0/0/0/12(null)", 40000), ("n5", "all", "0/0/0/8gpu:a_1:1", 1000), (None, "own", None, None)]
    nodes = runs.node_lines(spark.createDataFrame(rows, "node string, partition string, gres string, total_mb long"))
    assert {tuple(r) for r in runs.nodes_with(nodes).collect()} == {("a_1", "n1"), ("a_1", "n2")}
    assert runs.nodes_with(nodes, ["b"]).count() == 0
    assert {tuple(r) for r in runs.memory_per_cpu(nodes, ["own", "lent"]).collect()} == {("n1", 4), ("n3", None), ("n4", 3), (None, None)}


def test_named_views(spark):
    every = [f"{v}_{w}.mp4" for v in ("front", "side", "back", "threequarter") for w in ("bg", "nobg")]
    files = [(1, n) for n in every] + [(2, n) for n in every[1:]] + [(2, every[1]), (2, "front_bg.png"), (3, None), (5, every[0])]
    folders = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "obj long")
    df = spark.createDataFrame(files, "obj long, name string")
    assert {tuple(r) for r in pl.named_views_complete(folders, df, ["obj"]).collect()} == {(1, 8, True), (2, 7, False), (3, 0, False), (4, 0, False)}
    assert {r.obj for r in pl.named_views_complete(folders, df, ["obj"], variants=["nobg"]).where("complete").collect()} == {1, 2}

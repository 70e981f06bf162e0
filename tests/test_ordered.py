"""Ordered operators against pandas, with one key holding most rows and several blocks per key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jointframe.plans import ordered as o


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 9, n)), "t": rng.permutation(n), "v": rng.integers(0, 40, n)})
    return pdf.astype("int64")


def sorted_rows(df, by=("k", "t")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_hot_key_is_split(spark, rows, many_blocks):
    blocks = o.in_blocks(spark.createDataFrame(rows), ["k"], ["t"]).where("k = 0").select("_blk").distinct().count()
    assert blocks > 1


def test_ranked(spark, rows, many_blocks):
    got = sorted_rows(o.ranked(spark.createDataFrame(rows), ["k"], ["t"]))
    want = rows.sort_values(["k", "t"]).groupby("k").cumcount() + 1
    assert (got["rn"].to_numpy() == want.to_numpy()).all()


def test_ranked_without_keys(spark, rows, many_blocks):
    got = o.ranked(spark.createDataFrame(rows), [], ["t"]).toPandas().sort_values("t")
    assert got["rn"].tolist() == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(spark, rows, many_blocks, inclusive):
    got = sorted_rows(o.running_sum(spark.createDataFrame(rows), ["k"], ["t"], {"s": F.col("v")}, inclusive))
    s = rows.sort_values(["k", "t"])
    want = s.groupby("k")["v"].cumsum() - (0 if inclusive else s["v"])
    assert (got["s"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours(spark, rows, many_blocks, ahead):
    got = sorted_rows(o.neighbours(spark.createDataFrame(rows), ["k"], ["t"], {"p": "v"}, ahead))
    want = rows.sort_values(["k", "t"]).groupby("k")["v"].shift(-1 if ahead else 1)
    assert np.array_equal(got["p"].to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_running_max(spark, rows, many_blocks):
    got = sorted_rows(o.running_max(spark.createDataFrame(rows), ["k"], ["t"], "v", "m"))
    assert (got["m"].to_numpy() == rows.sort_values(["k", "t"]).groupby("k")["v"].cummax().to_numpy()).all()


def test_exact_percentiles(spark, rows, many_blocks):
    got = o.exact_percentiles(spark.createDataFrame(rows), ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}).toPandas().set_index("k")
    for k, part in rows.groupby("k"):
        for name, p in {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(part["v"], p))


def test_asof(spark, rows, many_blocks):
    facts = rows[rows["t"] % 3 == 0].rename(columns={"v": "value"})
    probes = rows[rows["t"] % 3 != 0][["k", "t"]].assign(ident=lambda d: d["t"])
    got = o.asof(spark.createDataFrame(probes), spark.createDataFrame(facts), ["k"], "t", "value", "ident").toPandas().sort_values("t")
    want = pd.merge_asof(probes.sort_values("t"), facts.sort_values("t"), on="t", by="k")
    assert np.array_equal(got["value"].to_numpy(dtype=float), want["value"].to_numpy(dtype=float), equal_nan=True)


def test_row_order_does_not_matter(spark, rows, many_blocks):
    shuffled = rows.sample(frac=1, random_state=1)
    a = sorted_rows(o.ranked(spark.createDataFrame(rows), ["k"], ["t"]))
    b = sorted_rows(o.ranked(spark.createDataFrame(shuffled), ["k"], ["t"]))
    pd.testing.assert_frame_equal(a, b)


def test_written_tables_are_discarded(spark):
    import os
    from urllib.parse import urlparse

    from jointframe.session import discard_tables, durable

    table = durable(spark.range(5).toDF("x"))
    folder = os.path.dirname(urlparse(table.inputFiles()[0]).path)
    assert table.count() == 5 and os.path.isdir(folder)
    assert discard_tables(spark) >= 1 and not os.path.isdir(folder) and discard_tables(spark) == 0

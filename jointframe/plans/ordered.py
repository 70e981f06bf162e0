"""Ordered operators whose groups may be far larger than one task.

``Window.partitionBy(key)`` sends a whole key to one task. Keys of at most
``WHOLE`` rows are done that way, by one exchange. The rows of larger keys are
range partitioned on (keys, order) instead, so that a hot key spreads over many
blocks. Work is done inside (keys, block), and one summary row per (keys,
block) carries the state from block to block. The summaries of one key number
at most the partitions of the shuffle.

``order`` must be a total order inside each key, and keys must not be null.
The blocks are checkpointed: range bounds come from sampling, and a second
evaluation could otherwise cut the rows at other places.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointframe.session import durable


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition on (keys, order) and name the block of every row ``_blk``."""
    cut = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return durable(cut.withColumn("_blk", F.spark_partition_id()))


#: Keys with at most so many rows are done whole by one task.
WHOLE = 1 << 16


def _by_size(df: DataFrame, keys: Sequence[str], reread: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys that one task can hold and those of larger keys; None if there are none or no keys."""
    if not keys:
        return None, df
    rows = df if reread else durable(df)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= WHOLE:
        return rows, None
    large = durable(counts.where(F.col("_n") > WHOLE).select(*keys))
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def _either(df: DataFrame, keys: Sequence[str], whole: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame], reread: bool = False) -> DataFrame:
    """Small keys done whole and large ones in blocks, keys first; rows are written before unless they can be ``reread``."""
    few, many = _by_size(df, keys, reread)
    if few is None:
        return blocks(many)
    out = whole(few)
    out = out.select(*keys, *[c for c in out.columns if c not in keys])
    return out if many is None else out.unionByName(blocks(many))


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_blk").orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_blk")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    inclusive: bool = True,
    blocked: bool = False,
    reread: bool = False,
) -> DataFrame:
    """Add running sums; ``sums`` maps the new column to the summed expression."""
    end = 0 if inclusive else -1
    if not blocked:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return _either(df, keys, lambda rows: rows.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0)).alias(n) for n, e in sums.items()]),
                       lambda rows: running_sum(in_blocks(rows, keys, order), keys, order, sums, inclusive, True).drop("_blk"), reread)
    rows, inside = df, _inside(keys, order)
    local = rows
    for name, expr in sums.items():
        part = F.sum(expr).over(inside.rowsBetween(Window.unboundedPreceding, end))
        local = local.withColumn(name, F.coalesce(part, F.lit(0)))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_blk").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    base = base.select(
        *keys, "_blk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    out = local.join(base, [*keys, "_blk"])
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_b_{name}"))
    return out.drop(*[f"_b_{n}" for n in sums])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", reread: bool = False) -> DataFrame:
    """Row number 1.. inside each key; ``reread`` says that the rows are a table, of which keys alone can be read."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, reread=reread) if keys else _numbered(df, order, name)


def _numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Row number 1.. over all rows by one exchange: blocks are sorted before they are written, with each row's place."""
    cut = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # The low 33 bits count the rows of a partition as they come, the others are its number.
    rows = durable(cut.withColumn("_id", F.monotonically_increasing_id()))
    block = F.shiftright("_id", 33)
    ends = rows.groupBy(block.alias("_blk")).agg(F.count("*").alias("_n"))
    base = ends.select("_blk", F.coalesce(F.sum("_n").over(_across([]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    # A row for each partition of the exchange, so its size does not grow with the data.
    placed = rows.withColumn("_blk", block).join(F.broadcast(base), "_blk")
    return placed.withColumn(name, F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_blk", "_b", "_id")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    ahead: bool = False,
    blocked: bool = False,
    second: Mapping[str, str] | None = None,
    reread: bool = False,
) -> DataFrame:
    """Value of the previous (or next) row inside each key; null at the ends. ``second`` maps new columns to those of ``columns`` whose own neighbour they are."""
    shift, second = F.lead if ahead else F.lag, second or {}
    if not blocked:
        w = Window.partitionBy(*keys).orderBy(*order)
        steps = [*[(n, c, 1) for n, c in columns.items()], *[(n, columns[c], 2) for n, c in second.items()]]
        def blocks(rows: DataFrame) -> DataFrame:
            cut = in_blocks(rows, keys, order)
            for more in filter(None, (columns, second)):
                cut = neighbours(cut, keys, order, more, ahead, True)
            return cut.drop("_blk")
        return _either(df, keys, lambda rows: rows.select("*", *[shift(c, k).over(w).alias(n) for n, c, k in steps]), blocks, reread)
    rows, inside, across = df, _inside(keys, order), _across(keys)
    edge = F.min_by if ahead else F.max_by
    local = rows
    for name, col in columns.items():
        local = local.withColumn(name, shift(F.struct(F.col(col).alias("v"))).over(inside))
    ends = rows.groupBy(*keys, "_blk").agg(
        *[edge(F.struct(F.col(c).alias("v")), F.struct(*order)).alias(f"_e_{n}") for n, c in columns.items()]
    )
    ends = ends.select(*keys, "_blk", *[shift(f"_e_{n}").over(across).alias(f"_p_{n}") for n in columns])
    out = local.join(ends, [*keys, "_blk"])
    for name in columns:
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_p_{name}"))["v"])
    return out.drop(*[f"_p_{n}" for n in columns])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per key.

    Built on value counts and their running sum, so no task holds a key's values.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_sum(hist, keys, [value], {"_cum": F.col("_n")})
    total = cum.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows = cum.join(total, list(keys)) if keys else cum.crossJoin(total)
    first, last = F.col("_cum") - F.col("_n"), F.col("_cum") - 1
    aggs = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when(pos.between(first, last), F.col(value))).alias(f"_{tag}_{name}"))
    out = rows.groupBy(*keys, "_total").agg(*aggs)
    cols = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*keys, *cols)


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the last earlier value of the key; each column on its own."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _either(df, keys, lambda rows: rows.select(*[c for c in rows.columns if c not in columns], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns]),
                   lambda rows: _fill_blocks(in_blocks(rows, keys, order), keys, order, columns))


def _fill_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(*[c for c in rows.columns if c not in columns],
                        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns])
    place = F.struct(*order)
    ends = rows.groupBy(*keys, "_blk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_e_{c}") for c in columns])
    ends = ends.select(*keys, "_blk", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_p_{c}") for c in columns])
    out = local.join(ends, [*keys, "_blk"])
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_p_{c}"))
    return out.drop("_blk", *[f"_p_{c}" for c in columns])


def asof(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, value: str, ident: str) -> DataFrame:
    """Probes with the value of the latest fact at or before their position; null before the first fact.

    ``probes`` is (keys…, at, ident), ``facts`` (keys…, at, value) with one fact per position.
    """
    kind = facts.schema[value].dataType
    both = facts.select(*keys, at, value, F.lit(0).alias("_probe"), F.lit(None).cast(probes.schema[ident].dataType).alias(ident)).unionByName(
        probes.select(*keys, at, F.lit(None).cast(kind).alias(value), F.lit(1).alias("_probe"), ident))
    return fill_forward(both, keys, [at, "_probe", ident], [value]).where("_probe = 1").drop("_probe")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Largest value of the column over this and all earlier rows of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _either(df, keys, lambda rows: rows.withColumn(name, F.max(column).over(w)), lambda rows: _max_blocks(in_blocks(rows, keys, order), keys, order, column, name))


def _max_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    local = rows.withColumn(name, F.max(column).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_blk").agg(F.max(column).alias("_t")).select(*keys, "_blk", F.max("_t").over(before).alias("_b"))
    return local.join(base, [*keys, "_blk"]).withColumn(name, F.greatest(name, "_b")).drop("_blk", "_b")

"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch, and bytes of text worked on at a time inside a task.
BATCH_ROWS = 500
SLICE_BYTES = 6_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Long texts: keep the batches that go to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as keep it from clashing with a column."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def few_of_each(df: DataFrame, label: str, ident: str, rows: int, salt: str, labels: int = 1000) -> DataFrame:
    """(ident, label): ``rows`` rows of each label by keyed draws, of the ``labels`` most frequent labels.

    Counts first, so that only a few times as many rows as asked for leave their
    tasks, however many tasks and rows there are.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), label).limit(labels)
    draw = F.pmod(F.xxhash64(ident, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = df.select(ident, label).join(F.broadcast(counts), label).withColumn("__draw", draw).where(F.col("__draw") * F.col("__n") < 4 * rows)
    ranked = near.withColumn("__i", F.row_number().over(Window.partitionBy(label).orderBy("__draw", ident)))
    return ranked.where(F.col("__i") <= rows).select(ident, label)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches put together and cut to about ``most`` bytes of text each."""
    held, size = [], 0
    for batch in slices(batches, text, most):
        n = batch.column(batch.schema.get_field_index(text)).nbytes
        if held and size + n > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def text_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between spaces, which of them stands at each place, and each text's first place with the total at the end."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    at = split.offsets.to_numpy()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), at - at[0]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts without nulls, and where each starts with the end of the last."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Cuts of ``raw`` as a binary column."""
    out = raw[ranges(starts, lengths)]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])

"""Packing of token sequences by few-document length patterns.

Pieces of at most ``capacity`` tokens are counted by length. On that histogram,
whose size is the capacity and not the corpus, patterns of at most ``PARTS``
lengths that fill a sequence are enumerated on a grid and fitted by
non-negative least squares. Counts are rounded down and turned into exact
lengths, the last part of a pattern taking the longest piece that still fits.
What is left is packed best fit, longest first, as runs of equal sequences.
Pieces get their place by joining (length, rank within the length) to the plan.

Null texts are empty and so one end id. Repeated rows and null ids are packed
like others; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jointframe.llm.common import gathered, ranges, small_batches, text_of
from jointframe.llm.tokens import END_ID, encoder, vocabulary_path, with_end
from jointframe.session import durable

CAPACITY = 4096
#: The grid has so many cells in a sequence; patterns have so many pieces at most.
CELLS, PARTS = 128, 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents' tokens, written out.

    ``rank`` counts pieces of one length inside one writing task, ``part``;
    both are written by the attempt that commits, so retries don't mix.
    """
    path = vocabulary or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches):
            ids, bounds = with_end(*words.encode(text_of(batch)), end_id)
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = ranges(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            data = memoryview(ids.astype("<u4").tobytes())
            at = (bounds[doc] + start) * 4
            crc = [zlib.crc32(data[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - first + seen[length[order]]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return durable(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES))


def patterns(cells: int = CELLS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``parts`` numbers from 1 that sum to ``cells``."""
    out = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < parts:
            most = min(left, head[-1] if head else left)
            least = -(-left // (parts - len(head)))
            for x in range(most, least - 1, -1):
                grow((*head, x), left - x)

    grow((), cells)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative least squares by an active set: the column that helps most enters, columns that would turn negative leave."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= least:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            y = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (y > 1e-12).all():
                x[:] = 0
                x[at] = y
                break
            low = y <= 1e-12
            gap = x[at][low] - y[low]
            step = np.min(np.divide(x[at][low], gap, out=np.zeros(low.sum()), where=gap > 0))
            x[at] += step * (y - x[at])
            leave = at[(x[at] <= 1e-12) & low]
            x[leave] = 0
            used[leave] = False
            if not len(leave):
                break
    return x


class _Runs:
    """Runs of equal, partly filled sequences, by the room left."""

    def __init__(self, capacity: int):
        self.parent: list[tuple[int, int, int]] = [(-1, 0, 0)]
        self.rooms: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.capacity = capacity

    def node(self, parent: int, length: int, times: int) -> int:
        self.parent.append((parent, length, times))
        return len(self.parent) - 1

    def add(self, room: int, node: int, count: int) -> None:
        if not count:
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((node, count))

    def place(self, length: int, count: int) -> None:
        """Best fit: into the least room that holds the length, else into new sequences."""
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                self.add(self.capacity - each * length, self.node(0, length, each), count // each)
                if rest := count % each:
                    self.add(self.capacity - rest * length, self.node(0, length, rest), 1)
                return
            room = self.rooms[i]
            node, k = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[i]
            each = room // length
            full = min(k, count // each)
            self.add(room - each * length, self.node(node, length, each), full)
            count, k = count - full * each, k - full
            if k and 0 < count < each:
                self.add(room - count * length, self.node(node, length, count), 1)
                count, k = 0, k - 1
            self.add(room, node, k)

    def lengths(self, node: int) -> list[int]:
        out: list[int] = []
        while node > 0:
            node, length, times = self.parent[node]
            out += [length] * times
        return out[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, cells: int = CELLS, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use up the histogram of piece lengths."""
    left = {k: int(v) for k, v in histogram.items() if v}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("pieces must have from 1 to capacity tokens")
    runs = _Runs(capacity)
    cells = min(cells, capacity)
    bin_of = {k: -(-k * cells // capacity) for k in left}
    counts = np.zeros(cells)
    for k, v in left.items():
        counts[bin_of[k] - 1] += v
    shapes = [s for s in patterns(cells, parts) if all(counts[x - 1] for x in s)]
    if shapes:
        a = np.zeros((cells, len(shapes)))
        for j, s in enumerate(shapes):
            for x in s:
                a[x - 1, j] += 1
        repeats = np.floor(nnls(a, counts) + 1e-9).astype(np.int64)
        stock = {b: sorted((k for k in left if bin_of[k] == b), reverse=True) for b in set(bin_of.values())}
        every = sorted(left)
        for j in np.argsort(-repeats, kind="stable"):
            n, shape = int(repeats[j]), shapes[j]
            while n > 0:
                taken: list[int] = []
                for x in shape[:-1]:
                    k = next((k for k in stock[x] if left.get(k, 0) > taken.count(k)), None)
                    if k is None:
                        break
                    taken.append(k)
                if len(taken) < len(shape) - 1:
                    break
                room = capacity - sum(taken)
                # The longest piece that still fits, if it is not far below what the shape asks for.
                i = bisect_left(every, room + 1) - 1
                while i >= 0 and left.get(every[i], 0) <= taken.count(every[i]):
                    i -= 1
                if i < 0 or bin_of[every[i]] < shape[-1] - 1:
                    break
                taken.append(every[i])
                each = min(left[k] // taken.count(k) for k in taken)
                each = min(each, n)
                node = 0
                for k in taken:
                    node = runs.node(node, k, 1)
                    left[k] -= each
                runs.add(room - taken[-1], node, each)
                n -= each
                every = [k for k in every if left[k]] if not all(left[k] for k in taken) else every
    for k in sorted(left, reverse=True):
        runs.place(k, left[k])
    return [(tuple(runs.lengths(node)), n) for room in runs.rooms for node, n in runs.open[room]]


def slots(rows: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place in the plan."""
    out, base, used = [], 0, {}
    for lengths, n in rows:
        offset, i = 0, 0
        for k in lengths:
            lo = used.get(k, 0)
            out.append((k, lo, lo + n, base, offset))
            used[k] = lo + n
            offset += k
            i += 1
        base += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``cut`` with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = durable(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("part", "length", before.alias("first"))
    table = spark.createDataFrame(slots(plan(histogram, capacity)), "length long, lo long, hi long, base long, offset long")
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    # The plan depends on the capacity alone, so it may be sent to all.
    placed = ranked.alias("p").join(F.broadcast(table.withColumnRenamed("length", "len")), (F.col("p.length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    return pack(cut(docs, capacity, vocabulary), capacity)

"""Embedding near-dedup by lattice hashing.

Rows link if their labels are equal and not null and their cosine, in doubles,
reaches a threshold. Equal vectors of a label are one class, so copies are
never paired up; everything below works on classes.

Index: in each of several tables a unit vector is turned by a random rotation
and cut into blocks of eight coordinates, each decoded to the nearest point of
the lattice E8 at scale ``SCALE``. The points make the vector's home cell; the
neighbouring cell that is nearest (one block moved to its next lattice point) is
probed too. Two vectors meet in a table if the home of one is the home or the
probe of the other. The number of blocks grows with the logarithm of the
largest label, so that a vector meets about ``MEETINGS`` strangers a table; the
number of tables follows from the chance, simulated at the threshold itself,
that a pair meets in one, so that a pair at the threshold is missed with
probability ``MISS`` at most and closer pairs less often. All cosines are
verified; no link is below the threshold. Vectors travel only to cells in which
at least two classes can meet.

A pair is counted in the first table in which it meets: codes are worked out in
integers, so any task gets the same ones. A cell of more than ``PART`` rows is
dealt out in pairs of parts, each a task's work of its own, and gives sums and
stars, never its pairs.

Null, empty and zero vectors, vectors with null or non-finite components and
rows with a null label link with nothing: no links, a component of their own.
Vectors of different lengths don't link. Repeated rows are links of each other
like other copies. Component ids are the least id; a component of null ids has
a null one, and such rows are kept only if the id is not null. Empty input
gives empty output. Vectors of any length are used in full. Columns other than
id, vector and label are not read by ``near_copies``; ``keep_one`` passes
extra columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.llm.common import columns_of, unused
from jointframe.llm.components import components
from jointframe.session import durable

THRESHOLD = 0.98
SCALE = 2.0
SEED = 12
#: Strangers that a vector should meet in a table, and the chance by which a further block divides them.
MEETINGS, SELECTIVITY = 100, 200
#: Greatest chance to miss a pair at the threshold.
MISS = 1e-4
#: Rows of a part of a crowded cell, and of a tile of cosines.
PART, TILE = 4096, 1024
#: Steps of a unit for the integers that codes are worked out in; sums of products stay exact in doubles up to 4,096 components.
STEPS = 1 << 20


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integers of even sum, or all of them moved by a half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _mixed(code: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit number for each row of small integers."""
    h = np.full(len(code), (2 * salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for column in code.T.astype(np.int64).astype(np.uint64):
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _cells(x: np.ndarray, blocks: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, nearest other cell) of points of 8 * blocks coordinates."""
    home = np.empty_like(x)
    gap, root = np.empty((blocks, len(x))), np.empty((blocks, len(x)), np.int64)
    for b in range(blocks):
        cut = slice(8 * b, 8 * b + 8)
        home[:, cut] = decode(x[:, cut])
        ahead = np.zeros((len(x), len(ROOTS)))
        for k in range(8):  # in this order, whatever the number of rows
            ahead += (x[:, 8 * b + k] - home[:, 8 * b + k])[:, None] * ROOTS[:, k]
        root[b] = ahead.argmax(axis=1)
        gap[b] = ahead.max(axis=1)
    moved, best, rows = home.copy(), gap.argmax(axis=0), np.arange(len(x))
    places = 8 * best[:, None] + np.arange(8)
    moved[rows[:, None], places] += ROOTS[root[best, rows]]
    return _mixed(2 * home, salt), _mixed(2 * moved, salt)


class Codes:
    """The cells of vectors of one length in all tables."""

    def __init__(self, dim: int, blocks: int, tables: int):
        self.blocks, self.turns = blocks, []
        rng = np.random.default_rng((SEED, dim, blocks))
        width = 8 * blocks
        for _ in range(tables):
            turn = rng.normal(size=(dim, width))
            if dim >= width:
                turn = np.linalg.qr(turn)[0] * math.sqrt(dim)
            self.turns.append(np.rint(turn * STEPS))

    def __call__(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(homes, probes), a row for each table, of unit vectors in whole steps."""
        both = [_cells(steps @ turn / (SCALE * STEPS * STEPS), self.blocks, i) for i, turn in enumerate(self.turns)]
        return np.array([h for h, _ in both]), np.array([p for _, p in both])


def in_steps(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in whole steps: integers all the way, so that the order of sums does not matter."""
    whole = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * STEPS)
    return np.rint(whole / np.sqrt((whole**2).sum(axis=1, keepdims=True)) * STEPS)


def meeting_chance(threshold: float, blocks: int, pairs: int = 20_000) -> float:
    """Share of simulated pairs at the threshold that meet in a table."""
    rng = np.random.default_rng((SEED, blocks))
    x, y = rng.normal(size=(2, pairs, 8 * blocks))
    y = threshold * x + math.sqrt(1 - threshold**2) * y
    (hx, px), (hy, py) = _cells(x / SCALE, blocks, 0), _cells(y / SCALE, blocks, 0)
    return float(((hx == hy) | (hx == py) | (px == hy)).mean())


def shape_of(largest: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(blocks, tables) for the classes of the largest label."""
    blocks = 1 + max(0, math.ceil(math.log(max(largest, 1) / (MEETINGS * SELECTIVITY / 2)) / math.log(SELECTIVITY)))
    return blocks, max(2, math.ceil(math.log(MISS) / math.log(1 - min(meeting_chance(threshold, blocks), 1 - 1e-9))))


def _usable(vector: Column) -> Column:
    def number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _class(label: str, vector: str) -> Column:
    """A 128-bit id of label and vector, null for rows that link with nothing."""
    parts = [F.lpad(F.hex(F.xxhash64(*c)), 16, "0") for c in ((label, vector), (F.lit(SEED), vector, label))]
    return F.when(F.col(label).isNotNull() & _usable(F.col(vector)), F.unhex(F.concat(*parts)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _emit(blocks: int, tables: int):
    """(class, label, dim, cell, home) for the home and the probe of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                if dim not in codes:
                    codes[dim] = Codes(dim, blocks, tables)
                for start in range(0, rows.num_rows, TILE):
                    some = rows.slice(start, TILE)
                    homes, probes = codes[dim](in_steps(_matrix(some.column(3))))
                    at = pa.array(np.tile(np.arange(some.num_rows), 2 * tables))
                    out = some.select([0, 1, 2]).take(at)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate((homes, probes)).ravel()), pa.array(np.arange(len(at)) < len(at) // 2)], ["cls", "label", "dim", "cell", "home"])

    return run


def _linked(unit: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the rows ``a`` and ``b`` reach the threshold; what is too near it is summed up again one by one."""
    cosine = unit[a] @ unit[b].T
    out = cosine >= threshold
    for i, j in np.argwhere(np.abs(cosine - threshold) < 1e-12):
        x, y = raw[a[i]], raw[b[j]]
        out[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= threshold
    return out


def _stars(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it is connected with."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _compare(threshold: float, blocks: int, tables: int):
    """(class, star's centre, links) of the rows of a cell; rows arrive sorted by label, dim, cell and pair of parts."""
    known: dict[int, Codes] = {}

    def of_cell(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        dim, cell = rows.column("dim")[0].as_py(), rows.column("cell")[0].as_py()
        raw = _matrix(rows.column("vector"))
        unit = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        home, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("home", "n"))
        side, other = rows.column("side").to_numpy(), rows.column("a")[0].as_py() != rows.column("b")[0].as_py()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if other else (np.arange(len(raw)),) * 2
        tiles = [(slice(i, i + TILE), slice(j, j + TILE)) for i in range(0, len(left), TILE) for j in range(0 if other else i, len(right), TILE)]
        near = np.zeros((len(left), len(right)), bool)
        for i, j in tiles:
            a, b = left[i], right[j]
            near[i, j] = _linked(unit, raw, a, b, threshold) & (home[a][:, None] | home[b])
            if not other and i == j:
                near[i, j] = np.triu(near[i, j], 1)
        rows_left, rows_right = near.any(axis=1), near.any(axis=0)
        left, right, near = left[rows_left], right[rows_right], near[rows_left][:, rows_right]
        if not len(left):
            return None
        used = np.union1d(left, right)
        if dim not in known:
            known[dim] = Codes(dim, blocks, tables)
        homes, probes = known[dim](in_steps(raw[used]))
        # The cell is of the table in which it is a home; pairs that met in an earlier one were counted there.
        table = int(np.flatnonzero((homes == cell).any(axis=1))[0])
        x, y, weight = np.searchsorted(used, left), np.searchsorted(used, right), copies[used].astype(float)
        links, square = np.zeros(len(used)), np.zeros((len(used), len(used)), bool)
        for i in range(0, len(x), TILE):
            for j in range(0, len(y), TILE):
                a, b = x[i : i + TILE], y[j : j + TILE]
                new = near[i : i + TILE, j : j + TILE]
                for h, p in zip(homes[:table], probes[:table], strict=True):
                    if new.any():
                        new &= ~((h[a][:, None] == h[b]) | (h[a][:, None] == p[b]) | (p[a][:, None] == h[b]))
                if new.any():  # two that probe each other's home meet in both cells; the lesser one counts
                    h, p = homes[table], probes[table]
                    new &= ~((h[a][:, None] == p[b]) & (p[a][:, None] == h[b]) & (np.minimum(h[a][:, None], h[b]) != cell))
                links[a] += new @ weight[b]
                links[b] += weight[a] @ new
                square[np.ix_(a, b)] |= new
        some = np.flatnonzero(links)
        if not len(some):
            return None
        square = square[np.ix_(some, some)]
        cls = rows.column("cls").take(pa.array(used[some]))
        return pa.RecordBatch.from_arrays([cls, cls.take(pa.array(_stars(square | square.T))), pa.array(links[some].astype(np.int64))], ["cls", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("label", "dim", "cell", "a", "b")]
            change = np.ones(batch.num_rows, bool)
            for k in keys:
                ids = k.dictionary_encode().indices.to_numpy()
                change[1:] &= ids[1:] == ids[:-1]
            starts = [0, *np.flatnonzero(~change).tolist(), batch.num_rows]
            for start, stop in zip(starts, starts[1:], strict=False):
                key = tuple(k[start].as_py() for k in keys)
                if held and key != last:
                    if (out := of_cell(pa.concat_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, stop - start))
                last = key
        if held and (out := of_cell(pa.concat_batches(held))) is not None:
            yield out

    return run


def _parted(cells: DataFrame) -> DataFrame:
    """The rows of cells in which classes can meet; crowded cells as pairs of parts, ``a`` and ``b``, of which a row is on ``side`` 0 or 1."""
    live = cells.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
    live = live.where("homes > 0 AND rows > 1").select("label", "dim", "cell", F.ceil(F.col("rows") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = cells.join(live, ["label", "dim", "cell"]).select("*", own.alias("own")).select("*", other)
    a, b = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("cls", "label", "dim", "cell", "home", a.alias("a"), b.alias("b"), (F.col("own") != a).cast("int").alias("side"))


def links(vectors: DataFrame, vector: str = "embedding", label: str = "label", ident: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """(cls, least, n_links, least id of the component) of each class of equal vectors; rows find theirs by ``_class``."""
    rows = vectors.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & _usable(F.col("vector")))
    classes = rows.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = durable(classes.select(_class("label", "vector").alias("cls"), "label", F.size("vector").cast("long").alias("dim"), "vector", "n", "least"))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    alone = classes.select("cls", "least", (F.col("n") - 1).alias("n_links"), F.col("least").alias("component"))
    if not largest:
        return alone
    blocks, tables = shape_of(largest, threshold)
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    cells = durable(classes.select("cls", "label", "dim", "vector").mapInArrow(_emit(blocks, tables), f"cls binary, label {kinds['label']}, dim long, cell long, home boolean"))
    keys = ["label", "dim", "cell", "a", "b"]
    met = _parted(cells).join(classes.select("cls", "vector", "n"), "cls").repartition(*keys).sortWithinPartitions(*keys)
    stars = durable(met.mapInArrow(_compare(threshold, blocks, tables), "cls binary, root binary, links long"))
    more = stars.groupBy("cls").agg(F.sum("links").alias("links"))
    nodes = components(stars.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "root").distinct()
    rooted = classes.select("cls", "n", "least").join(more, "cls", "left").join(nodes, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = durable(rooted.select("cls", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("cls", "least", "n_links", "component")


def near_copies(vectors: DataFrame, vector: str = "embedding", label: str = "label", ident: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row its id with ``n_links``, ``component_id`` and ``kept``, which is true for the row of the component's least id."""
    found = links(vectors, vector, label, ident, threshold).where("n_links > 0").select("cls", "n_links", "component")
    rows = vectors.select(F.col(f"`{ident}`").alias(ident), F.col(f"`{label}`").alias("__label"), F.col(f"`{vector}`").alias("__vector"))
    rows = rows.select(F.col(f"`{ident}`"), _class("__label", "__vector").alias("cls"))
    own = F.col(f"`{ident}`")
    component = F.when(F.col("n_links").isNull(), own).otherwise(F.col("component"))
    return rows.join(found, "cls", "left").select(own, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(False)).alias("kept"))


def keep_one(vectors: DataFrame, vector: str = "embedding", label: str = "label", ident: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of least id of each component, as they are; rows that repeat the id stay, and so do rows of null id that link with nothing."""
    cls, n, component = unused(vectors.columns, "__cls", "__n", "__component")
    found = links(vectors, vector, label, ident, threshold).where("n_links > 0").select(F.col("cls").alias(cls), F.col("n_links").alias(n), F.col("component").alias(component))
    lab, vec = unused([*vectors.columns, cls, n, component], "__label", "__vector")
    keyed = vectors.withColumns({lab: F.col(f"`{label}`"), vec: F.col(f"`{vector}`")}).withColumn(cls, _class(lab, vec))
    return keyed.join(found, cls, "left").where(F.col(n).isNull() | (F.col(f"`{ident}`") == F.col(component))).select(*columns_of(vectors))


def digest(vectors: DataFrame) -> DataFrame:
    return near_copies(vectors)


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
e AS (SELECT u, w FROM p UNION ALL SELECT w, u FROM p),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.w FROM r JOIN e ON e.u = r.b)
SELECT x.vec_id, coalesce(n, 0) AS n_links, c.component_id, c.component_id = x.vec_id AS kept FROM embeddings x
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) c USING (vec_id) LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM e GROUP BY u) l USING (vec_id)"""

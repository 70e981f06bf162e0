"""SimHash near-dedup on a Gray-order hierarchical index.

Fingerprints: texts are lower-cased (A-Z) and cut at white space; word shingles
are hashed by XXH64 with seed 42; a bit is set if it is set in more than half
of the hashes. A text of fewer words is one shingle, one without words has
fingerprint zero. Two fingerprints link at ``RADIUS`` or fewer differing bits.

Index: the bits are cut into segments. Of fingerprints within the radius, some
choice of segments agrees in full, so for every choice the chosen segments are
put in front; equal fronts form a group. Within a group fingerprints
are sorted by Gray rank and factored into a tree: a node holds the bits that
all below it share, as mask and pattern. A search goes down from the top and
drops whole subtrees as soon as the differing shared bits exceed the radius, or
if all below is in the searcher's component already. Groups give stars rather
than pairs, and components are found on the stars.

Distinct fingerprints are indexed once, however many texts share one. The
number of segments that must agree grows with the number of fingerprints, so
that groups stay small; a larger group is dealt out by pairs of bounded parts.

Null texts count as texts without words. Component ids are the least doc_id; a
component of null ids only has a null one. Repeated rows are linked like other
copies. Extra columns pass through ``keep_one`` and are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import columns_of, slices, small_batches, unused
from jointframe.llm.components import components
from jointframe.session import durable

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Most fingerprints in a part of a group; children of a node; size up to which a group is one leaf.
PART = 16384
FAN = 8
LEAF = 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    k = min(shingle, len(words))
    ends = (ends - 1).tolist()[k - 1 :]
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)), ">u8", len(ends))
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        part = h[lo : lo + 8192]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep_text: bool = True, name: str = "__fp") -> DataFrame:
    """The documents' columns (without the text unless kept) and, under a name that must be free, the fingerprint as a signed number."""
    small_batches(docs.sparkSession)
    i = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = np.array([fingerprint(t, shingle) for t in batch.column(i).to_pylist()], np.uint64).view(np.int64)
            kept = [c for j, c in enumerate(batch.columns) if keep_text or j != i]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of n segments of 64 bits."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choices(total: int, radius: int = RADIUS, part: int = PART) -> tuple[int, list[tuple[int, ...]]]:
    """(segments, the choices of segments that must agree) for so many fingerprints: radius + a segments of which a agree."""
    agree = 1
    while total > max(1, part // 4) << (sum(sorted(w for _, w in _segments(radius + agree))[:agree])) and agree < 5:
        agree += 1
    return radius + agree, list(combinations(range(radius + agree), agree))


def _front(fp: Column, n: int, choice: tuple[int, ...]) -> Column:
    """The chosen segments of the fingerprint, one after the other."""
    out, segments = F.lit(0).cast("long"), _segments(n)
    for i in choice:
        low, width = segments[i]
        bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(bits)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a label is the least place of its component."""
    la, lb = label[a], label[b]
    pairs = np.unique(np.stack([np.minimum(la, lb), np.maximum(la, lb)], 1)[la != lb], axis=0)
    if not len(pairs):
        return label
    parent = np.arange(len(label))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    while (up := parent[parent] != parent).any():
        parent[up] = parent[parent[up]]
    return parent[label]


class Tree:
    """Fingerprints in Gray order under nodes of shared bits."""

    def __init__(self, codes: np.ndarray):
        self.pattern, self.mask, self.first = [codes], [np.full(len(codes), ~np.uint64(0))], [np.arange(len(codes) + 1)]
        while len(self.pattern[-1]) > FAN:
            p, m = self.pattern[-1], self.mask[-1]
            at = np.arange(0, len(p), FAN)
            lead = np.repeat(p[at], np.diff(np.append(at, len(p))))
            mask = np.bitwise_and.reduceat(m, at) & ~np.bitwise_or.reduceat(p ^ lead, at)
            self.mask.append(mask)
            self.pattern.append(p[at] & mask)
            self.first.append(np.append(self.first[-1][at], len(codes)))

    def search(self, lo: int, hi: int, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from places lo to hi to later places in other components."""
        codes = self.pattern[0]
        top = len(self.pattern) - 1
        q = np.repeat(np.arange(lo, hi), len(self.pattern[top]))
        node = np.tile(np.arange(len(self.pattern[top])), hi - lo)
        for level in range(top, -1, -1):
            first = self.first[level]
            keep = first[node + 1] > q + 1
            keep &= np.bitwise_count((codes[q] ^ self.pattern[level][node]) & self.mask[level][node]) <= radius
            least, most = np.minimum.reduceat(label, first[:-1]), np.maximum.reduceat(label, first[:-1])
            keep &= (least[node] != label[q]) | (most[node] != label[q])
            q, node = q[keep], node[keep]
            if not level or not len(q):
                break
            below = len(self.pattern[level - 1])
            child = node[:, None] * FAN + np.arange(FAN)
            inside = child < below
            q, node = np.repeat(q, inside.sum(1)), child[inside]
        return q, node


def group_stars(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(place, least place of its component) for linked fingerprints of a group; ``codes`` are distinct."""
    n = len(codes)
    order = np.argsort(gray_rank(codes), kind="stable")
    sorted_codes = codes[order]
    # Neighbours in Gray order differ little; joining them first lets the search skip most of a crowded group.
    near = np.bitwise_count(sorted_codes[1:] ^ sorted_codes[:-1]) <= radius
    label = np.maximum.accumulate(np.where(np.append(True, ~near), np.arange(n), 0))
    if n <= LEAF:
        a, b = np.nonzero(np.triu(np.bitwise_count(sorted_codes[:, None] ^ sorted_codes[None, :]) <= radius, 1))
        label = _merge(label, a, b)
    else:
        tree = Tree(sorted_codes)
        for lo in range(0, n, 256):
            a, b = tree.search(lo, min(n, lo + 256), radius, label)
            if len(a):
                label = _merge(label, a, b)
    place = np.flatnonzero(label != np.arange(n))
    return order[place], order[label[place]]


def _stars(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close(groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            g, fp = np.concatenate([x for x, _ in groups]), np.concatenate([x for _, x in groups])
            bounds = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            us, vs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    own = fp[a:b]
                    u, v = group_stars(own, radius)
                    us.append(own[u])
                    vs.append(own[v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            last = np.searchsorted(g, g[-1]) if g[0] != g[-1] else 0
            if held and (last or held[-1][0][-1] != g[0]):
                # All groups but the last are complete.
                cut = last if last else 0
                yield from close([*held, (g[:cut], fp[:cut])] if cut else held)
                held = []
            elif last:
                yield from close([(g[:last], fp[:last])])
            held.append((g[last:], fp[last:]))
        if held:
            yield from close(held)

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(u, v): for ``fingerprints`` (fp, distinct), links that connect the same components as all pairs within the radius."""
    spark = fingerprints.sparkSession
    n, chosen = choices(fingerprints.count(), radius, part)
    rows = [F.struct(F.lit(k).cast("long").alias("k"), _front(F.col("fp"), n, choice).alias("front")) for k, choice in enumerate(chosen)]
    spread = fingerprints.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.k", "r.front")
    large = spread.groupBy("k", "front").agg(F.count("*").alias("n")).where(F.col("n") > part)
    large = large.select("k", "front", F.ceil(F.col("n") / part).cast("long").alias("parts"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = spread.join(large, ["k", "front"], "left").withColumn("i", F.pmod(F.xxhash64("fp", F.lit("part")), parts))
    # A part meets every part of its group once, itself included.
    pair = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.struct(F.least(F.col("i"), j).alias("a"), F.greatest(F.col("i"), j).alias("b")))
    dealt = dealt.select("fp", "k", "front", F.explode(pair).alias("p"))
    group = F.xxhash64("k", "front", "p.a", "p.b")
    # Groups whose hash collides share a task's group; that costs time but adds no false link.
    ready = dealt.select(group.alias("g"), "fp").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_distinct_then(_stars(radius)), "u long, v long")
    small_batches(spark, 20_000)
    return ready


def _distinct_then(run):
    """Drops a fingerprint that is twice in a group (by colliding groups) before ``run``."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unique() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                new = np.append(last != (g[0], fp[0]), (g[1:] != g[:-1]) | (fp[1:] != fp[:-1]))
                last = (g[-1], fp[-1])
                yield batch.filter(pa.array(new))

        yield from run(unique())

    return both


def group_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(__f, __root, component_id): each distinct fingerprint of ``prints`` (doc_id, __fp), its component and that one's least doc_id."""
    distinct = durable(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = durable(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.select("fp", "root").join(least, "root").select(F.col("fp").alias("__f"), F.col("root").alias("__root"), "component_id")


def group_documents(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, __fp) with ``__root``, the component, and ``component_id``, its least doc_id."""
    return prints.join(group_fingerprints(prints, radius), prints["__fp"] == F.col("__f"), "left").drop("__f")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digest(docs: DataFrame) -> DataFrame:
    prints = durable(with_fingerprint(docs.select("doc_id", "text"), keep_text=False))
    return group_documents(prints).select("doc_id", hex_of(F.col("__fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each component, that of the least doc_id, with all columns.

    Of rows that share this doc_id, the one with the least text digest stays;
    of those with one text too, the one whose row is least as JSON.
    """
    fp, f, root, least, row, rank = unused(docs.columns, "__fp", "__f", "__root", "__least", "__row", "__rank")
    marked = durable(with_fingerprint(docs, text, name=fp))
    table = group_fingerprints(marked.select("doc_id", F.col(fp).alias("__fp"))).toDF(f, root, least)
    # By document and fingerprint, so that copies are no hot key.
    kept = marked.join(table, (F.col(fp) == F.col(f)) & F.col("doc_id").eqNullSafe(F.col(least)))
    whole = F.struct(*columns_of(docs))
    ties = kept.select(root, whole.alias(row), F.struct(F.sha2(F.col(f"`{text}`").cast("binary"), 256), F.sha2(F.to_json(whole), 256)).alias(rank))
    return ties.groupBy(root).agg(F.min_by(row, rank).alias(row)).select(*[F.col(row).getField(c).alias(c) for c in docs.columns])

"""Benchmark decontamination by suffix arrays over training shards.

Texts are lower-cased (A-Z) and cut into words of digits, letters and
characters beyond ASCII. A shard is a slice of documents inside a task. Its
suffix array holds, in word order, the suffixes that start with enough words
of the benchmark; every benchmark suffix is looked up in it by binary search
for its window of ``WINDOW`` words (an item of fewer words is one window).
Neighbouring windows on one diagonal are joined into longest verbatim matches.

The benchmark is cut into blocks of bounded size by a Spark job, whose files
the executors fetch; a task holds one block at a time against a run of its
documents, so neither side passes the driver or has to fit in memory whole.
Only one item is never divided.

Null texts have no words and are clean; so are empty tables and benchmarks.
Items without words are not looked for; items with equal ids count once. Words
of an item with a null id are hit like those of others, but the item has no
name to be counted by: it is in neither n_items nor items_sha256. Very long
texts are searched whole, each in a slice of its own. Repeated rows are judged
alike; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import SLICE_BYTES, columns_of, gathered, ranges, slices, small_batches, unused
from jointframe.session import durable

WINDOW = 13
#: Words of the benchmark that a task holds at a time.
BLOCK_WORDS = 500_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Block:
    """Items of one block: the vocabulary and the distinct windows in sort order."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = sorted({name for name, _ in items if name is not None})
        rank = {n: i for i, n in enumerate(self.names)}
        found: dict[bytes, list[tuple[int, int]]] = {}
        self.width = window * 4
        for name, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], ">u4").tobytes()
            k = min(window, len(words))
            if name is None:
                self.names.append(None)
            own = len(self.names) - 1 if name is None else rank[name]
            for q in range(len(words) - k + 1):
                found.setdefault(ids[4 * q : 4 * (q + k)], []).append((own, q))
        keys = sorted(found)
        self.low = np.array(keys, f"S{self.width}")
        self.high = np.array([k + b"\xff" * (self.width - len(k)) for k in keys], f"S{self.width}")
        self.size = np.array([len(k) // 4 for k in keys], np.int64)
        places = [sorted(set(found[k])) for k in keys]
        self.n_places = np.array([len(p) for p in places], np.int64)
        self.first_place = np.cumsum(self.n_places) - self.n_places
        self.item = np.array([i for p in places for i, _ in p], np.int64)
        self.at = np.array([q for p in places for _, q in p], np.int64)
        self.least = int(self.size.min()) if len(keys) else 0

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence in a shard; ``ids`` has 0 for other words and between documents."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.least or not len(ids):
            return none
        stops = np.flatnonzero(np.append(ids, 0) == 0)
        run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))
        start = np.flatnonzero(run >= self.least)
        if not len(start):
            return none
        shown = np.minimum(run[start], self.window)
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        grid = padded[start[:, None] + np.arange(self.window)]
        grid[np.arange(self.window) >= shown[:, None]] = 0
        suffixes = np.ascontiguousarray(grid.astype(">u4")).view(f"S{self.width}").ravel()
        order = np.argsort(suffixes, kind="stable")  # the shard's suffix array
        suffixes = suffixes[order]
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        window = np.repeat(np.arange(len(lo)), hi - lo)
        return window, start[order[ranges(lo, hi - lo)]]


def block_files(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> tuple[list[str], int]:
    """The benchmark in blocks of about ``most`` words, built in tasks: the files they were written to, and how many blocks."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, math.ceil(words / most))

    def build(items: pd.DataFrame) -> pd.DataFrame:
        cut = [(name, words_of(text)) for name, text in zip(items["item_id"], items["text"], strict=True)]
        block = Block([(None if pd.isna(name) else name, words) for name, words in cut if words], window)
        return pd.DataFrame({"block": [pickle.dumps(block)]})

    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return list(durable(rows.groupBy(part.alias("part")).applyInPandas(build, "block binary")).inputFiles()), n


def _read_blocks(names: list[str]) -> Iterator[Block]:
    """The blocks of files that the executor has fetched, one at a time."""
    for name in names:
        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=1):
            for block in batch.column(0):
                yield pickle.loads(block.as_py())


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()),
        T.StructField("doc_start", T.LongType()), T.StructField("length", T.LongType()),
    ]))),
])
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("matches", _MATCHES)])


def _find(block: Block, texts: list[str | None]) -> list[dict]:
    """For each text: words, places of hit words, longest matches."""
    get = block.vocabulary.get
    ids, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        ids.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
        ids.append(np.zeros(1, np.uint32))
    size = np.array(sizes, np.int64)
    base = np.cumsum(size + 1) - (size + 1)
    window, place = block.search(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    out = [{"n_words": n, "hits": [], "matches": []} for n in sizes]
    if not len(window):
        return out
    doc = np.searchsorted(base, place, "right") - 1
    k = block.size[window]
    hit = np.unique(ranges(place, k))
    for d, w in zip((np.searchsorted(base, hit, "right") - 1).tolist(), (hit - base[np.searchsorted(base, hit, "right") - 1]).tolist(), strict=True):
        out[d]["hits"].append(w)
    n = block.n_places[window]
    source = ranges(block.first_place[window], n)
    doc, place, k = np.repeat(doc, n), np.repeat(place, n), np.repeat(k, n)
    item, at = block.item[source], block.at[source]
    order = np.lexsort((place, place - at, item, doc))
    doc, place, k, item, at = doc[order], place[order], k[order], item[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - at) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        d = int(doc[f])
        out[d]["matches"].append({"item_id": block.names[item[f]], "item_start": int(at[f]), "doc_start": int(place[f] - base[d]), "length": int(place[e] - place[f] + k[e])})
    return out


#: Bytes of text that meet one block after the other when there are several.
_RUN_BYTES = 8 * SLICE_BYTES


def _both(a: dict, b: dict) -> dict:
    """What two blocks have found in one text."""
    return {"n_words": a["n_words"], "hits": sorted({*a["hits"], *b["hits"]}), "matches": a["matches"] + b["matches"]}


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, name: str = "__found") -> DataFrame:
    """The documents' columns and, under a name that must be free, n_words, hit word places, longest matches (item_id, item_start, doc_start, length in words)."""
    spark = docs.sparkSession
    small_batches(spark)
    files, n_blocks = block_files(benchmark, window, block_words)
    for file in files:
        spark.sparkContext.addFile(file)
    names = [file.rsplit("/", 1)[-1] for file in files]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _FOUND)])
    i = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = Block([], window)
        # With one block it stays; with more, each is read again for every run of documents, so runs are longer.
        kept = (list(_read_blocks(names)) or [empty]) if n_blocks == 1 else None
        for run_of_docs in slices(batches, text) if kept else gathered(batches, text, _RUN_BYTES):
            pieces = list(slices([run_of_docs], text))
            found: list[list[dict]] = [[] for _ in pieces]
            for block in kept or _read_blocks(names):
                for j, piece in enumerate(pieces):
                    new = _find(block, piece.column(i).to_pylist())
                    found[j] = [_both(a, b) for a, b in zip(found[j], new, strict=True)] if found[j] else new
            for piece, rows in zip(pieces, found, strict=True):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(rows, _FOUND_ARROW)], names=schema.names)

    return docs.mapInArrow(run, schema)


#: Contaminated: at least one word in 20 is hit.
ONE_IN = 20


def verdicts(found: DataFrame) -> DataFrame:
    """``__found`` replaced by its digest: n_words, n_hit, n_items, items_sha256, contaminated."""
    own = [F.col(f"`{c}`") for c in found.columns if c != "__found"]
    items = F.array_sort(F.array_compact(F.array_distinct("__found.matches.item_id")))
    n_words, n_hit = F.col("__found.n_words"), F.size("__found.hits").cast("long")
    return found.select(
        *own, n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * ONE_IN >= n_words)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated."""
    (name,) = unused(docs.columns, "__found")
    n_hit = F.size(f"{name}.hits")
    return find_matches(docs, benchmark, text, name=name).where(~((n_hit > 0) & (n_hit * ONE_IN >= F.col(f"{name}.n_words")))).select(*columns_of(docs))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """The digest rows by comparing every window with every place, for tests."""
    out = []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for name, body in items:
            other = words_of(body)
            k = min(window, len(other))
            for q in range(len(other) - k + 1) if k else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == other[q : q + k]:
                        hit.update(range(p, p + k))
                        names |= {name} - {None}
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and ONE_IN * len(hit) >= len(words)))
    return out

"""Repeated passages by prefix-free parsing.

A rolling hash runs over the bytes. In every window of ``SPAN`` bytes the least
hash is the window's trigger, so equal windows have equal triggers wherever
they stand. Neighbouring windows of one trigger form a phrase: the bytes from
the first one's start to the last one's end. Phrases overlap by all but their
own windows, and every window lies in exactly one.

1. Triggers that occur in two different texts are found by key. Tasks combine
   their own triggers first and send one entry each.
2. The phrases of those triggers are the dictionary; equal ones are one entry
   with the least doc_id, however often they occur.
3. For the phrases of a trigger, the suffixes that start a window are sorted (the
   suffix array of that part of the dictionary). Runs that agree in SPAN bytes
   are the repeated windows; the least doc_id in a run is where it first occurs.
   A trigger with very many phrases is resolved by its single windows instead.
4. The parse (which phrase stands where in which document) is joined to the
   dictionary, giving the windows to remove. Exact copies of whole texts need
   none of this: all but the least doc_id are removed as a whole.

Null texts are empty. Documents with a null id are kept whole and count for no
other. Rows of one id do not remove each other, whatever their texts. Extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from jointframe.llm.common import binary, bytes_of, ranges, slices, small_batches, text_of
from jointframe.session import durable

SPAN = 50
#: Bytes under the rolling hash.
TRIGGER = 16
#: Windows in a phrase at most (only periodic text has more of one trigger).
PHRASE = 64
#: Triggers and texts that a task holds before it sends them, and triggers in a bucket.
HELD, HELD_TEXTS, BUCKET = 2_000_000, 30_000, 4_000_000
#: Phrases of one trigger that are sorted in one task at most.
GROUP = 20_000
#: Phrases that are sorted together at least, but for the last ones.
GATHERED = 5_000
#: Bytes of text that are cut into phrases at a time; arrays of this length stay in the processor's cache.
CACHED = 100_000
_BASE = 0x9E3779B97F4A7C15
_KEY_BITS = 48


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def rolling(raw: np.ndarray, width: int = TRIGGER) -> np.ndarray:
    """A hash of every run of ``width`` bytes, put together from runs of half the length; ``width`` is a power of two."""
    h, w = raw.astype(np.uint64) + np.uint64(1), 1
    while w < width:
        h = h[:-w] * _power(w) + h[w:]
        w *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    w = 1
    while 2 * w <= k:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (k - w)], x[k - w :]) if w < k else x


def phrases(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger key, text, start in ``raw``, windows) of each phrase of the texts between ``bounds``."""
    parts, a = [], 0
    while not parts or a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CACHED, side="right")) - 1)
        key, text, start, windows = _cut(raw[bounds[a] : bounds[min(b, len(bounds) - 1)]], bounds[a : b + 1] - bounds[a])
        parts.append((key, text + a, start + bounds[a], windows))
        a = b
    key, text, start, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
    return key, text, start, windows


def _cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < SPAN:
        return none
    least = sliding_least(rolling(raw), SPAN - TRIGGER + 1)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(least)]
    inside = np.arange(len(least)) + SPAN <= bounds[1:][text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    # The end of a text is no start, but ends the phrase before it.
    cut = np.flatnonzero(new | ~inside)
    start = cut[inside[cut]]
    stop = np.append(cut[1:], len(least))[inside[cut]]
    pieces = -(-(stop - start) // PHRASE)
    which = np.repeat(np.arange(len(start)), pieces)
    begin = start[which] + ranges(np.zeros(len(pieces), np.int64), pieces) * PHRASE
    windows = np.minimum(PHRASE, stop[which] - begin)
    key = least[begin]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - _KEY_BITS)
    return key, text[begin].astype(np.int64), begin, windows


def _pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: list[bytes]) -> np.ndarray:
    got = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :6] = got
    return out.view("<u8").ravel()


_ENTRIES = "bucket long, doc_id long, hash long, keys binary, which binary, docs binary, texts binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "doc_id", "hash", "keys", "which", "docs", "texts"])


def _by_text(text: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The keys of each text."""
    if not len(text):
        return
    order = np.argsort(text, kind="stable")
    text, key = text[order], key[order]
    at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    for a, b in zip(at.tolist(), np.append(at[1:], len(text)).tolist(), strict=True):
        yield int(text[a]), _pack(key[a:b])


def _send(buckets: int):
    """Tasks send, for each bucket of triggers, one entry for a trigger: its text, or that the task has seen it in several texts, whose documents are told at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        docs: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, text = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            if not len(key):
                seen.clear()
                docs.clear()
                return
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            docs_, hashes_ = docs[:], [*seen]
            ids, hashes = np.array(docs_, np.int64), np.array(hashes_, np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            known = np.repeat(count > 1, count)
            rows = [(docs_[i] % buckets, docs_[i], hashes_[i], k, None, None, None) for i, k in _by_text(text[known], key[known])]
            entry = text[first] | np.where(count > 1, 1 << 15, 0)
            key = key[first]
            bucket = (key.astype(object) * buckets >> _KEY_BITS).astype(np.int64) if buckets >= 1 << 15 else ((key * np.uint64(buckets)) >> np.uint64(_KEY_BITS)).astype(np.int64)
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(at.tolist(), np.append(at[1:], len(key)).tolist(), strict=True):
                used, index = np.unique(entry[a:b] & 0x7FFF, return_inverse=True)
                index = index.astype(np.uint16) | (entry[a:b] & 0x8000).astype(np.uint16)
                rows.append((int(bucket[a]), None, None, _pack(key[a:b]), index.astype("<u2").tobytes(), ids[used].tobytes(), hashes[used].tobytes()))
            for lo in range(0, len(rows), 256):
                yield _rows(rows[lo : lo + 256])
            seen.clear()
            docs.clear()

        size = 0
        for batch in slices(batches):
            doc_id, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            fresh = []
            for i, (d, h) in enumerate(zip(doc_id, hashes, strict=True)):
                if h in seen:
                    docs[seen[h]] = min(docs[seen[h]], d)
                else:
                    seen[h] = len(docs)
                    docs.append(d)
                    fresh.append(i)
            raw, bounds = bytes_of(text_of(batch).take(pa.array(fresh, pa.int64())))
            key, text, _, _ = phrases(raw, bounds)
            text += len(docs) - len(fresh)
            order = np.lexsort((key, text))
            key, text = key[order], text[order]
            once = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[: len(key)]
            held.append((key[once], text[once]))
            size += int(once.sum())
            if size >= HELD or len(docs) >= HELD_TEXTS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, keys): which triggers of a document stand in another text too. Rows come sorted by bucket."""
    held: list[dict] = []

    def close() -> Iterator[tuple[int, int, bytes]]:
        key = _unpack([r["keys"] for r in held])
        which, base, n = [], [], 0
        for r in held:
            which.append(np.frombuffer(r["which"], "<u2").astype(np.int64))
            base.append(np.full(len(which[-1]), n))
            n += len(r["docs"]) // 8
        entry = np.concatenate(which)
        several = entry >= 1 << 15
        at = (entry & 0x7FFF) + np.concatenate(base)
        docs, texts = (np.frombuffer(b"".join(r[c] for r in held), np.int64) for c in ("docs", "texts"))
        order = np.argsort(key, kind="stable")
        key, at, several = key[order], at[order], several[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own = texts[at]
        meet = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | np.logical_or.reduceat(several, first)
        tell = np.repeat(meet, np.diff(np.append(first, len(key)))) & ~several
        held.clear()
        for i, k in _by_text(at[tell], key[tell]):
            yield int(docs[i]), int(texts[i]), k

    def batches_of(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 5000):
            ids, hashes, keys = zip(*rows[lo : lo + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "hash", "keys"])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                out += close()
            if row["doc_id"] is None:
                held.append(row)
            else:
                out.append((row["doc_id"], row["hash"], row["keys"]))
        yield from batches_of(out)
    if held:
        yield from batches_of([*close()])


#: Seeds of the two halves of a phrase's digest; ``_code`` is the same in SQL, where a leading 7 gives the second one.
_SEEDS = 42, int.from_bytes(xxh64_digest((7).to_bytes(8, "little"), 42), "big")


def _digests(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Two numbers (n, 2), 128 bits, for each cut of ``raw``."""
    data = memoryview(raw.tobytes())
    cuts = [data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return np.stack([np.fromiter((xxh64_intdigest(c, seed) for c in cuts), np.uint64, len(cuts)).view(np.int64) for seed in _SEEDS], 1)


def _code(phrase: str) -> list[Column]:
    return [F.xxhash64(phrase).alias("a"), F.xxhash64(F.lit(7).cast("long"), F.col(phrase)).alias("b")]


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc_id, hash, start, key, phrase) of the phrases asked for; of equal ones in a slice, only that of the least doc_id and that of the greatest show key and phrase. Rows are (doc_id, text, hash, list of keys)."""
    for batch in slices(batches):
        raw, bounds = bytes_of(text_of(batch))
        key, text, start, windows = phrases(raw, bounds)
        asked = [_unpack(x) for x in batch.column(3).to_pylist()]
        wanted = np.concatenate([k | (np.uint64(i) << np.uint64(_KEY_BITS)) for i, k in enumerate(asked)])
        keep = np.isin(key | (text.astype(np.uint64) << np.uint64(_KEY_BITS)), wanted)
        key, text, start, windows = key[keep], text[keep], start[keep], windows[keep]
        if not len(key):
            continue
        code = _digests(raw, start, windows + SPAN - 1)
        doc = batch.column(0).to_numpy()[text]
        order = np.lexsort((doc, code[:, 1], code[:, 0]))
        new = np.append(True, (np.diff(code[order], axis=0) != 0).any(1))
        shown = np.zeros(len(key), bool)
        shown[order[new]] = True
        shown[order[np.append(new[1:], True)]] = True
        size = np.where(shown, windows + SPAN - 1, 0)
        phrase = binary(raw, start, size)
        phrase = pa.Array.from_buffers(pa.binary(), len(key), [pa.array(shown).buffers()[1], *phrase.buffers()[1:]], null_count=int((~shown).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(doc), batch.column(2).take(pa.array(text)), pa.array((start - bounds[text]).astype(np.int64)), pa.array(key.astype(np.int64)), phrase],
            names=["a", "b", "doc_id", "hash", "start", "key", "phrase"],
        )


_RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64())]))


def _sort_suffixes(group: int):
    """(a, b, runs, doc_id, phrase): for each phrase, runs of windows lo to hi (without hi) that first occur in document ``first``.

    Rows are (key, phrase, doc_id), sorted by key. Those of a trigger with more than ``group`` rows are passed on as doc_id and phrase.
    """

    def close(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, bounds = bytes_of(part.column(1))
        key, doc = part.column(0).to_numpy(), part.column(2).to_numpy()
        # Equal phrases become one, with the least and the greatest document.
        code = _digests(raw, bounds[:-1], np.diff(bounds))
        order = np.lexsort((doc, code[:, 1], code[:, 0], key))
        new = np.flatnonzero(np.append(True, (np.diff(code[order], axis=0) != 0).any(1) | (np.diff(key[order]) != 0)))
        row = order[new]
        least, most = doc[row], doc[order[np.append(new[1:], len(order)) - 1]]
        windows = np.diff(bounds)[row] - SPAN + 1
        # The windows of a trigger's only phrase all occur in the same documents.
        other = np.diff(key[row]) != 0
        only = np.append(True, other) & np.append(other, True)
        shared = only & (least != most)
        size, lo, hi, first = shared.astype(np.int64), np.zeros(int(shared.sum()), np.int64), windows[shared], least[shared]
        if not only.all():
            at, (per, *runs) = np.flatnonzero(~only), arrays(raw, bounds[row], key[row], least, most, windows, ~only)
            size[at] = per
            place = np.argsort(np.concatenate([np.flatnonzero(shared), np.repeat(at, per)]), kind="stable")
            lo, hi, first = (np.concatenate(x)[place] for x in zip((lo, hi, first), runs, strict=True))
        offsets = np.concatenate([[0], np.cumsum(size[size > 0])]).astype(np.int32)
        kept = code[row[size > 0]]
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi), pa.array(first)], names=["lo", "hi", "first"]))
        return _told(pa.array(kept[:, 0]), pa.array(kept[:, 1]), runs.cast(_RUNS), pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.binary()))

    def arrays(raw: np.ndarray, start: np.ndarray, key: np.ndarray, least: np.ndarray, most: np.ndarray, windows: np.ndarray, sort: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the phrases in ``sort``: how many runs each has, and their lo, hi and first."""
        start, key, least, most, windows = (x[sort] for x in (start, key, least, most, windows))
        owner = np.repeat(np.arange(len(key)), windows)
        base = np.cumsum(windows) - windows
        trigger = np.cumsum(np.append(0, np.diff(key) != 0)).astype(">u4")
        grid = np.empty((len(owner), 4 + SPAN), np.uint8)
        grid[:, :4] = trigger.view(np.uint8).reshape(-1, 4)[owner]
        grid[:, 4:] = np.lib.stride_tricks.sliding_window_view(raw, SPAN)[ranges(start, windows)]
        suffix = grid.view(f"S{4 + SPAN}").ravel()
        order = np.argsort(suffix, kind="stable")
        suffix = suffix[order]
        at = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1]))
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(least[owner][order], at), np.diff(np.append(at, len(order))))
        turn = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])))
        own = owner[turn]
        lo, hi = turn - base[own], np.append(turn[1:], len(owner)) - base[own]
        # Phrases of one document only, all of whose windows first occur there, remove nothing.
        show = ~np.logical_and.reduceat(first == most[owner], base)[own]
        return np.bincount(own[show], minlength=len(key)), lo[show], hi[show], first[turn][show]

    def passed(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        return _told(pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, _RUNS), part.column(2), part.column(1))

    def split(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = part.column(0).to_numpy()
        size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        many = np.repeat(size > group, size)
        if many.any():
            yield passed(part.filter(pa.array(many)))
            part = part.filter(pa.array(~many))
        if part.num_rows:
            yield close(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, crowded = [], 0, None
        for batch in batches:
            key = batch.column(0).to_numpy()
            if crowded is not None and (left := int(np.searchsorted(key, crowded, side="right"))):
                yield passed(batch.slice(0, left))
                batch = batch.slice(left)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size < GATHERED:
                continue
            # All triggers but the last are complete.
            part = pa.concat_batches(held)
            key = part.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from split(part.slice(0, last))
            held, size = [part.slice(last)], len(key) - last
            if size > group:
                yield passed(held[0])
                held, size, crowded = [], 0, int(key[-1])
        if held:
            yield from split(pa.concat_batches(held))

    return run


def _told(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["a", "b", "runs", "doc_id", "phrase"])


def _single_windows(crowded: DataFrame) -> DataFrame:
    """The runs of triggers with very many phrases, by one row for each window and no task for a trigger."""
    windows = crowded.select("a", "b", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("phrase") - (SPAN - 1)), lambda i: F.substring(F.col("phrase"), i, F.lit(SPAN)))).alias("lo", "window"))
    windows = windows.groupBy("a", "b", "lo", "window").agg(F.min("doc_id").alias("doc_id"))
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    run = F.struct(F.col("lo").cast("long").alias("lo"), (F.col("lo") + 1).cast("long").alias("hi"), "first")
    return windows.join(first, "window").groupBy("a", "b").agg(F.collect_list(run).alias("runs"))


def _asked(met: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, hash, keys) of documents that are no copies.

    A document is told by every bucket it has triggers in, so its rows are put
    together before they meet the copies; an anti join would go first.
    """
    whole = met.groupBy("doc_id", "hash").agg(F.collect_list("keys").alias("keys"))
    return whole.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "hash"], "left").where("copy is null").drop("copy")


def spans(docs: DataFrame, held: int = BUCKET, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((doc_id, hash, spans) to remove from documents that are no copies, (doc_id, hash) of the copies) for ``docs`` (doc_id, text, hash of the text) without null ids.

    Triggers, copies, what documents are asked for and the runs of phrases are
    written out, and the shuffles behind them end there. Phrases are shuffled
    once, in a plan of their own; their places in the next one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(1, total * 2 // (SPAN - TRIGGER + 2) // held + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2))
    same = docs.select("doc_id", "hash", F.md5(F.col("text").cast("binary")).alias("same"))
    least = same.groupBy("same").agg(F.min("doc_id").alias("least"))
    copies = durable(same.join(least, "same").where("doc_id > least").select("doc_id", "hash").distinct(), ended=True)
    sent = docs.mapInArrow(_send(buckets), _ENTRIES)
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "doc_id long, hash long, keys binary")
    asked = durable(_asked(met, copies), ended=True)
    stand = docs.join(asked, ["doc_id", "hash"]).select("doc_id", "text", "hash", "keys").mapInArrow(_dictionary, "a long, b long, doc_id long, hash long, start long, key long, phrase binary")
    entries = stand.where("phrase is not null").select("key", "phrase", "doc_id").repartition("key").sortWithinPartitions("key")
    told = durable(entries.mapInArrow(_sort_suffixes(group), "a long, b long, runs array<struct<lo: long, hi: long, first: long>>, doc_id long, phrase binary"), ended=True)
    runs = told.where("runs is not null").select("a", "b", "runs")
    runs = runs.unionByName(_single_windows(told.where("phrase is not null").select(*_code("phrase"), "doc_id", "phrase")))
    hit = stand.select("doc_id", "hash", "start", "a", "b").join(runs, ["a", "b"])
    hit = hit.select("doc_id", "hash", "start", F.inline("runs")).where("first < doc_id")
    hit = hit.select("doc_id", "hash", F.struct((F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") + (SPAN - 1)).alias("e")).alias("span"))
    return hit.groupBy("doc_id", "hash").agg(F.collect_list("span").alias("spans")), copies


def merged(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans_):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    found, copies = spans(named)
    told = found.select("doc_id", "hash", "spans", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "hash", F.lit(None).cast("array<struct<s: long, e: long>>").alias("spans"), F.lit(True).alias("copy")))
    joined = named.join(told, ["doc_id", "hash"], "left").select("doc_id", "text", "spans", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, bounds = bytes_of(text_of(batch))
            data = memoryview(raw.tobytes())
            rows = []
            for i, (cut, copy) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = int(bounds[i]), int(bounds[i + 1])
                cuts = [(0, b - a)] if copy and b - a >= SPAN else merged([(x["s"], x["e"]) for x in cut or ()])
                kept, at = hashlib.sha256(), a
                for s, e in cuts:
                    kept.update(data[at : a + s])
                    at = a + e
                kept.update(data[at:b])
                rows.append((b - a, sum(e - s for s, e in cuts), len(cuts), kept.hexdigest()))
            n, removed, count, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    none = F.lit(0).cast("long")
    rest = docs.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return out.unionByName(rest)


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The digest rows by a table of every window, for tests."""
    least: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - SPAN + 1):
                w = b[i : i + SPAN]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, b in data:
        cuts = merged([(i, i + SPAN) for i in range(len(b) - SPAN + 1) if d is not None and least[b[i : i + SPAN]] < d])
        kept, at = b"", 0
        for s, e in cuts:
            kept += b[at:s]
            at = e
        out.append((d, len(b), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out

"""Binary token-id files, coded by an adaptive context-mixing range coder.

Documents are encoded in ascending doc_id order. Runs of whole documents form a
chunk, one row of a Parquet table: the ids of its documents, their sizes, its
place in the part, and its blocks. A block holds up to ``BLOCK`` ids and is
independent of all others: header (magic, ids, payload bytes, crc32 of the ids,
crc32 of the payload) and payload.

Coder of a block: an order-2 and an order-1 table each predict the next id from
the last two ids or the last one, with a confidence; order 0 is the list of ids
seen in the block. An id is coded as one of four events - the order-2 guess is
right, the order-1 guess is right, it is an id seen before (its number in the
list follows), it is new (the id follows). The events' probabilities mix two
adaptive counts, one kept by the order-2 confidence, one by the order-1
confidence. A carry-less range coder with 64-bit state writes 16-bit words. All
blocks of a chunk are coded side by side, one id of each at a time.

Null texts are empty: one end id. Repeated ids keep all their rows, in text
order; a null doc_id comes first. Empty tables give an empty table. Extra
columns are not read. A damaged block fails the read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jointframe.llm.common import gathered, small_batches, text_of
from jointframe.llm.tokens import END_ID, encoder, vocabulary_path, with_end
from jointframe.session import ensure_checkpoint_dir

BLOCK = 1024
#: Blocks coded side by side at most, and the blocks of ids after which a chunk is closed; one more batch may be in it.
LANES, CHUNK_BLOCKS = 5120, 2048
#: Ids are below this.
IDS = 1 << 16
MAGIC = b"TCM1"
_HEAD = struct.Struct("<4sIIII")
_SLOTS = 1 << 9
_STEP, _LIMIT = 24, 2048
_TOP, _LOW_RANGE = np.uint64(1 << 48), np.uint64(1 << 32)
_W16, _W48 = np.uint64(16), np.uint64(48)


#: Counts of the four events stand in 16 bits each of one number; times _SUMS they become their running sums.
_ONES = np.uint64(0x0001000100010001)
_SUMS, _HALF = _ONES, np.uint64(0x7FFF7FFF7FFF7FFF)
_COUNT = np.uint64(0xFFFF)
_AT = np.arange(0, 64, 16, dtype=np.uint64)
_MORE = np.uint64(_STEP) << _AT


class _Mixer:
    """The model of all lanes; the same for coding and decoding.

    A slot of a guess table holds 4 * id + confidence; empty ones hold -4.
    Counts are by lane and confidence.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.base, self.base4 = self.lane * _SLOTS, self.lane * 4
        self.table = [np.full(lanes * _SLOTS, -4, np.int32) for _ in range(2)]
        self.counts = [np.full(lanes * 4, _ONES) for _ in range(2)]
        self.last = [np.zeros(lanes, np.uint32) for _ in range(2)]

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Frequencies of the four events, their running sums and the two guesses, for the first k lanes."""
        a = self.last[0][:k] * np.uint32(0x9E3779B1)
        both = self.last[1][:k] * np.uint32(0x85EBCA6B)
        both += a
        self.slot = [((x >> np.uint32(bits)) & np.uint32(_SLOTS - 1)) + self.base[:k] for x, bits in ((both, 15), (a, 17))]
        self.held = [self.table[i].take(self.slot[i]) for i in (0, 1)]
        self.level = [h & 3 for h in self.held]
        self.row = [self.base4[:k] + v for v in self.level]
        self.own = [self.counts[i].take(self.row[i]) for i in (0, 1)]
        freq = self.own[0] + self.own[1]
        return freq, freq * _SUMS, [h >> 2 for h in self.held]

    def update(self, k: int, ids: np.ndarray, event: np.ndarray, hits: list[np.ndarray], step: int) -> None:
        fresh, more = ids << 2, _MORE.take(event)
        for i in (0, 1):
            counts, level, held = self.counts[i], self.level[i], self.held[i]
            counts[self.row[i]] = self.own[i] + more
            self.table[i][self.slot[i]] = np.where(hits[i], held + (level < 3), np.where(level > 0, held - 1, fresh))
            if step % 64 == 63:
                big = (counts * _SUMS) >> _W48 > _LIMIT
                counts[big] = ((counts[big] + _ONES) >> np.uint64(1)) & _HALF
        self.last[1][:k] = self.last[0][:k]
        self.last[0][:k] = ids


def _first_seen(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(lanes, BLOCK): the number, in order of appearance in its lane, of each id. Only the last lane may be short."""
    lanes, width = ids.shape
    # Sorted by id and place in one number; the first of each id in a lane is where it appears.
    bits = max(1, (width - 1).bit_length())
    key = ids.astype(np.uint32 if bits <= 16 else np.uint64) << bits
    key |= np.arange(width, dtype=key.dtype)
    key.sort(axis=1)
    head = np.ones((lanes, width), bool)
    np.not_equal(key[:, 1:] >> bits, key[:, :-1] >> bits, out=head[:, 1:])
    key &= key.dtype.type((1 << bits) - 1)
    place = key.astype(np.int64)
    place += np.arange(0, lanes * width, width)[:, None]
    place, at = place.ravel(), np.flatnonzero(head)
    first = np.zeros(lanes * width, bool)
    first[place[at]] = True
    rank = np.cumsum(first.reshape(lanes, width), axis=1, dtype=np.int32).ravel()
    number = np.empty(lanes * width, np.int32)
    number[place] = np.repeat(rank[place[at]] - np.int32(1), np.diff(np.append(at, lanes * width)))
    return number.reshape(lanes, width)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of a run of ids, each with its header."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError(f"ids must be below {IDS}")
    out: list[bytes] = []
    for lo, hi in _runs(-(-len(ids) // block)):
        out += _encode_side_by_side(ids[lo * block : hi * block].astype(np.int32), block)
    return out


def _runs(blocks: int) -> list[tuple[int, int]]:
    """Bounds of even runs of at most ``LANES`` blocks; a step costs much the same for few blocks as for many."""
    runs = -(-blocks // LANES)
    return [(i * blocks // runs, (i + 1) * blocks // runs) for i in range(runs)]


def _encode_side_by_side(ids: np.ndarray, block: int) -> list[bytes]:
    lanes = -(-len(ids) // block)
    sizes = np.full(lanes, block)
    sizes[-1] = len(ids) - (lanes - 1) * block
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(ids)] = ids
    grid = grid.reshape(lanes, block)
    number = _first_seen(grid, sizes)
    columns, numbers = np.ascontiguousarray(grid.T), np.ascontiguousarray(number.T)
    mixer = _Mixer(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    words, at = np.zeros((lanes, 3 * block + 8), np.uint16), np.zeros(lanes, np.int64)
    seen = np.zeros(lanes, np.int32)
    for step in range(block):
        k = lanes if step < sizes[-1] else lanes - 1
        if not k:
            break
        x, n = columns[step, :k], numbers[step, :k]
        freq, sums, guesses = mixer.predict(k)
        m = seen[:k]
        hits, new = [g == x for g in guesses], n >= m
        event = ~hits[0] * (np.uint8(1) + ~hits[1] * (np.uint8(1) + new))
        at_event = _AT.take(event)
        own = (freq >> at_event) & _COUNT
        r = rng[:k] // (sums >> _W48)
        lo = low[:k] + r * (((sums >> at_event) & _COUNT) - own)
        r *= own
        # The second symbol: nothing to say after a right guess, else the number in the list or the id.
        said = np.flatnonzero(event > 1)
        which = np.where(new, x, n).take(said).astype(np.uint64)
        part = r.take(said) // np.where(new, np.int32(IDS), m).take(said).astype(np.uint64)
        lo[said] += part * which
        r[said] = part
        low[:k], rng[:k] = lo, r
        _shift(low, rng, k, lambda active, lo: _put(words, at, active, lo))
        seen[:k] = np.maximum(m, n + 1)
        mixer.update(k, x, event, hits, step)
    for _ in range(4):
        words[mixer.lane, at] = (low >> _W48).astype(np.uint16)
        low <<= _W16
        at += 1
    out = []
    for i in range(lanes):
        payload = words[i, : at[i]].astype("<u2").tobytes()
        own = grid[i, : sizes[i]].astype("<u4").tobytes()
        out.append(_HEAD.pack(MAGIC, int(sizes[i]), len(payload), zlib.crc32(own), zlib.crc32(payload)) + payload)
    return out


def _shift(low: np.ndarray, rng: np.ndarray, k: int, move) -> None:
    """Move out the words that are settled; a range too small to go on is cut so that it settles."""
    active, lo, r = None, low[:k], rng[:k]
    while True:
        settled = (lo ^ (lo + r)) < _TOP
        small = r < _LOW_RANGE
        go = np.flatnonzero(settled | small)
        if not len(go):
            return
        active = go if active is None else active[go]
        lo, r, settled = lo[go], r[go], settled[go]
        if not settled.all():
            r = np.where(settled, r, (~lo + np.uint64(1)) & (_LOW_RANGE - np.uint64(1)))
        move(active, lo)
        lo, r = lo << _W16, r << _W16
        low[active], rng[active] = lo, r


def _put(words: np.ndarray, at: np.ndarray, active: np.ndarray, low: np.ndarray) -> None:
    place = at[active]
    words[active, place] = low >> _W48
    at[active] = place + 1


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """All ids of the blocks, one block after the other; raises on damage."""
    parts = [_decode_side_by_side(blocks[lo:hi]) for lo, hi in _runs(len(blocks))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _decode_side_by_side(blocks: list[bytes]) -> np.ndarray:
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for (magic, _, size, _, crc), b in zip(heads, blocks, strict=True):
        if magic != MAGIC or len(b) != _HEAD.size + size or zlib.crc32(memoryview(b)[_HEAD.size :]) != crc:
            raise ValueError("a block of token ids is damaged")
    order = np.argsort([-h[1] for h in heads], kind="stable")  # longest first, so that finished lanes are the last
    sizes = np.array([heads[i][1] for i in order], np.int64)
    lanes, width = len(blocks), int(sizes[0])
    length = np.array([heads[i][2] // 2 for i in order])
    words = np.zeros((lanes, int(length.max()) + 1), np.uint16)
    for j, i in enumerate(order):
        words[j, : length[j]] = np.frombuffer(blocks[i], "<u2", offset=_HEAD.size)
    end = words.shape[1] - 1
    mixer = _Mixer(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = (code << _W16) | words[:, i]
    at = np.full(lanes, 4)
    listed, seen = np.zeros((lanes, width), np.int32), np.zeros(lanes, np.int64)
    out = np.zeros((width, lanes), np.int32)

    def take(active: np.ndarray, _: np.ndarray) -> None:
        place = at[active]
        code[active] = (code[active] << _W16) | words[active, np.minimum(place, end)]
        at[active] = place + 1

    for step in range(width):
        k = int(np.searchsorted(-sizes, -step, "left"))  # lanes with more than step ids
        freq, sums, guesses = mixer.predict(k)
        total = sums >> _W48
        r = rng[:k] // total
        t = np.minimum((code[:k] - low[:k]) // r, total - np.uint64(1))
        event = np.zeros(k, np.uint8)
        for bits in _AT[:3]:
            event += t >= (sums >> bits) & _COUNT
        at_event = _AT.take(event)
        own = (freq >> at_event) & _COUNT
        lo = low[:k] + r * (((sums >> at_event) & _COUNT) - own)
        r *= own
        m = seen[:k]
        x = np.where(event == 0, guesses[0], guesses[1])
        said = np.flatnonzero(event > 1)
        fresh, number = event.take(said) == 3, m.take(said)
        many = np.where(fresh, IDS, number).view(np.uint64)
        part, under = r.take(said) // many, lo.take(said)
        which = np.minimum((code.take(said) - under) // part, many - np.uint64(1))
        lo[said] = under + part * which
        r[said] = part
        which = which.view(np.int64)
        x[said] = np.where(fresh, which.astype(np.int32), listed[said, np.minimum(which, width - 1)])
        low[:k], rng[:k] = lo, r
        _shift(low, rng, k, take)
        # An id that a guess was right about has been seen, unless the guess is from before it was listed: guesses come from the block, so it is listed.
        new = said[fresh]
        listed[new, number[fresh]] = x[new]
        seen[new] += 1
        out[step, :k] = x
        mixer.update(k, x, event, [g == x for g in guesses], step)
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    result = [out[: sizes[j], j].astype(np.uint32) for j in back]
    for (_, _, _, crc, _), ids in zip(heads, result, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    return np.concatenate(result)


_CHUNK = "part int, first long, n_tokens long, doc_ids array<long>, sizes array<long>, blocks array<binary>"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write ``docs`` (doc_id, text) to ``path``, any store that Spark can write to."""
    file = vocabulary or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, first = encoder(file), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x, _ in held])
            docs_, sizes = [i for d, _, _ in held for i in d.to_pylist()], np.concatenate([s for *_, s in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([encode_blocks(ids)], pa.list_(pa.binary()))],
                names=["part", "first", "n_tokens", "doc_ids", "sizes", "blocks"],
            )

        for batch in gathered(batches):
            ids, bounds = with_end(*words.encode(text_of(batch)), end_id)
            held.append((batch.column(0), ids, np.diff(bounds)))
            if sum(len(x) for _, x, _ in held) >= CHUNK_BLOCKS * BLOCK:
                row = close()
                first += row.column(2)[0].as_py()
                held.clear()
                yield row
        if held:
            yield close()

    # Parts follow each other in doc_id order; every part is one task's own file.
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _CHUNK).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    small_batches(spark, 2)
    chunks = spark.read.schema(_CHUNK).parquet(path)
    totals = sorted((r.part, r.n) for r in chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file written
    base, total = {}, 0
    for part, n in totals:
        base[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["blocks"])
                if len(ids) != row["n_tokens"]:
                    raise ValueError("a chunk of token ids is damaged")
                sizes = np.array(row["sizes"], np.int64)
                start = np.cumsum(sizes) - sizes
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start + row["first"] + base[row["part"]]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.select("part", "first", "n_tokens", "doc_ids", "sizes", "blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write to the shared checkpoint folder and read back."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return read(spark, path)

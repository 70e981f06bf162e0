"""Importance resampling towards a target distribution.

Features of a text are its words and word pairs, hashed into buckets. A
bucket's gain is the scaled log ratio of its smoothed shares in the target and
in the source; a document's weight is the mean gain of its features. A draw
without replacement by weight is the highest scores, the score being the weight
plus a Gumbel number drawn from the document's id.

Weights are worked out on arrays: words of a slice of texts are found in its
bytes, the CRC of all of them and of all pairs is run side by side, and gains
are looked up by bucket. Counts of buckets are added up inside each task, so no
more than ``BUCKETS`` rows leave a task or reach the driver.

The cutoff of the draw: a quantile sketch of the scores gives a bracket, exact
counts outside validate it or it is widened, and only the rows in the bracket
are sorted to find the last one drawn. Ranks come from a range partition of the
drawn rows: place inside the partition plus the sizes of those before.

Null texts have no words; a document without features has weight 0. Documents
of fewer than ``MIN_WORDS`` words are scored but never drawn. A null id draws
like an empty one and comes last among ties. Rows that agree in score, id and
features are interchangeable: the draw takes as many of them as its size asks
for, ``resample`` keeps all of them. Repeated rows are documents of their own.
Texts are read as a whole, however long. Empty input gives empty output; an
empty target gives every bucket the same odds as one seen nowhere. Extra
columns pass through ``weigh`` and ``resample``; columns of the input with the
name of a result are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import bytes_of, slices, small_batches, text_of, unused
from jointframe.session import durable

BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PCT = 25
SEED = 7
#: Half the width of the first bracket, as a share of the rows, and how exact the sketch is.
MARGIN, ACCURACY = 0.002, 10_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Fixed value: word bytes are digits, lower-cased letters and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def crc32(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of cuts of ``raw``, side by side; with ``before``, of the text with that CRC and the cut."""
    crc = np.zeros(len(starts), np.uint32) if before is None else before
    out = crc.copy()
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    long_ = int(np.count_nonzero(lengths > LONG_WORD))
    for i in order[:long_].tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + lengths[i]].tobytes(), int(crc[i]))
    order = order[long_:]
    at, state = starts[order], ~crc[order]
    # Words by falling length: those that have a byte at a position stand in front.
    longer = np.cumsum(np.bincount(lengths[order], minlength=LONG_WORD + 1)[::-1])[::-1]
    for k in range(LONG_WORD):
        m = int(longer[k + 1])
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ raw[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[order] = ~state
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all words, buckets of all pairs, whether a word has a pair with the next)."""
    raw, at = bytes_of(texts)
    raw = _LOWER[raw]
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    lengths = ends - starts
    single = crc32(raw, starts, lengths)
    paired = np.ones(len(starts), bool)
    paired[first[1:][n_words > 0] - 1] = False
    i = np.flatnonzero(paired)
    space = np.uint32(0xFFFFFFFF) ^ single[i]
    space = ~(_CRC[(space ^ np.uint32(32)) & np.uint32(255)] ^ (space >> np.uint32(8)))
    pairs = crc32(raw, starts[i + 1], lengths[i + 1], space)
    return n_words, single % np.uint32(buckets), pairs % np.uint32(buckets), paired


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches):
            _, single, pairs, _ = features(text_of(b), buckets)
            total += np.bincount(single, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, floored."""
    k, n, m = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (n + k) / ((s + 1) * (m + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(ident: str | None, seed: int = SEED) -> int:
    """Thousandths of the Gumbel number of an id, floored."""
    h = int.from_bytes(sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", ident: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The rows with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    small_batches(docs.sparkSession)
    names = ["n_words", "n_features", "weight", "score"]
    kept = [c for c in docs.columns if c.lower() not in names]
    read, of = unused([*kept, *names], "__text", "__of")
    reads = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(read), F.col(f"`{ident}`").cast("string").alias(of))
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, read):
            n_words, single, pairs, paired = features(text_of(b, read), len(gain))
            each = gain[single]
            each[paired] += gain[pairs]
            sums = np.concatenate(([0], np.cumsum(each)))
            ends = np.cumsum(n_words)
            n = n_words + np.maximum(n_words - 1, 0)
            weight = (sums[ends] - sums[ends - n_words]) // np.maximum(n, 1)
            score = weight + np.array([gumbel(i, seed) for i in b.column(len(kept) + 1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, (n_words, n, weight, score))], [*kept, *names])

    return reads.mapInArrow(run, schema)


def _order(ident: str) -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last(f"`{ident}`"), F.asc("n_features")]


def placed(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows, written, with their partition and place in it by the order, and the rows before each partition."""
    part, place = unused(rows.columns, "__part", "__place")
    number = F.monotonically_increasing_id()  # partition and place, as the rows stand after the sort
    df = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, number))
    df = df.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    before, sums = 0, []
    for r in df.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        sums.append((r[0], before))
        before += r.n
    return df, sums


def cutoff(scored: DataFrame, ident: str = "doc_id", share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS, margin: float = MARGIN) -> tuple[int, Row | None]:
    """(rows to draw, the last row drawn or None); ``scored`` should be a written table."""
    able = scored.where(F.col("n_words") >= min_words)
    want, last = None, None
    while True:
        ends = [max(0.0, 1 - share_pct / 100 - margin), min(1.0, 1 - share_pct / 100 + margin)]
        n, sketch, least, most = able.agg(F.count("*"), F.percentile_approx("score", ends, ACCURACY), F.min("score"), F.max("score")).first()
        want = share_pct * n // 100
        if not want:
            return 0, None
        low, high = (least, most) if margin >= 1 else sketch
        above, inside = able.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < want <= above + inside:
            break
        margin *= 8
    order = _order(ident)
    bracket, sums = placed(able.where(F.col("score").between(low, high)).select("score", F.col(f"`{ident}`").alias("id"), "n_features"), _order("id"))
    part, before = [x for x in sums if x[1] < want - above][-1]
    last = bracket.where((F.col("__part") == part) & (F.col("__place") == want - above - before - 1)).first()
    return want, last


def _drawn(last: Row | None, ident: str, min_words: int) -> Column:
    """True for rows up to the last one drawn."""
    if last is None:
        return F.lit(False)
    own, nf = F.col(f"`{ident}`"), F.col("n_features")
    if last.id is None:
        tied = own.isNotNull() | (nf <= last.n_features)
    else:
        tied = F.coalesce((own < last.id) | ((own == last.id) & (nf <= last.n_features)), F.lit(False))
    return (F.col("n_words") >= min_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & tied))


def draw(scored: DataFrame, ident: str = "doc_id", share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows with ``rank``: 1, 2, ... for the rows drawn, by falling score, else null."""
    spark = scored.sparkSession
    want, last = cutoff(scored, ident, share_pct, min_words)
    drawn = _drawn(last, ident, min_words)
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return rest
    rows, sums = placed(scored.where(drawn), _order(ident))
    part, place = rows.columns[-1], rows.columns[-2]
    base = spark.createDataFrame(sums, f"{part} long, __before long")  # a row for each partition
    rank = F.col(place) + F.col("__before") + 1
    ranked = rows.join(F.broadcast(base), part).withColumn("rank", F.when(rank <= want, rank))
    return ranked.select(*rest.columns).unionByName(rest)


def fit(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket."""
    return gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", ident: str = "doc_id", share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The documents drawn, as they are."""
    gain = fit(docs, target, text)
    scored = durable(weigh(docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")), gain, ident="id", seed=seed).drop("text"))
    _, last = cutoff(scored, "id", share_pct, min_words)
    row, own = unused([*docs.columns, "n_words", "n_features", "weight", "score"], "__row", "__id")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{ident}`").alias(own), F.col(f"`{text}`").alias("text"))
    return weigh(packed, gain, ident=own, seed=seed).where(_drawn(last, own, min_words)).select(f"{row}.*")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's features, weight, score and rank in the draw."""
    scored = durable(weigh(docs, fit(docs, target)).drop("text"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = """SELECT doc_id, w[i] AS f FROM {w}, unnest(range(1, len(w) + 1)) u(i) UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM {w}, unnest(range(1, len(w))) u(i)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH RECURSIVE step(b, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
dw AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents), bw AS (SELECT item_id AS doc_id, {_WORDS} AS w FROM benchmark),
df AS ({_FEATURES.format(w="(SELECT row AS doc_id, w FROM dw)")}), bf AS ({_FEATURES.format(w="bw")}),
names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(f)), '..')]),
  lambda c, x: xor(t[1 + xor(c, x) % 256], c >> 8)), 4294967295) % 10000 AS b FROM names, crc),
ds AS (SELECT b, count(*) AS n FROM df JOIN hashed USING (f) GROUP BY b), bs AS (SELECT b, count(*) AS n FROM bf JOIN hashed USING (f) GROUP BY b),
g AS (SELECT r.range AS b, floor(1000 * ln(CAST((coalesce(bs.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM ds) + 10000) AS DOUBLE) /
  CAST((coalesce(ds.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM bs) + 10000) AS DOUBLE))) AS gain FROM range(10000) r LEFT JOIN ds ON ds.b = r.range LEFT JOIN bs ON bs.b = r.range),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM df JOIN hashed USING (f) JOIN g USING (b) GROUP BY doc_id),
s AS (SELECT dw.doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(dw.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS gumbel FROM dw LEFT JOIN m ON m.doc_id = dw.row),
o AS (SELECT *, weight + gumbel AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + gumbel DESC, doc_id NULLS LAST, n_features) AS place FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM s WHERE n_words >= 20) // 100 THEN place END AS rank FROM o"""

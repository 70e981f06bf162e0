"""Language identification by a byte convolutional network.

Bytes are embedded, convolved by filters of several widths, passed through a
rectifier, max pooled over a window and put into a softmax. Training is plain
numpy (Adam on mini-batches) on windows of a labelled sample of at most
``SAMPLE`` documents of each language. Inference cuts the whole text into
fixed-length windows; since an embedding followed by a filter is linear in
pairs of bytes, filters are read from tables of byte pairs. A text's
probabilities are the mean of its windows', weighted by their letters.

Null texts and texts without a letter are ``und`` with score 0. Rows are
judged one by one, so ties, repeated rows and null ids need no rule; extra
columns pass through. Without a labelled row every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import few_of_each, slices, small_batches
from jointframe.session import durable

#: Labelled documents of each language, and windows of a document, that training sees at most.
SAMPLE = 500
SAMPLE_WINDOWS = 6
WINDOW = 192
EMBEDDING, FILTERS, WIDTHS = 8, 12, (2, 3, 4)
STEPS, BATCH, RATE = 900, 48, 4e-3
#: Windows worked on at a time.
CHUNK = 512
#: Letters, and characters such as fractions that only look like some to the pattern.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Net:
    """Weights: bytes to embedding, (width * embedding) to filters for each width, pooled filters to languages."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last one is filled up with blanks. Rows overlap so that no filter misses a place."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.full((n - 1) * step + WINDOW, 32, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _forward(net: Net, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    e = net.embed[x]
    kept, pooled = [], []
    for w, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
        cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - w + 1, w * EMBEDDING)
        y = cols @ f
        at = y.argmax(1)
        best = np.take_along_axis(y, at[:, None, :], 1)[:, 0] + b
        kept.append((at, best))
        pooled.append(np.maximum(best, 0))
    h = np.concatenate(pooled, 1)
    z = h @ net.out + net.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True), kept, h


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 5) -> Net:
    """Train on windows ``x`` (n, WINDOW) with labels ``y``; languages are drawn alike often."""
    rng = np.random.default_rng(seed)
    n = len(langs)
    h = FILTERS * len(WIDTHS)
    f32 = np.float32
    net = Net(
        langs, rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32), [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS],
        [np.zeros(FILTERS, f32) for _ in WIDTHS], rng.normal(0, h**-0.5, (h, n)).astype(f32), np.zeros(n, f32),
    )
    weights = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    groups = [np.flatnonzero(y == k) for k in range(n)]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(groups[k]) for k in rng.integers(0, n, BATCH)])
        xb, yb = x[pick], y[pick]
        p, kept, hidden = _forward(net, xb)
        d = p.copy()
        d[np.arange(BATCH), yb] -= 1
        d /= BATCH
        g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
        back = d @ net.out.T
        for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            at, best = kept[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS] * (best > 0)
            # Only the place that won the pooling has a gradient.
            places = at[:, :, None] + np.arange(w)
            chars = xb[np.arange(BATCH)[:, None, None], places]
            seen = net.embed[chars].reshape(BATCH, FILTERS, w * EMBEDDING)
            g_filters.append(np.einsum("bf,bfk->kf", g, seen).astype(f32))
            g_bias.append(g.sum(0))
            np.add.at(g_embed, chars, (g[:, :, None] * f.T[None]).reshape(BATCH, FILTERS, w, EMBEDDING))
        grads = [g_embed, *g_filters, *g_bias, hidden.T @ d, d.sum(0)]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """A net with its filters as tables over byte pairs."""

    def __init__(self, net: Net):
        self.net = net
        self.tables = []
        for w, f in zip(WIDTHS, net.filters, strict=True):
            one = [net.embed @ f[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(w)]
            pairs = [(i, (one[i][:, None, :] + one[i + 1][None, :, :]).reshape(65536, FILTERS)) for i in range(0, w - 1, 2)]
            self.tables.append((pairs, (w - 1, one[w - 1]) if w % 2 else None))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(x), len(self.net.langs)), np.float32)
        for lo in range(0, len(x), CHUNK):
            part = x[lo : lo + CHUNK]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, (pairs, odd), b in zip(WIDTHS, self.tables, self.net.bias, strict=True):
                n = WINDOW - w + 1
                y = None
                for i, table in pairs:
                    got = table.take(pair[:, i : i + n], axis=0)
                    y = got if y is None else np.add(y, got, out=y)
                if odd:
                    y += odd[1].take(part[:, odd[0] : odd[0] + n], axis=0)
                pooled.append(np.maximum(y.max(1) + b, 0))
            z = np.concatenate(pooled, 1) @ self.net.out + self.net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + len(part)] = z / z.sum(1, keepdims=True)
        return out


#: Letters by lead byte: ASCII letters and every byte beyond ASCII.
_LETTERS = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def predict(reader: Reader, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each whole text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    langs = reader.net.langs
    todo = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
    rows, owner, size = [], [], 0
    sums = np.zeros((len(texts), len(langs)))

    def flush() -> None:
        x = np.concatenate(rows)
        weight = _LETTERS[x].sum(1) + 1e-3
        np.add.at(sums, np.repeat([o for o, _ in owner], [k for _, k in owner]), reader(x) * weight[:, None])
        rows.clear()
        owner.clear()

    for i in todo:
        w = windows_of(texts[i].encode())
        # A long text goes through in parts.
        for lo in range(0, len(w), 4 * CHUNK):
            part = w[lo : lo + 4 * CHUNK]
            rows.append(part)
            owner.append((i, len(part)))
            size += len(part)
            if size >= 4 * CHUNK:
                flush()
                size = 0
    if rows:
        flush()
    for i in todo:
        p = sums[i] / sums[i].sum()
        k = int(p.argmax())
        out[i] = (langs[k], float(min(1.0, p[k])))
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE) -> Net:
    """``docs`` (doc_id, text, lang): what may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    ids = few_of_each(known, "lang", "doc_id", sample_rows, "langid")
    # So many rows of each language at most, so they may be sent to all.
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, data = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = windows_of(text.encode())
                take = w[np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))]
                for row in take[_LETTERS[take].sum(1) > 0]:
                    langs.append(lang)
                    data.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], names=["lang", "window"])

    rows = durable(sample.mapInArrow(run, "lang string, window binary")).orderBy("lang", "window").collect()
    langs = sorted({r.lang for r in rows})
    x = np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([langs.index(r.lang) for r in rows], np.int64)
    return fit(x, y, langs) if langs else Net([], np.zeros((256, EMBEDDING), np.float32), [np.zeros((w * EMBEDDING, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros((FILTERS * len(WIDTHS), 0), np.float32), np.zeros(0, np.float32))


_OUT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_OUT_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, net: Net, text: str = "text", name: str = "__lang") -> DataFrame:
    """The documents' columns and, under a name that must be free, language and probability."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _OUT)])
    names, i = schema.names, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in slices(batches, text):
            rows = [{"lang": a, "score": b} for a, b in predict(reader, batch.column(i).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _OUT_ARROW)], names=names)

    return docs.mapInArrow(run, schema)


#: Documents with this remainder are held out.
FOLDS, HELD_OUT = 4, 2


def digest(docs: DataFrame) -> DataFrame:
    away = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    net = train(docs.where(~away).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", away.alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))

"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are the letter runs of a text, whatever stands between them; in scripts
written without spaces each letter is one. A word without letters (words end at
any white space) is a token without a score of its own.

Training: tokens and their stems (prefixes of ``STEMS`` letters) are
counted in toxic and other documents of a labelled sample of at most
``SAMPLE`` documents of each label. A token's score is its log-odds ratio with
a Dirichlet prior in proportion to its overall count, less a drift that makes
the expected score negative. A token takes the score of its most significant
form, token or stem.

Scoring: over the whole text, all maximal scoring segments are found in one
pass. A segment's score follows an extreme-value law: ``lambda`` solves
sum(p * exp(lambda * s)) = 1 over other documents, K is fitted to their best
segments. The E-values of the significant segments give one figure for the
text, turned into a probability by a logistic fit on the sample.

Null and empty texts have no segment and get the lowest score. Rows are scored
one by one, so ties, repeated rows and null ids need no rule; extra columns
pass through. Without labels of both kinds every score is the share of toxic
labels (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import few_of_each, ranges, slices, small_batches, text_of
from jointframe.session import durable

#: Labelled documents of each label used for training, and forms kept in the model.
SAMPLE = 4000
FORMS = 50_000
STEMS = (4, 5, 6)
#: Prior weight in tokens, least count of a form, drift per token, and the E-value up to which a segment is significant.
PRIOR = 2000.0
LEAST = 5
DRIFT = 1.0
SIGNIFICANT = 0.5
#: Thai to Myanmar, Khmer, kana and Han.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?=[^\W\d_])[{_ALONE}]|[^\W\d_{_ALONE}]+")


def forms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


def parts_of(token: str) -> list[str]:
    return _WORD.findall(token.lower())


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, which of them stands at each place, and each text's first place with the total at the end. A word without letters is the empty token."""
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    at = split.offsets.to_numpy()
    numbers: dict[str, int] = {}
    tokens: list[int] = []
    ends = [0]
    for word in words.dictionary.to_pylist():
        if word:
            tokens.extend([numbers.setdefault(x, len(numbers)) for x in parts_of(word) or [""]])
        ends.append(len(tokens))
    which, bounds = words.indices.to_numpy(zero_copy_only=False), np.array(ends, np.int64)
    n = np.diff(bounds)[which]
    first = np.concatenate([[0], np.cumsum(n)])[at - at[0]]
    return list(numbers), np.array(tokens, np.int64)[ranges(bounds[which], n)], first


@dataclass(frozen=True)
class Model:
    scores: dict[str, tuple[float, float]]
    lam: float
    k: float
    slope: float
    intercept: float
    share: float


def _counts(sample: DataFrame) -> DataFrame:
    """(form, toxic, other): token counts. Tasks send one row per form, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, which, first = tokens_of(text_of(batch))
            toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(first))
            n = np.bincount(which, minlength=len(tokens))
            t = np.bincount(which[toxic == 1], minlength=len(tokens))
            total: Counter = Counter()
            bad: Counter = Counter()
            for token, a, b in zip(tokens, n.tolist(), t.tolist(), strict=True):
                for form in forms(token) if token else ():
                    total[form] += a
                    bad[form] += b
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[x] for x in keys], pa.int64()), pa.array([total[x] - bad[x] for x in keys], pa.int64())], names=["form", "toxic", "other"])

    return sample.select("text", "toxic").mapInArrow(run, "form string, toxic long, other long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def segments(at: list[int], score: list[float], total: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last place), given the places of positive scores, those scores and the running sum of all scores before each."""
    found: list[list[float]] = []  # left sum, right sum, first, last
    for p, s, left in zip(at, score, total, strict=True):
        new = [left, left + s, p, p]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(b - a, int(c), int(d)) for a, b, c, d in found]


def _token_scores(model: Model, tokens: list[str]) -> np.ndarray:
    get, out = model.scores.get, np.full(len(tokens), -DRIFT)
    for i, token in enumerate(tokens):
        best, z = 0.0, 0.0
        for form in forms(token):
            if (x := get(form)) and abs(x[1]) > z:
                best, z = x[0], abs(x[1])
        out[i] = best - DRIFT
    return out


def passages(model: Model, texts: pa.Array) -> list[list[tuple[float, int, int, float]]]:
    """For each text its maximal segments (score, first, last token, E-value)."""
    tokens, which, first = tokens_of(texts)
    s = _token_scores(model, tokens)[which]
    before = np.concatenate([[0.0], np.cumsum(s)])
    places = np.flatnonzero(s > 0)
    bounds = np.searchsorted(places, first)
    out = []
    for d in range(len(first) - 1):
        mine = places[bounds[d] : bounds[d + 1]]
        got = segments((mine - first[d]).tolist(), s[mine].tolist(), (before[mine] - before[first[d]]).tolist()) if len(mine) else []
        n = max(1, int(first[d + 1] - first[d]))
        out.append([(x, a, b, float(model.k * n * np.exp(-model.lam * x))) for x, a, b in got])
    return out


def figure(found: list[tuple[float, int, int, float]]) -> float:
    """Of a text: minus the logarithm of the best E-value, with what further significant segments add."""
    logs = sorted((-np.log10(max(e, 1e-300)) for *_, e in found), reverse=True)
    if not logs:
        return -5.0
    return float(np.clip(logs[0] + sum(x for x in logs[1:] if x > -np.log10(SIGNIFICANT)), -5.0, 60.0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic): what may be learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = few_of_each(known, "toxic", "doc_id", sample_rows, "toxicity")
    # At most two times sample_rows ids, so they may be sent to all.
    sample = durable(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({}, 1.0, 1.0, 0.0, 0.0, share)
    counts = durable(_counts(sample))
    sums = counts.where(~F.col("form").endswith("~")).agg(F.sum("toxic"), F.sum("other")).first()
    nt, nn = float(sums[0] or 1), float(sums[1] or 1)
    t, o = F.col("toxic"), F.col("other")
    prior = (t + o) / (nt + nn) * PRIOR
    delta = F.log((t + prior) / (nt + PRIOR - t - prior)) - F.log((o + prior) / (nn + PRIOR - o - prior))
    z = delta / F.sqrt(1 / (t + prior) + 1 / (o + prior))
    top = counts.where(t + o >= LEAST).select("form", delta.alias("delta"), z.alias("z")).where(F.abs("z") > 1.5).orderBy(F.desc(F.abs("z")), "form").limit(FORMS)
    model = Model({r.form: (r.delta, r.z) for r in top.collect()}, 1.0, 1.0, 0.0, 0.0, share)
    # Background law: the scores of tokens in the other documents, then their best segments.
    other = sample.where("toxic = 0")
    spread = _map(other, model, "value double, n long", _spread).groupBy("value").agg(F.sum("n").alias("n")).collect()  # LEVELS bounds it
    model = replace(model, lam=_lambda(np.array([r.value for r in spread]), np.array([float(r.n) for r in spread])))
    best = _map(other, model, "best double, n long", _best).where("best > 0").collect()
    # log K from the mean of the best segments: the law's mean is (log(K n) + Euler's constant) / lambda.
    k = float(np.exp(np.mean([model.lam * r.best - np.log(r.n) - np.euler_gamma for r in best] or [0.0])))
    model = replace(model, k=max(k, 1e-12))
    rows = _map(sample, model, "figure double, toxic int", _figures).collect()
    slope, intercept = _logistic(np.array([r.figure for r in rows]), np.array([float(r.toxic) for r in rows]))
    return replace(model, slope=slope, intercept=intercept)


#: Scores are rounded to one part in LEVELS of the largest when their distribution is taken.
LEVELS = 2000


def _map(sample: DataFrame, model: Model, schema: str, function) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield function(shared.value, batch)

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, schema)


def _spread(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens, which, _ = tokens_of(text_of(batch))
    s = _token_scores(model, tokens)[which]
    top = max((abs(x) for x, _ in model.scores.values()), default=1.0) + DRIFT
    values, n = np.unique(np.round(s / top * LEVELS) * top / LEVELS, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(n, pa.int64())], names=["value", "n"])


def _best(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_of(batch)
    n = np.diff(tokens_of(texts)[2])
    return pa.RecordBatch.from_arrays([pa.array([max((x for x, *_ in p), default=0.0) for p in passages(model, texts)], pa.float64()), pa.array(np.maximum(n, 1), pa.int64())], names=["best", "n"])


def _figures(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([figure(p) for p in passages(model, text_of(batch))], pa.float64()), batch.column(1)], names=["figure", "toxic"])


def _lambda(values: np.ndarray, n: np.ndarray) -> float:
    """The positive root of mean(exp(lambda * s)) = 1; a mean score that is not negative has none, then 1."""
    if not len(values) or (values * n).sum() >= 0 or values.max() <= 0:
        return 1.0
    p = n / n.sum()
    lo, hi = 1e-6, 1.0
    while (p * np.exp(hi * values)).sum() < 1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a little shrinkage, both labels weighing the same."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a, b, mean, sd = 0.0, 0.0, x.mean(), x.std() or 1.0
    u = (x - mean) / sd
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = np.array([((p - y) * w * u).sum() + 1e-3 * a, ((p - y) * w).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a / sd), float(b - a * mean / sd)


_OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())])))])
_OUT_ARROW = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])))])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "__toxic") -> DataFrame:
    """The documents' columns and, under a name that must be free, score and the significant passages (first and last token, score, E-value)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # FORMS bounds it
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _OUT)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            found = passages(m, text_of(batch, text))
            rows = [
                {"score": float(1 / (1 + np.exp(-np.clip(m.slope * figure(p) + m.intercept, -30, 30)))) if m.scores else m.share,
                 "passages": [{"first": a, "last": b, "score": x, "e_value": e} for x, a, b, e in p if e <= SIGNIFICANT]}
                for p in found
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _OUT_ARROW)], names=names)

    return docs.mapInArrow(run, schema)


#: Labels of documents with this remainder are held out.
FOLDS, HELD_OUT = 5, 0


def held_out(folds: int, value: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == value, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    away = held_out(FOLDS, HELD_OUT)
    model = train(docs.where(~away), labels.where(~away))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", away.alias("held_out"), F.col("__toxic.score").alias("score"), (F.col("__toxic.score") >= 0.5).cast("int").alias("predicted"), F.size("__toxic.passages").alias("n_passages"))

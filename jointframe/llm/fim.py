"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut at two of its code points into prefix, middle and suffix, which
are written behind sentinels in the order of its form: ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle). Some texts stay ``plain``. Cuts
and forms are drawn from the sha256 of the seed and the document's id, so they
depend neither on partitions nor on retries.

Texts are cut as UTF-8 bytes. ``ByteIndex`` records only the characters of
several bytes: their position and the excess bytes up to them. Code points turn
into bytes, and bytes into code points, by one binary search there plus
addition; text of ASCII alone has an empty index.

Null texts count as empty and give an empty plain output. A null id draws like
an empty one, so rows without id share their draws, as repeated rows do. Rows
are handled one by one, so ties do not matter and an empty table gives an empty
one. A text is cut as a whole, however long; a task holds a few megabytes of
text, or a single longer text. Extra columns pass through; columns of the input
with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jointframe.llm.common import bytes_of, slices, small_batches, text_of, unused

#: What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rearranged, and of these in the form ``spm``.
FIM_PCT, SPM_PCT = 90, 20
SEED = 1
RESULTS = (T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()))


@dataclass(frozen=True)
class ByteIndex:
    """The multibyte characters of a run of UTF-8 bytes: their place in code points and in bytes, and the excess bytes before each."""

    points: np.ndarray
    places: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> ByteIndex:
        places = np.flatnonzero(raw >= 0xC0)
        lead = raw[places]
        excess = np.zeros(len(places) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=excess[1:])
        return cls(places - excess[:-1], places, excess)

    def to_places(self, points: np.ndarray) -> np.ndarray:
        """The bytes at which code points start."""
        return points + self.excess[np.searchsorted(self.points, points)]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """The code points that start at bytes."""
        return places - self.excess[np.searchsorted(self.places, places)]


def _marked(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a sentinel."""
    open_ = np.flatnonzero(raw[:-2] == ord("<"))
    hit = open_[(raw[open_ + 2] == ord(">")) & np.isin(raw[open_ + 1], np.frombuffer(b"PSM", np.uint8))]
    doc = np.searchsorted(at, hit, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[doc[hit + 2 < at[doc + 1]]] = True
    return out


def _draws(seed: int, idents: list) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    digests = b"".join(sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in idents)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def rearrange(texts: pa.Array, idents: list, seed: int = SEED, fim_pct: int = FIM_PCT, spm_pct: int = SPM_PCT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(code points, form: 0 plain, 1 psm, 2 spm, prefix's and middle's code points, output) of texts without nulls."""
    raw, at = bytes_of(texts)
    index = ByteIndex.of(raw)
    first = index.to_points(at)
    n = np.diff(first)
    h = _draws(seed, idents)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | _marked(raw, at) | (h[:, 2] % 100 >= fim_pct)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_pct, 2, 1))
    ends = index.to_places(first[:-1, None] + cuts)
    whole, p, s, m = memoryview(raw), *(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for kind, start, a, b, stop in zip(form.tolist(), at[:-1].tolist(), *ends.T.tolist(), at[1:].tolist(), strict=True):
        prefix, middle, suffix = whole[start:a], whole[a:b], whole[b:stop]
        out.append(bytes(whole[start:stop]) if not kind else b"".join((p, prefix, s, suffix, m, middle) if kind == 1 else (s, suffix, p, prefix, m, middle)))
    return n, form, cuts[:, 0], cuts[:, 1] - cuts[:, 0], out


def transform(docs: DataFrame, text: str = "text", ident: str = "doc_id", seed: int = SEED, fim_pct: int = FIM_PCT, spm_pct: int = SPM_PCT) -> DataFrame:
    """The rows with ``n`` (code points), ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    small_batches(docs.sparkSession)
    names = [f.name for f in RESULTS]
    kept = [c for c in docs.columns if c.lower() not in names]
    read, of = unused([*kept, *names], "__text", "__of")
    reads = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(read), F.col(f"`{ident}`").cast("string").alias(of))
    schema = T.StructType([*[docs.schema[c] for c in kept], *RESULTS])
    forms = ["plain", "psm", "spm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, read):
            n, form, prefix, middle, out = rearrange(text_of(b, read), b.column(len(kept) + 1).to_pylist(), seed, fim_pct, spm_pct)
            plain = form == 0
            own = [pa.array(n), pa.array(forms).take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *own], [*kept, *names])

    return reads.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a sentinel stays plain, so each sentinel stands in an output once."""
    of = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm, spm = (F.concat(*[of[i] for i in order]) for order in ((0, 2, 1), (1, 2, 0)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the cuts, and digests of the output and of the text rebuilt from it."""
    out = transform(docs.select("doc_id", "text"))
    hashed = [F.sha2(x, 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


_H = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, {_H} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS x, substr(text, a + 1, b - a) AS y, substr(text, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

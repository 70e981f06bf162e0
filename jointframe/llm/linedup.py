"""Line dedup by site-relative frequency, in built-in functions only.

A page is a row; its site is given by a column. A line's frequency on a site is
the number of the site's pages that hold it, over the site's pages. Lines above
the boilerplate ratio, on at least ``min_pages`` pages, are dropped wherever
they stand on that site. Lines without a word (blank ones) always stay, as do
all lines of rows without a site or text; a text of which nothing stays becomes
empty. Decisions depend on (site, line) only, so ties, repeated rows and null
ids need no rule. Columns of the input keep their names and values, but for the
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.llm.common import columns_of, unused

RATIO_PCT = 10
MIN_PAGES = 5
_WORD = r"[^\x20\x09-\x0D]"


def _digest(line: Column) -> Column:
    """128 bits of a line, in two numbers."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line digest) of the lines to drop, with page counts.

    Counts are combined on the map side, so a site or line that holds a third
    of all rows sends one row per task.
    """
    pages = docs.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text")).where("site is not null and text is not null")
    lines = pages.select("site", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)), _digest))).alias("line"))
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = docs.select(F.col(f"`{site}`").alias("site")).where("site is not null").groupBy("site").agg(F.count("*").alias("pages"))
    return counts.join(totals, "site").where(F.col("n") * 100 > F.col("pages") * ratio_pct)


def mark_lines(docs: DataFrame, text: str = "text", site: str = "source", ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> tuple[DataFrame, str]:
    """The input's columns and a struct of (lines, kept), arrays of all and of the remaining lines; and the struct's name.

    What to drop is worked out once per distinct (site, text) and joined by a
    digest of the text, so lines travel as digests, texts once.
    """
    at, own_text, own_key, s, k, drop_, out = unused(docs.columns, "__site", "__text", "__key", "__s", "__k", "__drop", "__lines")
    own = docs.select("*", F.col(f"`{site}`").alias(at), F.col(f"`{text}`").alias(own_text), F.md5(F.col(f"`{text}`").cast("binary")).alias(own_key))
    bad = boilerplate(docs, text, site, ratio_pct, min_pages).select("site", "line")
    lines = own.where(F.col(at).isNotNull() & F.col(own_text).isNotNull()).select(
        F.col(at).alias("site"), F.col(own_key).alias("key"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split(own_text, "\n"), lambda x: x.rlike(_WORD)), _digest))).alias("line"),
    )
    drop = lines.join(bad, ["site", "line"]).groupBy("site", "key").agg(F.collect_set("line").alias(drop_))
    drop = drop.select(F.col("site").alias(s), F.col("key").alias(k), drop_)
    joined = own.join(drop, (F.col(at) == F.col(s)) & (F.col(own_key) == F.col(k)), "left")
    all_lines = F.split(own_text, "\n")
    kept = F.when(F.col(drop_).isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~(x.rlike(_WORD) & F.array_contains(F.col(drop_), _digest(x)))))
    return joined.select(*columns_of(docs), F.struct(all_lines.alias("lines"), kept.alias("kept")).alias(out)), out


def drop_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", ratio_pct: int = RATIO_PCT, min_pages: int = MIN_PAGES) -> DataFrame:
    """The input with boilerplate lines taken out of the text."""
    marked, out = mark_lines(docs, text, site, ratio_pct, min_pages)
    return marked.select(*[F.array_join(f"{out}.kept", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: lines, dropped lines and the digest of what stays."""
    marked, out = mark_lines(docs)
    n = F.coalesce(F.size(f"{out}.lines"), F.lit(0))
    return marked.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n - F.size(f"{out}.kept")).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.array_join(f"{out}.kept", "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT rid, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t WHERE text IS NOT NULL),
p AS (SELECT source, count(*) AS pages FROM t GROUP BY source),
c AS (SELECT source, line, count(DISTINCT rid) AS n FROM x WHERE source IS NOT NULL AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
b AS (SELECT c.source, line FROM c JOIN p USING (source) WHERE n >= {MIN_PAGES} AND n * 100 > pages * {RATIO_PCT}),
k AS (SELECT rid, string_agg(x.line, chr(10) ORDER BY i) AS kept, count(*) AS n
      FROM x LEFT JOIN b ON x.source = b.source AND x.line = b.line WHERE b.line IS NULL GROUP BY rid)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(k.n, 0))::BIGINT AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (rid)"""

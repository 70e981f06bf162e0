"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule is a predicate over metrics of a text. On a bounded sample every rule
is run once: its time over a plain scan is its cost, the share it rejects its
selectivity. Rules then run in order of rejection per cost. The order changes
the work, never the verdict, since a text is kept only if no rule rejects it.

Null and empty texts have no words and fail ``few_words``. Rows are judged one
by one: ties, repeated rows, null ids and extra columns pass through. Columns
of the input that have the name of a metric or verdict are replaced in
``judge`` and left alone in ``cascade``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.llm.common import unused
from jointframe.session import durable

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: With more repeated windows than this, positions are found by sorting instead of by looking each window up. Both are exact.
LOOKUPS = 16
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a function that returns the column of a metric."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Callable[[str], Column]], Column]


#: What every kept text must pass, then the rules that the method adds.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (2 * m("word_chars") < 5 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, and only if this expression is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words covered by three-word windows that the text has twice or more."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def looked_up(h: Column, twice: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def by_sorting(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        kept = let(pairs, lambda p: F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def of(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        # Only texts with many repeats pay for sorting pairs of hash and place.
        some = let(twice, lambda t: covered_of(F.when(F.size(t) > LOOKUPS, by_sorting(h)).otherwise(looked_up(h, t))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    def covered_of(places: Column) -> Column:
        return let(places, covered)

    return let(windows, of)


def metric(name: str, text: Column, words: Column) -> Column:
    """A metric of a text (not null) and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    if name == "n_words":
        return F.size(words).cast("long")
    if name == "word_chars":
        return F.length(F.array_join(words, "")).cast("long")
    if name == "n_symbols":
        return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")
    if name == "n_lines":
        return F.size(lines).cast("long")
    if name == "n_dup_lines":
        return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    if name == "n_repeat_words":
        return _repeated(words)
    raise ValueError(f"no metric {name}")


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All metrics as columns beside the input's."""
    own, words = unused([*docs.columns, *METRICS], "__text", "__words")
    df = docs.withColumn(own, _text(text)).withColumn(words, _words(F.col(own)))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in METRICS], *[metric(n, F.col(own), F.col(words)).alias(n) for n in METRICS])


def fails(rule: Rule, metric_: Callable[[str], Column] = F.col) -> Column:
    return F.coalesce(rule.fails(metric_), F.lit(False))


def passes(rules: Sequence[Rule], text: Column) -> Column:
    """True if no rule rejects. Rules are asked in order, and a metric is computed only if a rule that needs it is."""

    def of(words: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for rule in rules:
            out = out.when(fails(rule, lambda n: metric(n, text, words)), F.lit(False))
        return out.otherwise(F.lit(True))

    return let(_words(text), of)


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per second, measured on a sample of about ``sample_rows`` rows."""
    total = docs.select(F.lit(1)).count()
    if not total:
        return list(rules)
    sample = durable(docs.select(_text(text).alias("text")).sample(min(1.0, sample_rows / total), seed=7))

    def cost(asked: Sequence[Rule]) -> tuple[float, int]:
        counted = sample.agg(F.count_if(passes(asked, F.col("text"))), F.count("*"))
        # The first run of a plan pays for compiling it; the second is counted.
        counted.first()
        began = time.perf_counter()
        kept, n = counted.first()
        return time.perf_counter() - began, n - kept

    idle, _ = cost(())
    gain = {}
    for rule in rules:
        took, hit = cost((rule,))
        gain[rule.name] = hit / max(took - idle, 1e-3)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows that no rule rejects."""
    return docs.where(passes(rules, _text(text)))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows with their metrics, ``base_failed`` and ``kept``."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in order_rules(docs, rules, text):
        verdict = verdict.when(fails(rule), F.lit(False))
    base = fails(BASE_RULES[0]) | fails(BASE_RULES[1])
    return with_metrics(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict.otherwise(F.lit(True)))


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, words[i:i+2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM d, range(3) AS o(k) GROUP BY rid),
m AS (
  SELECT t.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM t JOIN l USING (rid) LEFT JOIN r ON r.rid = t.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
       AND 2 * word_chars >= 5 * n_words AND word_chars <= 15 * n_words AS kept
FROM b"""

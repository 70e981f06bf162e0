"""URL filters: prefix rules first, link-graph propagation for what they leave open. Built-in functions only.

Hosts are the nodes, links between different hosts the edges, weighted by
count. Pages that a rule allows make their host a trusted seed, pages that a
rule blocks a distrusted one, by page count. Trust is a personalised PageRank
along the links, distrust one against them: who links to the blocked is
distrusted. Mass at hosts without links goes back to the seeds. A host is
blocked if its distrust is above ``weight`` times its trust; hosts that neither
reaches are allowed.

Null urls and urls without ``://`` have an empty host and path; no rule fits
them and they are allowed. Null html has no links. Rows are judged one by one,
so repeated rows and null ids pass through; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jointframe.session import durable

#: (verdict, host, path). The longest rule that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds stop when no more than this mass moves; the geometric bound gives the most rounds it can take.
TOLERANCE = 1e-6
WEIGHT = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, its verdict), null where none fits."""
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = text.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from a host to another; counted on the map side before the shuffle."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (node, rank) of ``seeds`` (node, seed; sums to 1) over ``edges`` (src, dst, n).

    Contributions are summed on the map side, so a node that a third of all
    links lead to is no hot key. Each round is a written table. Rounds move at
    most ``damping`` times the mass of the round before, which bounds them.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    parts = durable(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("part")))
    seeds = durable(seeds)
    has_out = durable(parts.select(F.col("src").alias("node")).distinct())
    rank, moved = seeds.select("node", F.col("seed").alias("rank")), 1.0
    while moved > tolerance:
        loose = rank.join(has_out, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        home = seeds.crossJoin(F.broadcast(loose)).select("node", (F.col("seed") * (1 - damping + damping * F.col("loose"))).alias("rank"))
        sent = rank.join(parts, rank["node"] == parts["src"]).select(F.col("dst").alias("node"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        new = durable(home.unionByName(sent).groupBy("node").agg(F.sum("rank").alias("rank")))
        change = new.select("node", "rank").unionByName(rank.select("node", (-F.col("rank")).alias("rank"))).groupBy("node").agg(F.abs(F.sum("rank")).alias("d"))
        moved = change.agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]
        rank = new
    return rank


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, weight: float = WEIGHT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of each row of ``pages`` (page_id, url, html)."""
    p = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, kind = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": text, "kind": kind})
    edges = durable(host_edges(p))
    votes = durable(p.groupBy("host").agg(F.count_if(F.col("kind") == "allow").alias("good"), F.count_if(F.col("kind") == "block").alias("bad")))
    total = votes.agg(F.sum("good"), F.sum("bad")).first()

    def seeds(name: str, of: int) -> DataFrame:
        return votes.where(F.col(name) > 0).select(F.col("host").alias("node"), (F.col(name) / F.lit(float(of or 1))).alias("seed"))

    trust = propagate(edges, seeds("good", total[0]), damping, tolerance).select(F.col("node").alias("host"), F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds("bad", total[1]), damping, tolerance).select(F.col("node").alias("host"), F.col("rank").alias("distrust"))
    hosts = trust.join(distrust, "host", "full").fillna(0.0, ["trust", "distrust"])
    blocked = F.coalesce(F.col("distrust") > weight * F.col("trust"), F.lit(False))
    verdict = F.coalesce("kind", F.when(blocked, "block").otherwise("allow"))
    return p.drop("html").join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")

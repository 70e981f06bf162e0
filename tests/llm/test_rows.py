"""Quality rules, line dedup and URL filters against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from conftest import CLASHES, odd_rows  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from jointframe.llm import linedup, quality, urlgraph

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    kept = not base and 10 * m["n_symbols"] <= m["n_words"] and 2 * m["n_dup_lines"] <= m["n_lines"] and 5 * m["n_words"] <= 2 * m["word_chars"] <= 30 * m["n_words"]
    return {**m, "base_failed": base, "kept": kept}


def test_quality_matches_plain_python(spark, odd_docs):
    rows = [*odd_rows(), (20, "a b c a b c a " * 40, "en", "a", 1), (21, " ".join(f"w{i % 37}" for i in range(400)), "en", "a", 1), (22, "x y", None, None, None)]
    got = quality.judge(spark.createDataFrame(rows, odd_docs.schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: r[k] for k in plain_metrics("")} == plain_metrics(r.text), r.doc_id


def test_quality_cascade_keeps_rows_and_any_order_gives_the_same(clashing_docs, no_docs):
    kept = sorted(str(r.doc_id) for r in quality.cascade(clashing_docs, quality.RULES).collect())
    back = quality.cascade(clashing_docs, quality.RULES[::-1])
    assert back.columns == clashing_docs.columns
    assert sorted(str(r.doc_id) for r in back.collect()) == kept == sorted(str(d) for d, t, *_ in odd_rows() if plain_metrics(t)["kept"])
    assert quality.cascade(no_docs, quality.order_rules(no_docs)).count() == 0
    assert {r.name for r in quality.order_rules(clashing_docs)} == {r.name for r in quality.RULES}


def plain_lines(rows, ratio, least):
    pages, counts = Counter(), Counter()
    for _, t, _, site, _ in rows:
        if site is not None:
            pages[site] += 1
            counts.update((site, x) for x in {y for y in (t or "").split("\n") if WORD.search(y)})
    drop = {k for k, n in counts.items() if n >= least and 100 * n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (site, x) not in drop) for _, t, _, site, _ in rows]


def test_line_dedup_matches_plain_python(spark, clashing_docs, odd_docs, no_docs):
    rows = odd_rows() + [(100 + i, f"Menu\nunique {i}\n\nMenu\nFooter {i % 3}", "en", "hot", 1) for i in range(60)] + [(200, "Menu\nmine", "en", None, 1), (201, "Menu", "en", "hot", 1)]
    df = spark.createDataFrame(rows, odd_docs.schema)
    got = linedup.drop_boilerplate(df, ratio_pct=20, min_pages=3)
    want = plain_lines(rows, 20, 3)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], w) for r, w in zip(rows, want, strict=True))
    assert "\n".join(["unique 7", "", "Footer 1"]) not in want and "unique 7\n" in want[len(odd_rows()) + 7]
    clash = linedup.drop_boilerplate(clashing_docs)
    assert clash.columns == clashing_docs.columns and clash.count() == clashing_docs.count()
    assert all(r[c] == f"own {c}" for r in clash.collect() for c in CLASHES)
    assert linedup.drop_boilerplate(no_docs).count() == 0
    digest = {r.doc_id: r for r in linedup.digest(df).where("doc_id is not null").collect()}
    assert (digest[3].n_lines, digest[3].n_dropped, digest[3].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())


def plain_rank(edges, seeds, damping):
    nodes = {n for e in edges for n in e[:2]} | set(seeds)
    out = Counter()
    for s, _, n in edges:
        out[s] += n
    rank = dict.fromkeys(nodes, 0.0) | seeds
    for _ in range(300):
        loose = sum(r for n, r in rank.items() if not out[n])
        new = {n: seeds.get(n, 0.0) * (1 - damping + damping * loose) for n in nodes}
        for s, d, n in edges:
            new[d] += damping * rank[s] * n / out[s]
        rank = new
    return rank


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1), ("e", "a", 5), ("f", "e", 1), ("b", "g", 3)]
    seeds = {"a": 0.75, "f": 0.25}
    got = urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "node string, seed double"), tolerance=1e-9)
    want = plain_rank(edges, seeds, urlgraph.DAMPING)
    have = {r.node: r["rank"] for r in got.collect()}
    assert all(have.get(n, 0.0) == pytest.approx(want[n], abs=1e-6) for n in want)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["org", "com", "example.org", "a.example.org", "myexample.org", "x.com"]), st.sampled_from(["/", "/es/", "/en/1", "/en/12/x", "/fr/", "/de/a", "", "/ES/"]))
def test_longest_rule_is_unique(host, path):
    fit = [r for r in urlgraph.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    assert len({len(h + p) for _, h, p in fit}) == len(fit)


def test_url_filters(spark):
    link = '<a href="{}">x</a>'
    pages = [
        (1, "http://Example.ORG/es/1?q#f", None), (2, "https://a.example.org/en/1", ""), (3, "http://b.org/x", link.format("http://good.net/p")),
        (4, "http://x.com/de/", "<a HREF = 'https://nothing.net/?a'>"), (5, "http://bad.net/q", link.format("http://x.com/en/")), (6, "http://good.net", ""), (7, "http://x.com/en/", None),
        (8, None, link.format("http://b.org")), (9, "no scheme", None), (None, "http://b.org/x", None), (3, "http://b.org/x", None), (10, "ftp://lone.net?x=://y", None),
    ]
    got = urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    want = [
        (1, "example.org", "/es/1", "example.org/es/", "block"), (2, "a.example.org", "/en/1", "example.org/en/1", "block"), (3, "b.org", "/x", "org/", "allow"), (3, "b.org", "/x", "org/", "allow"),
        (4, "x.com", "/de/", "com/de/", "block"), (5, "bad.net", "/q", None, "block"), (6, "good.net", "", None, "allow"), (7, "x.com", "/en/", None, "block"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (None, "b.org", "/x", "org/", "allow"), (10, "lone.net", "", None, "allow"),
    ]
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter(want)
    assert urlgraph.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_links_without_a_scheme_are_edges(spark):
    html = '<a href="//Other.org/x">x</a> <a href=//third.org>y</a> <a href="/in//page">z</a> <a href="https://other.org/y">w</a>'
    got = urlgraph.host_edges(spark.createDataFrame([("own.org", html)], "host string, html string")).collect()
    assert {(r.src, r.dst): r.n for r in got} == {("own.org", "other.org"): 2, ("own.org", "third.org"): 1}

"""Fill-in-middle, lattice near-dedup and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import CLASHES, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from jointframe.llm import fim, lattice, resample

TEXTS = st.lists(st.sampled_from(["a", "Ab c", "é", "漢字", "🙂", "<P>", "<", "S>", "<S", "M>", "\x00", "\n", "ß", "x" * 70, " ", "12", "_"]), max_size=12).map("".join)


def plain_fim(ident, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6) | st.none(), TEXTS), min_size=1, max_size=6))
def test_rearranged_texts(rows):
    n, form, prefix, middle, out = fim.rearrange(pa.array([t for _, t in rows], pa.string()), [i if i is None else str(i) for i, _ in rows])
    for i, (ident, text) in enumerate(rows):
        want = plain_fim(ident, text)
        kind = ["plain", "psm", "spm"][form[i]]
        assert (n[i], kind, out[i].decode()) == (want[0], want[1], want[4])
        assert kind == "plain" or (prefix[i], middle[i]) == want[2:4]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_byte_index_both_ways(text):
    index = fim.ByteIndex.of(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:i].encode()) for i in points])
    assert (index.to_places(points) == places).all() and (index.to_points(places) == points).all()
    assert len(index.points) == sum(ord(c) > 127 for c in text)


def test_fill_in_middle_over_odd_rows(spark, clashing_docs, odd_docs, no_docs):
    extra = odd_docs.unionByName(spark.createDataFrame([(50 + i, t, None, None, None) for i, t in enumerate(["a <S> b", "< P>", "🙂é" * 50, "<P"])], odd_docs.schema))
    got = fim.transform(extra).withColumn("back", fim.restored(*[fim.F.col(c) for c in ("output", "form")])).collect()
    assert len(got) == extra.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    clash = fim.transform(clashing_docs.withColumn("Form", fim.F.lit("own")).withColumn("__text", fim.F.lit(None).cast("string")))
    assert all(r["hash"] == "own hash" and r.form in ("plain", "psm", "spm") and r["__text"] is None for r in clash.collect())
    assert fim.transform(no_docs).count() == fim.digest(no_docs).count() == 0


def brute_links(rows, threshold=lattice.THRESHOLD):
    """(n_links, component) of each (id, vector, label)."""
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    near = [set() for _ in rows]
    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and lab == rows[j][2] and len(v) == len(rows[j][1]):
                a, b = np.array(v, float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return out


def ball(rng, n, dim, spread):
    centre = rng.normal(size=dim)
    return [(centre + spread * rng.normal(size=dim)).tolist() for _ in range(n)]


VECTORS = "vec_id long, embedding array<float>, label int"


def f32(v):
    return [float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(3)
    found = []
    for k, spread in enumerate((0.02, 0.06, 0.1, 0.14, 0.14)):
        found += [(v, k % 2) for v in ball(rng, 40, 24, spread)]
    # Chains whose ends are far apart, and strangers.
    step = rng.normal(size=(2, 24))
    found += [((math.cos(a) * step[0] / np.linalg.norm(step[0]) + math.sin(a) * step[1] / np.linalg.norm(step[1])).tolist(), 1) for a in np.arange(0, 3, 0.15)]
    found += [(rng.normal(size=24).tolist(), int(k % 3)) for k in range(100)]
    found += [(found[0][0], 0)] * 30 + [(found[0][0], 1), (found[0][0], None)]
    found = [(f32(v), lab) for v, lab in found]
    odd = [(None, 0), ([], 0), ([0.0] * 24, 0), ([float("nan")] + [1.0] * 23, 0), ([float("inf")] * 24, 0), ([None] + [1.0] * 23, 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([-0.0, 1.0], 0), ([0.0, 3.0], 0), ([1e30] * 24, 2), ([3e-30] * 24, 2)]
    found += [(None if v is None else v, lab) for v, lab in odd]
    order = rng.permutation(len(found))
    rows = [(int(i), f32(v) if v and None not in v else v, lab) for i, (v, lab) in zip(order, found, strict=True)]
    return [*rows, rows[0], (None, rows[0][1], rows[0][2]), (None, f32(rng.normal(size=24)), 0)]


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    near = lattice.decode(x)
    assert (near.sum(axis=1) % 2 == 0).all() and (((2 * near) % 2 == (2 * near[:, :1]) % 2)).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    gap = ((x - near) ** 2).sum(axis=1)
    assert (gap[:, None] <= ((x[:, None] - near[:, None] - lattice.ROOTS) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("part,meetings", [(lattice.PART, lattice.MEETINGS), (16, 1)])
def test_near_copies_match_brute_force(spark, vector_rows, monkeypatch, part, meetings):
    monkeypatch.setattr(lattice, "PART", part)
    monkeypatch.setattr(lattice, "MEETINGS", meetings)
    monkeypatch.setattr(lattice, "TILE", 16 if part == 16 else lattice.TILE)
    got = lattice.near_copies(spark.createDataFrame(vector_rows, VECTORS)).collect()
    want = brute_links(vector_rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_blocks_grow_and_recall_holds(spark):
    assert lattice.shape_of(0)[0] == lattice.shape_of(5000)[0] == 1 < lattice.shape_of(100_000)[0] < lattice.shape_of(10**9)[0]
    rng = np.random.default_rng(9)
    for blocks in (1, 2, 3):
        tables = math.ceil(math.log(lattice.MISS) / math.log(1 - lattice.meeting_chance(0.98, blocks)))
        x, y = rng.normal(size=(2, 4000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        codes = lattice.Codes(64, blocks, tables)
        (hx, px), (hy, py) = codes(lattice.in_steps(x)), codes(lattice.in_steps(y))
        assert ((hx == hy) | (hx == py) | (px == hy)).any(axis=0).mean() > 0.998
        again = codes(lattice.in_steps(x[5:6]))
        assert (again[0][:, 0] == hx[:, 5]).all() and (again[1][:, 0] == px[:, 5]).all()


def test_keep_one_vector(spark, vector_rows):
    df = spark.createDataFrame(vector_rows, VECTORS).withColumn("__cls", lattice.F.lit("own")).withColumn("n_links", lattice.F.lit(7))
    kept = lattice.keep_one(df)
    want = [r[0] for r, (_, n, least) in zip(vector_rows, brute_links(vector_rows), strict=True) if n == 0 or (r[0] is not None and r[0] == least)]
    assert kept.columns == df.columns and Counter(r.vec_id for r in kept.collect()) == Counter(want)
    none = spark.createDataFrame([], VECTORS)
    assert lattice.near_copies(none).count() == lattice.keep_one(none).count() == 0
    alone = spark.createDataFrame([(1, None, 3), (None, [1.0], None)], VECTORS)
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_copies(alone).collect()) == Counter([(1, 0, 1, True), (None, 0, None, False)])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % resample.BUCKETS for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_feature_buckets(texts):
    n, single, pairs, paired = resample.features(pa.array(texts, pa.string()))
    assert Counter([*single.tolist(), *pairs.tolist()]) == Counter(b for t in texts for b in plain_features(t)[1])
    assert n.tolist() == [plain_features(t)[0] for t in texts] and paired.sum() == len(pairs)


def plain_draw(rows, items, share=25):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(plain_features(r[1])[1])
    for x in items:
        t.update(plain_features(x)[1])
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)}
    out = []
    for r in rows:
        n, f = plain_features(r[1])
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("margin", [resample.MARGIN, 1e-9, 2.0])
def test_draw_matches_plain_python(spark, odd_docs, monkeypatch, margin):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(resample, "MARGIN", margin)
    vocab = [f"w{i}" for i in range(60)] + ["Übung", "漢字", "x" * 90, "it's"]
    rows = [*odd_rows(), *[(1000 + int(i) % 300, " ".join(rng.choice(vocab, rng.integers(1, 60))), "en", "a", 1) for i in range(400)]]
    rows += [(77, rows[5][1], "en", "a", 1)] * 40
    items = [" ".join(rng.choice(vocab[:20], 40)), "", None]
    docs = spark.createDataFrame(rows, odd_docs.schema)
    target = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    got = Counter(tuple(r) for r in resample.digest(docs, target).collect())
    assert got == Counter(plain_draw(rows, items))


def test_resampled_documents(spark, clashing_docs, no_docs, odd_docs):
    target = spark.createDataFrame([("a", "the the the")], "item_id string, text string")
    kept = resample.resample(clashing_docs, target, share_pct=50)
    drawn = {r[0] for r in plain_draw(odd_rows(), ["the the the"], 50) if r[4]}
    want = Counter(r[0] for r in odd_rows() if r[0] in drawn)  # the cut falls between two equal rows; both stay
    assert kept.columns == clashing_docs.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHES)
    assert resample.resample(no_docs, target).count() == resample.digest(no_docs, target).count() == 0
    empty = spark.createDataFrame([], "item_id string, text string")
    assert Counter(tuple(r) for r in resample.digest(odd_docs, empty).collect()) == Counter(plain_draw(odd_rows(), []))
    assert all(r["rank"] is None for r in resample.digest(odd_docs.where("doc_id = 9"), target).collect())

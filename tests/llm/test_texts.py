"""Operators with Python kernels against brute force, round trips and held-out accuracy."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import CLASHES, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_rows import plain_lines, plain_metrics

import corpus_pipeline
from jointframe.llm import decontam, langid, linedup, packing, simhash, suffix, tokenbin, toxicity
from jointframe.llm.common import bytes_of
from jointframe.llm.tokens import WordEncoder, encoder, vocabulary_path
from jointframe.session import durable

SF = "/root/testdata/sf0.001"
FORMS = ["the", "The", "don't", "x.", "Ñandú,", "été", "l'été", "a\nb", "12.5", "<|endoftext|>", "🙂", "İx", "é", "...", "", "漢字", " ", "a b", "\x1c", "'s", "ß", "C++", "é"]


def plain_ids(text):
    return encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FORMS), max_size=12).map(" ".join), min_size=1, max_size=4))
def test_word_encoding_is_the_librarys(texts):
    ids, bounds = encoder(vocabulary_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain_ids(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.sampled_from([1, 7, 64]), st.integers(1, 40))
def test_token_blocks_round_trip(ids, block, kinds):
    ids = np.array([i % kinds if i % 3 else i for i in ids], np.uint32)
    blocks = tokenbin.encode_blocks(ids, block)
    assert len(blocks) == -(-len(ids) // block)
    assert (tokenbin.decode_blocks(blocks) == ids).all()
    # Blocks do not depend on each other.
    assert all((tokenbin.decode_blocks([b]) == ids[i * block : (i + 1) * block]).all() for i, b in enumerate(blocks[:3]))


def test_damaged_blocks_are_noticed():
    block = tokenbin.encode_blocks(np.arange(500, dtype=np.uint32))[0]
    for i in (0, 5, 9, 13, 17, 40, len(block) - 1):
        bad = bytearray(block)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            tokenbin.decode_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        tokenbin.decode_blocks([block[:-2]])


def test_token_files(spark, odd_docs, no_docs):
    got = tokenbin.round_trip(odd_docs).orderBy("start").collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "" if r[0] is not None else r[1]))
    start = 0
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        ids = [*plain_ids(text), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.round_trip(no_docs).count() == 0


def test_nnls_finds_a_known_solution():
    rng = np.random.default_rng(1)
    a = rng.random((30, 80))
    x = np.zeros(80)
    x[[3, 17, 40]] = 5.0, 2.0, 9.0
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(0, 400), max_size=60))
def test_plan_uses_every_piece_once(histogram):
    plan = packing.plan(histogram, 100, 20)
    assert all(sum(lengths) <= 100 and n > 0 for lengths, n in plan)
    used = Counter()
    for lengths, n in plan:
        for k in lengths:
            used[k] += n
    assert used == Counter({k: v for k, v in histogram.items() if v})
    total = sum(k * v for k, v in histogram.items())
    # Best fit never leaves two sequences that are both at most half full.
    assert sum(n for _, n in plan) <= 2 * -(-total // 100) + 1


def test_packing(spark, odd_docs, no_docs):
    got = packing.pack_documents(odd_docs).collect()
    want = Counter()
    for doc_id, text, *_ in odd_rows():
        ids = [*plain_ids(text), 1]
        for p in range(-(-len(ids) // 4096)):
            piece = ids[p * 4096 : (p + 1) * 4096]
            want[doc_id, p, p * 4096, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(no_docs).count() == 0


def plain_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([5, 60, 300]), st.sampled_from([2, 5, 9]))
def test_group_stars_connect_what_all_pairs_connect(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = sorted({rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(spread))) & (2**64 - 1) for _ in range(n)})
    u, v = simhash.group_stars(np.array(codes, np.uint64))
    root = list(range(len(codes)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        root[a] = b
    want = plain_components(codes)
    assert len({(root[i], want[i]) for i in range(len(codes))}) == len(set(root)) == len(set(want))


def test_choices_cover_every_radius():
    for total in (10, 10**6, 10**9, 10**12):
        n, chosen = simhash.choices(total)
        assert all(any(not set(c) & set(bad) for c in chosen) for bad in [(0, 1, 2, 3), tuple(range(n))[-4:], (0, n // 2, n - 2, n - 1)])


def plain_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies():
    rng = random.Random(7)
    base = [words(300, s) for s in range(4)]
    return odd_rows() + [(100 + i, " ".join(w if rng.random() > 0.01 else "zz" for w in base[i % 4].split()), "en", "a", 1) for i in range(40)]


def test_simhash_components(spark, odd_docs):
    rows = near_copies()
    prints = [plain_print(t) for _, t, *_ in rows]
    roots = plain_components(prints)
    least = {}
    for (doc_id, *_), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    got = simhash.digest(spark.createDataFrame(rows, odd_docs.schema)).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, f"{p:016x}", least.get(r)) for (d, *_), p, r in zip(rows, prints, roots, strict=True))


def test_groups_dealt_out_in_parts_link_the_same(spark):
    prints = sorted({plain_print(t) for _, t, *_ in near_copies()})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), part=2).distinct().collect()
    at = {p: i for i, (p,) in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in links:
        a, b = find(at[u]), find(at[v])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


def test_one_row_of_each_group_stays(clashing_docs, no_docs):
    kept = simhash.keep_one(clashing_docs)
    rows = kept.collect()
    assert kept.columns == clashing_docs.columns and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    prints = [plain_print(t) for _, t, *_ in odd_rows()]
    assert len(rows) == len(set(plain_components(prints)))
    assert Counter(r.doc_id for r in rows)[1] == 1 and Counter(r.doc_id for r in rows)[2] == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_ties_of_a_group_do_not_depend_on_the_order(spark):
    text = words(200, 5)
    rows = [(1, text + " end", "b"), (1, text, "b"), (1, text, "a"), (None, text, "c"), (2, text, "d"), (None, "other words here", "e"), (None, "other words here", "d")]
    want = min((hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(json.dumps({"doc_id": i, "text": t, "__row": r}, separators=(",", ":")).encode()).hexdigest(), r) for i, t, r in rows[:3])[-1]
    seen = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, __row string").repartition(3)
        got = {r.doc_id: (r.text, r["__row"]) for r in simhash.keep_one(df).collect()}
        assert set(got) == {1, None} and got[1][1] == want
        seen.append(got)
    assert seen[0] == seen[1]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("group", [20_000, 0])
def test_suffix_dedup(spark, odd_docs, monkeypatch, group):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab c") for _ in range(200)) for _ in range(5)]
    rows = [(i // 2 if i < 20 else i, "".join(rng.choice(base)[rng.randrange(100) :][: rng.randrange(20, 100)] for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(103, "a" * 300), (104, "b" + "a" * 120), (105, "xy" * 90), (106, "é" * 60), (107, "zé" * 50 + "xy" * 40), (108, base[0] * 3), (108, base[0] * 3), (109, base[0] * 3)]
    rows += [(d, t) for d, t, *_ in odd_rows()]
    whole = suffix.spans
    monkeypatch.setattr(suffix, "spans", lambda docs: whole(docs, group=group))
    got = suffix.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(suffix.brute_force(rows), key=key)


@pytest.mark.parametrize("gathered", [1, 5_000])
@pytest.mark.parametrize("group", [20_000, 12, 0])
def test_suffix_sorting_passes_crowded_triggers_on(monkeypatch, group, gathered):
    monkeypatch.setattr(suffix, "GATHERED", gathered)
    rng = random.Random(5)
    lines = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(3)]
    rows = sorted((k, rng.choice(lines)[rng.randrange(9) :][: rng.randrange(suffix.SPAN, 71)], rng.randrange(9)) for k in range(6) for _ in range(1 + 5 * k))
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["key", "phrase", "doc_id"])
    got = [r for b in suffix._sort_suffixes(group)(iter([batch.slice(i, 4) for i in range(0, len(rows), 4)])) for r in b.to_pylist()]
    per = Counter(k for k, *_ in rows)
    assert sorted((r["phrase"], r["doc_id"]) for r in got if r["phrase"] is not None) == sorted((p, d) for k, p, d in rows if per[k] > group)
    runs = {}
    for key in (k for k in per if per[k] <= group):
        own = [(p, d) for k, p, d in rows if k == key]
        for phrase in {p for p, _ in own}:
            first = [min(d for p, d in own if phrase[i : i + suffix.SPAN] in p) for i in range(len(phrase) - suffix.SPAN + 1)]
            if any(f < d for p, d in own if p == phrase for f in first):
                runs.setdefault(tuple(suffix._digests(np.frombuffer(phrase, np.uint8), np.array([0]), np.array([len(phrase)]))[0].tolist()), []).append(first)
    told = {}
    for r in got:
        if r["runs"] is not None:
            assert r["runs"][0]["lo"] == 0 and all(x["hi"] == y["lo"] for x, y in zip(r["runs"], r["runs"][1:], strict=False))
            told.setdefault((r["a"], r["b"]), []).append([x["first"] for x in r["runs"] for _ in range(x["hi"] - x["lo"])])
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in runs.items()}


def test_phrases_are_the_same_in_pieces(monkeypatch):
    texts = pa.array(["abcd" * 40, "", "x" * 300, "short", "the quick brown fox jumps over the lazy dog " * 9, ""])
    raw, bounds = bytes_of(texts)
    whole = suffix.phrases(raw, bounds)
    assert len(whole[0]) > 20
    for cached in (1, 200, 500):
        monkeypatch.setattr(suffix, "CACHED", cached)
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(whole, suffix.phrases(raw, bounds), strict=True))
    assert all(len(x) == 0 for x in suffix.phrases(raw[:0], bounds[:1]))


def test_suffix_dedup_shuffles_phrases_once(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "the same passage of more than fifty bytes, in two texts " * 2) for i in range(4)], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    found, _ = suffix.spans(docs)
    # From the written runs on, phrases are only told by their places.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow _dictionary") == 1 and "_sort_suffixes" not in plan
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3]


def test_buckets_of_a_document_meet_the_copies_as_one_row(spark):
    met = spark.createDataFrame([(d, d, bytes([b])) for d in range(3) for b in range(9)], "doc_id long, hash long, keys binary")
    got = suffix._asked(met, spark.createDataFrame([(1, 1), (2, 7)], "doc_id long, hash long"))
    assert sorted((r.doc_id, r.hash, sorted(map(bytes, r["keys"]))) for r in got.collect()) == [(d, d, [bytes([b]) for b in range(9)]) for d in (0, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join LeftOuter") < plan.index("Aggregate [doc_id")


def test_shuffles_behind_a_written_table_end(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = {*disk.getAllBlocks().mkString("\n").split("\n")}
    table = durable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), ended=True)
    after = {*disk.getAllBlocks().mkString("\n").split("\n")}
    assert not {x for x in after - before if x.startswith("shuffle")}
    assert table.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix.digest(no_docs.select("doc_id", "text")).count() == 0


def test_decontamination(spark, clashing_docs, no_docs):
    items = [("7", words(80, 1)[100:400]), ("10", "one"), ("x", words(30, 9)), ("y", None), ("z", "..."), (None, words(80, 1)), ("7", words(80, 1)[50:200]), ("w", "ÄB Äb äB C " * 5)]
    rows = [*odd_rows(), (30, "Äb ÄB ÄB, C äb " * 9, "en", "a", 1), (31, words(500, 8) + " ONE " + words(20, 9) + " " + words(500, 10), "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id string, text string")
    plain = decontam.brute_force([(d, t) for d, t, *_ in rows if len(t or "") < 50_000], items)
    for most in (decontam.BLOCK_WORDS, 20):
        found = decontam.find_matches(df.select("doc_id", "text"), bench, block_words=most)
        got = decontam.verdicts(found).where("text is null or length(text) < 50000").drop("text")
        assert Counter(tuple(r) for r in got.collect()) == Counter(plain)
    match = next(m for r in decontam.find_matches(df, bench).where("doc_id = 1").collect() for m in r["__found"].matches if m.item_id == "7")
    assert decontam.words_of(rows[0][1])[match.doc_start : match.doc_start + match.length] in [decontam.words_of(t)[match.item_start : match.item_start + match.length] for n, t in items if n == "7"]
    kept = decontam.remove_contaminated(clashing_docs, bench)
    assert kept.columns == clashing_docs.columns and 9 not in [r.doc_id for r in kept.collect()]
    assert decontam.remove_contaminated(no_docs, bench).count() == 0
    assert decontam.remove_contaminated(clashing_docs, bench.limit(0)).count() == clashing_docs.count()


def plain_segments(scores):
    """Maximal scoring segments by their definition: the best one, then the same left and right of it."""

    def best(lo, hi):
        top = max(((sum(scores[a:b]), a - b, -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if top[0] <= 0:
            return []
        a, b = -top[2], top[3]
        return best(lo, a) + [(top[0], a, b - 1)] + best(b, hi)

    return best(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_maximal(scores):
    places = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.segments(places, [scores[i] for i in places], [sum(scores[:i]) for i in places])
    want = plain_segments(scores)
    assert sorted(s for s, *_ in got) == sorted(s for s, *_ in want)
    assert all(sum(scores[a : b + 1]) == s for s, a, b in got)


def test_lambda_solves_its_equation():
    values, n = np.array([-1.0, 2.0, 3.5]), np.array([900.0, 40.0, 3.0])
    lam = toxicity._lambda(values, n)
    assert (n / n.sum() * np.exp(lam * values)).sum() == pytest.approx(1.0, abs=1e-9) and lam > 0


@pytest.mark.parametrize("sep", ["\n", "\t", "\u00a0", "/", ",", "\r\n", "  ", "\u3000", "_", "7"])
def test_toxic_words_count_in_any_layout(sep):
    model = toxicity.Model({"bad": (3.0, 9.0), "坏": (3.0, 9.0)}, 1.0, 1.0, 1.0, 0.0, 0.5)
    plain, other, alone = toxicity.passages(model, pa.array(["so bad bad bad bad ok", sep.join(["so", *["bad"] * 4, "ok"]), "啊坏坏坏坏啊"]))
    assert [x[:3] for x in plain] == [(8.0, 1, 4)]
    assert other == plain == alone


def test_toxicity_tokens():
    tokens, which, first = toxicity.tokens_of(pa.array(["A,b\tc", "", " \n", "1 +x", "don't ไทย a"]))
    assert [[tokens[i] for i in which[a:b]] for a, b in zip(first, first[1:], strict=False)] == [["a", "b", "c"], [], [], ["", "x"], ["don", "t", "ไ", "ท", "ย", "a"]]


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(1)
    docs = [(i, words(rng.randrange(5, 120), i) + (" vileword gruesomely vileword" if i % 6 == 0 else "")) for i in range(600)]
    docs += [(1000 + d if d else None, t) for d, t, *_ in odd_rows()]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(600)] + [(None, 1, 1), (3, None, None), (1003, 1, 1)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.digest(df, lab).collect()
    assert len(got) == len(docs)
    away = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in away) >= 0.97 * len(away)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.digest(no_docs.select("doc_id", "text"), lab).count() == 0
    assert {r.score for r in toxicity.digest(df, lab.limit(0)).collect()} == {0.0}


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd_docs.selectExpr("doc_id + 100000 as doc_id", "text", "lang"))
    got = langid.digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("doc_id < 100000").collect()
    away = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in away) >= 0.9 * len(away)
    odd = {r.doc_id: r for r in langid.digest(docs).where("doc_id > 100000").collect()}
    assert all((odd[100000 + i].lang_pred, odd[100000 + i].score) == ("und", 0.0) for i in (3, 4, 7))
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.digest(no_docs.select("doc_id", "text", "lang")).count() == 0
    assert {r.lang_pred for r in langid.digest(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 5, 189, 190, 191, 192, 193, 1000])
def test_language_windows_hold_every_filter_place(n):
    data = bytes(i % 251 + 1 for i in range(n))
    w = langid.windows_of(data)
    for width in langid.WIDTHS:
        places = {bytes(row[i : i + width]) for row in w for i in range(langid.WINDOW - width + 1)}
        assert all(data[i : i + width] in places for i in range(n - width + 1))


def test_language_tables_equal_the_network():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    net = langid.fit(x, rng.integers(0, 3, 40), ["a", "b", "c"])
    assert np.allclose(langid.Reader(net)(x), langid._forward(net, x)[0], atol=1e-4)


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows = odd_rows() + [(100 + i, f"Menu of the site\n{words(60 + i, i)}", "en", "hot", 1) for i in range(40)]
    rows += [(200, rows[20][1].replace("Menu", "menu") + " z", "en", "b", 1), (201, words(40, 50) + " " + words(30, 51), "en", "b", 1)]
    items = [(1, " ".join(words(40, 50).split()[5:25])), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if plain_metrics(r[1])["kept"]]
    texts = plain_lines(kept, linedup.RATIO_PCT, linedup.MIN_PAGES)
    kept = [(r[0], t) for r, t in zip(kept, texts, strict=True)]
    roots = plain_components([plain_print(t) for _, t in kept])
    groups = {}
    for (d, t), r in zip(kept, roots, strict=True):
        groups.setdefault(r, []).append((d is None, d or 0, d, t))
    kept = [min(g)[2:] for g in groups.values()]
    dirty = {r[0] for r in decontam.brute_force([(d, t) for d, t in kept if len(t) < 50_000], [(str(n), t) for n, t in items]) if r[-1]}
    kept = [(d, t) for d, t in kept if d not in dirty]
    assert 201 in dirty and any(d == 100 for d, _ in kept)
    want = Counter()
    for d, t in kept:
        ids = [*plain_ids(t), 1]
        want.update((d, p, zlib.crc32(np.array(ids[p * 4096 : (p + 1) * 4096], "<u4").tobytes())) for p in range(-(-len(ids) // 4096)))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want


def test_stages_keep_columns_and_bear_odd_input(spark, clashing_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing_docs, SF)
        assert out.columns == clashing_docs.columns, name
        assert out.count() <= clashing_docs.count()
        assert stage(spark, no_docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, clashing_docs, SF).count() > 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("½²①٣Ⅷ_ 1a\n-漢é🙂ª"), max_size=8))
def test_letters_are_told_from_numbers(text):
    assert langid.has_letter(text) == any(c.isalpha() for c in text)


def test_words_of_letters_and_marks_are_cut_side_by_side():
    enc = WordEncoder(vocabulary_path())
    texts = ["Hello, World.\nÑandú! The END", "", "\n\n", "ß ÿ... \u0130stanbul \u212a, e\u0301 a,b it's 42!", "the\nthe the?!"]
    asked, word = [], enc.word
    enc.word = lambda w: asked.append(w) or word(w)
    ids, at = enc.encode(pa.array(texts))
    assert [tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == enc.plain(texts)
    assert set(asked) <= {"", "\u0130stanbul", "\u212a,", "e\u0301", "a,b", "it's", "42!"}


def test_blocks_are_coded_in_even_runs():
    assert tokenbin._runs(0) == [] and tokenbin._runs(4_290) == [(0, 4_290)]
    assert tokenbin._runs(2 * tokenbin.LANES + 1) == [(0, 3_413), (3_413, 6_827), (6_827, 10_241)]
    ids = np.random.default_rng(4).integers(0, 300, 3 * 16 + 5).astype(np.uint32)
    assert (tokenbin.decode_blocks(tokenbin.encode_blocks(ids, 16)) == ids).all()


def test_words_are_put_together_side_by_side():
    enc = WordEncoder(vocabulary_path())
    words = ["the", "The,", "ñandú", "a,b", "", "İx", "the", "...", "<|endoftext|>", "END!?"]
    for _ in range(2):  # new words, then known ones
        flat, sizes = enc.lookup(pa.array(words))
        assert np.split(flat, np.cumsum(sizes)[:-1])[0].tolist() == plain_ids("the")
        assert [tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])] == enc.plain(words)
    flat, sizes = enc.lookup(pa.array([], pa.string()))
    assert len(flat) == len(sizes) == 0


@pytest.mark.parametrize("width", [1, 2, 7, 1024, 70_000])
def test_ids_are_numbered_as_they_appear(width):
    ids = np.random.default_rng(width).choice(np.array([0, 1, 2, 40_000, 65_535], np.int32), (3, width))
    got = tokenbin._first_seen(ids, np.full(3, width))
    for row, numbers in zip(ids.tolist(), got.tolist(), strict=True):
        seen = {}
        assert numbers == [seen.setdefault(x, len(seen)) for x in row]

"""Streams replayed from several files."""

import datetime as dt

import pytest

from jointframe.streaming import jobs as st
from jointframe.streaming.tables import KeyedTable

SCHEMA = "event_id bigint, scene bigint, task string, ts timestamp, event string"
T0 = dt.datetime(2024, 1, 1)


def row(i, minute, event, scene=1, task="coarse"):
    return (i, scene, task, T0 + dt.timedelta(minutes=minute), event)


@pytest.fixture
def feed(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: st.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, per_trigger=1)
    return put, stream, str(tmp_path)


def test_new_files_once(feed):
    put, stream, folder = feed
    put("a", [row(1, 0, "submitted"), row(2, 5, "finished")])
    assert st.run_to_table(stream(), f"{folder}/w").count() == 2
    put("b", [row(3, 9, "submitted")])
    assert sorted(r.event_id for r in st.run_to_table(stream(), f"{folder}/w").collect()) == [1, 2, 3]


def test_latest_state_equals_batch(spark, feed):
    put, stream, folder = feed
    put("a", [row(1, 0, "submitted"), row(2, 5, "failed"), row(3, 1, "submitted", 2)])
    put("b", [row(4, 9, "finished"), row(5, 2, "running", 2)])
    live = st.latest_states_stream(stream(), f"{folder}/w", buckets=3)
    batch = st.latest_states(spark.read.schema(SCHEMA).parquet(f"{folder}/in"))
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in batch.collect()}


def test_late_rows_leave_closed_windows(feed):
    put, stream, folder = feed
    put("a", [row(1, 0, "finished"), row(2, 3, "finished")])
    put("b", [row(3, 60, "finished")])
    put("c", [row(6, 61, "finished")])
    put("d", [row(4, 1, "finished"), row(5, 61, "finished")])
    out = {r.start: r.n for r in st.run_to_table(st.throughput(stream(), "10 minutes"), f"{folder}/w").collect()}
    assert out[T0] == 2


def test_crash_reported_once(feed):
    put, stream, folder = feed
    put("a", [row(1, 0, "failed"), row(2, 1, "failed")])
    put("b", [row(3, 500, "failed"), row(4, 501, "failed", 2)])
    assert sorted((r.scene, r.task, r.batch) for r in st.first_crashes(stream(), f"{folder}/w").collect()) == [(1, "coarse", 0), (2, "coarse", 1)]
    put("c", [row(5, 900, "failed", 2), row(6, 901, "failed", 3)])
    assert sorted((r.scene, r.batch) for r in st.first_crashes(stream(), f"{folder}/w").collect()) == [(1, 0), (2, 1), (3, 2)]


def table(spark, folder, **more):
    return KeyedTable(spark, str(folder), "k bigint, v string", ["k"], **more)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_keyed_table_repeats_and_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=4, most=3)
    assert rows_of(t.read()) == [] and t.pointer() == (-1, {})
    first = spark.createDataFrame([(i, "a") for i in range(20)], "k bigint, v string")
    t.append(0, first)
    t.append(0, first)  # the same batch again
    assert rows_of(t.read()) == [(i, "a") for i in range(20)]
    for n in range(1, 8):
        t.append(n, spark.createDataFrame([(100 + n, "b")], "k bigint, v string"))
    assert len(rows_of(t.read())) == 27 and max(len(v) for v in t.pointer()[1].values()) <= 3
    hit = t.touched(spark.createDataFrame([(3, "")], "k bigint, v string"))
    kept = t.read(hit).where("k <> 3")
    assert len(hit) == 1 and 0 < kept.count() < 26
    t.replace(8, hit, kept)
    assert 3 not in {k for k, _ in rows_of(t.read())} and len(rows_of(t.read())) == 26
    named = {v for vs in t.pointer()[1].values() for v in vs}
    assert len(t._versions("pointer")) == 2 and named <= set(t._versions("data"))


def test_unfinished_version_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=2)
    t.append(0, spark.createDataFrame([(1, "a")], "k bigint, v string"))
    t._write(1, spark.createDataFrame([(2, "lost")], "k bigint, v string"))  # broken off before the pointer
    assert rows_of(t.read()) == [(1, "a")]
    t.append(1, spark.createDataFrame([(2, "b")], "k bigint, v string"))
    assert rows_of(t.read()) == [(1, "a"), (2, "b")]


def test_scenes_that_are_over_leave_the_live_table(spark, feed, tmp_path):
    put, stream, folder = feed
    board = st.SceneBoard(spark, f"{folder}/w", CHAIN, buckets=4)
    done = lambda s, m: [row(s * 10 + i, m + i, "finished", s, task) for i, task in enumerate(("coarse", "fine", "render"))]
    put("a", [r for s in range(50) for r in done(s, 0)] + [row(600, 0, "submitted", 99)])
    board.run(stream())
    assert board.live.read().count() == 1 and board.over.read().count() == 50
    put("b", [row(700 + s, 50, "failed", s) for s in range(50)] + [row(800, 60, "failed", 99), row(801, 61, "failed", 98, "fine")])
    board.run(stream())
    lists = {r.scene: (r.outcome, r.poll) for r in board.seed_lists().collect()}
    assert lists == {**{s: ("done", 0) for s in range(50)}, 99: ("crashed", 1)}
    assert [r.scene for r in board.live.read().collect()] == [98]
    snap = {r.scene: (r.reached, r.all_done) for r in board.snapshot().collect()}
    assert snap[98] == ("coarse", None) and snap[99] == ("coarse", "crashed") and len(snap) == 52
    board.write_lists(f"{folder}/lists")
    assert [r.value for r in spark.read.text(f"{folder}/lists/crashed_seeds").collect()] == ["99"]


def test_poll_broken_off_between_the_tables(spark, tmp_path):
    board = st.SceneBoard(spark, str(tmp_path / "w"), CHAIN, buckets=2)
    events = spark.createDataFrame([row(1, 0, "failed"), row(2, 0, "running", 2)], SCHEMA)
    replace, board.live.replace = board.live.replace, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        board.poll(events, 0)
    board.live.replace = replace
    board.poll(events, 0)
    assert [r.scene for r in board.live.read().collect()] == [2] and [(r.scene, r.outcome) for r in board.seed_lists().collect()] == [(1, "crashed")]


def test_late_finish_over_batches(feed):
    put, stream, folder = feed
    put("a", [row(1, 0, "failed"), row(2, 0, "failed", 2), row(3, 5, "submitted", 3)])
    put("b", [row(4, 30, "finished"), row(5, 90, "finished", 2)])
    got = {r.scene: r.state for r in st.corrected_states(stream(), f"{folder}/w", 3600).collect()}
    assert got == {1: "succeeded", 2: "crashed", 3: "open"}


CHAIN = [("coarse", "prev_succeeded"), ("fine", "prev_succeeded"), ("finecpu", "prev_failed"), ("render", "prev_redundant")]


@pytest.mark.parametrize("events,reached,fatal,finished,crashed", [
    ([("coarse", "running")], "coarse", False, False, False),
    ([("coarse", "failed")], "coarse", True, False, True),
    ([("coarse", "finished"), ("fine", "failed")], "render", False, False, False),
    ([("coarse", "finished"), ("fine", "failed"), ("finecpu", "finished"), ("render", "finished")], "render", False, True, False),
    ([("coarse", "finished"), ("fine", "finished"), ("render", "failed")], "render", True, False, True),
])
def test_chain(spark, events, reached, fatal, finished, crashed):
    df = spark.createDataFrame([row(i, i, e, task=t) for i, (t, e) in enumerate(events)], SCHEMA)
    r = st.scene_chain(df, CHAIN).first()
    assert (r.reached, r.fatal, r.finished, r.crashed) == (reached, fatal, finished, crashed)


def test_start_finish_over_bucket_edges(spark):
    df = spark.createDataFrame([row(1, 59, "submitted"), row(2, 61, "finished"), row(3, 200, "finished")], SCHEMA)
    got = st.start_finish(df.where("event = 'submitted'"), df.where("event = 'finished'"), 3600).collect()
    assert [(r.start_id, r.finish_id, r.secs) for r in got] == [(1, 2, 120.0)]

"""Streaming queries: the events table replayed as a stream, and batch twins of the stateful jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointframe import adapters as ad
from jointframe.registry import query
from jointframe.session import Tables
from jointframe.streaming import jobs as st

EV = ad.task_events.sql
STATE = "CASE {e} WHEN 'submitted' THEN 'queued' WHEN 'running' THEN 'running' WHEN 'finished' THEN 'succeeded' WHEN 'failed' THEN 'crashed' ELSE 'not_queued' END"


def stream(t: Tables) -> DataFrame:
    """The events file as a stream of task events."""
    raw = st.file_stream(t.spark, t.directory, t.events.schema, "events.parquet")
    return raw.selectExpr(*[f"{e} AS {n}" for n, e in ad.task_events.columns.items()]).withColumn("ts", F.col("ts").cast("timestamp"))


def run(t: Tables, df: DataFrame) -> DataFrame:
    return st.run_to_table(df, st.work_folder(t.spark))


#: The events again in four polls of eight days; the stream is stopped after each and taken up again for the next.
POLLS = 4
POLL = f"CAST(least({POLLS - 1}, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / (8.0 * 86400000000))) AS BIGINT)"


def polled(t: Tables, step) -> None:
    """Call ``step`` with the stream each time another poll's events have arrived; each poll is one micro-batch."""
    events = ad.task_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    poll_of = F.least(F.lit(POLLS - 1), F.floor((F.unix_micros("ts") - start) / (8.0 * 86400000000)))
    source = st.work_folder(t.spark)
    for poll in range(POLLS):
        events.where(poll_of == poll).write.mode("append").parquet(source)
        step(st.file_stream(t.spark, source, events.schema))


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("T01", f"""
SELECT scene, task, {STATE.format(e="max_by(event, (ts, event_id))")} AS state, epoch_us(max(ts)) AS us FROM {EV} GROUP BY scene, task""")
def latest_state(t: Tables) -> DataFrame:
    return st.latest_states_stream(stream(t), st.work_folder(t.spark)).select("scene", "task", "state", micros("ts").alias("us"))


@query("T01", f"""
SELECT scene, task, {STATE.format(e="max_by(event, (ts, event_id))")} AS state, epoch_us(max(ts)) AS us FROM {EV} GROUP BY scene, task""")
def latest_state_polls(t: Tables) -> DataFrame:
    """The same over several micro-batches and a restart."""
    folder, out = st.work_folder(t.spark), []
    polled(t, lambda events: out.append(st.latest_states_stream(events, folder)))
    return out[-1].select("scene", "task", "state", micros("ts").alias("us"))


_CLOSED = "(SELECT max(ts) - INTERVAL {d} AS wm FROM events)"


def _buckets(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTES, ts, TIMESTAMP '1970-01-01')"


@query("T02", f"""
WITH w AS (SELECT {_buckets(5)} AS s, {STATE.format(e="event")} AS state, task, count(*) AS n FROM {EV} GROUP BY ALL)
SELECT epoch_us(s) AS us, state, task, CAST(n AS BIGINT) AS n FROM w, {_CLOSED.format(d="10 MINUTES")} c WHERE s + INTERVAL 5 MINUTES <= wm""")
def live_state_counts(t: Tables) -> DataFrame:
    """Windows the watermark has closed."""
    return run(t, st.state_counts(stream(t))).select(micros("start").alias("us"), "state", "task", "n")


@query("T03 K08", f"SELECT DISTINCT scene, task FROM {EV} WHERE event = 'failed'")
def crash_once(t: Tables) -> DataFrame:
    return st.first_crashes(stream(t), st.work_folder(t.spark)).drop("batch")


@query("T03", f"SELECT scene, task, min({POLL}) AS batch FROM {EV} WHERE event = 'failed' GROUP BY scene, task")
def crash_once_polls(t: Tables) -> DataFrame:
    """Crashes with the micro-batch that reported them, over several of these and a restart."""
    folder, out = st.work_folder(t.spark), []
    polled(t, lambda events: out.append(st.first_crashes(events, folder)))
    return out[-1]


CHAIN = [("coarse", "prev_succeeded"), ("populate", "prev_succeeded"), ("fine", "prev_redundant"), ("render", "prev_failed")]
_LAST = ", ".join(f"coalesce({STATE.format(e=f'max_by(event, (ts, event_id)) FILTER (task = {chr(39)}{n}{chr(39)})')}, 'not_queued') AS {n}" for n, _ in CHAIN)
_CHAIN_SQL = f"""
l AS (SELECT scene, {_LAST} FROM {EV} GROUP BY scene),
c AS (SELECT scene, CASE WHEN coarse <> 'succeeded' THEN 'coarse' WHEN populate <> 'succeeded' THEN 'populate' WHEN fine = 'crashed' THEN 'render' ELSE 'fine' END AS reached,
  CASE WHEN coarse <> 'succeeded' THEN coarse WHEN populate <> 'succeeded' THEN populate WHEN fine = 'crashed' THEN render ELSE fine END AS state FROM l)"""


STRICT = [(n, "prev_succeeded" if n == "fine" else c) for n, c in CHAIN]


def board(t: Tables) -> st.SceneBoard:
    return st.SceneBoard(t.spark, st.work_folder(t.spark), STRICT)


@query("T04", f"""WITH {_CHAIN_SQL.replace("'prev_redundant'", "''")}
SELECT scene, reached, state, state = 'crashed' AS fatal FROM c""")
def task_chain(t: Tables) -> DataFrame:
    """Coarse, populate and fine in order, render only as the fallback of fine."""
    return board(t).run(stream(t)).snapshot().drop("all_done")


@query("T05", f"""WITH {_CHAIN_SQL}
SELECT scene, CASE WHEN state = 'crashed' THEN 'crashed' ELSE 'done' END AS outcome FROM c WHERE state = 'crashed' OR (reached = 'render' AND state = 'succeeded')""")
def scene_termination(t: Tables) -> DataFrame:
    return board(t).run(stream(t)).seed_lists().drop("poll")


# Every scene at every poll, as far as it has come by then; the first poll at which it is over counts.
_POLL_LAST = _LAST.replace("FILTER (task", "FILTER (e.poll <= p.poll AND task")
_BOARD_SQL = f"""
e AS (SELECT *, {POLL} AS poll FROM {EV}), p AS (SELECT CAST(range AS BIGINT) AS poll FROM range({POLLS})),
l AS (SELECT scene, p.poll, {_POLL_LAST} FROM e, p GROUP BY scene, p.poll HAVING min(e.poll) <= p.poll),
c AS (SELECT scene, poll, {_CHAIN_SQL.partition("SELECT scene, ")[2].partition("SELECT scene, ")[2].rpartition(" FROM l)")[0]} FROM l),
o AS (SELECT *, state = 'crashed' OR (reached = 'render' AND state = 'succeeded') AS ended FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY ended DESC, CASE WHEN ended THEN poll ELSE -poll END) AS i FROM o)"""


@query("K08 T05", f"""WITH {_BOARD_SQL}
SELECT scene, CASE WHEN state = 'crashed' THEN 'crashed' ELSE 'done' END AS outcome, poll FROM n WHERE i = 1 AND ended""")
def seed_lists(t: Tables) -> DataFrame:
    """Finished and crashed seeds with the poll that closed them, over several polls and a restart."""
    scenes = board(t)
    polled(t, scenes.run)
    return scenes.seed_lists()


@query("K08 T04", f"""WITH {_BOARD_SQL}
SELECT scene, reached, state, state = 'crashed' AS fatal, CASE WHEN ended THEN CASE WHEN state = 'crashed' THEN 'crashed' ELSE 'done' END END AS all_done FROM n WHERE i = 1""")
def scene_snapshot(t: Tables) -> DataFrame:
    """The scene table after the last poll; what came after a scene's end does not count."""
    scenes = board(t)
    polled(t, scenes.run)
    return scenes.snapshot()


@query("T06", f"""
WITH w AS (SELECT {_buckets(10)} AS s, count(*) AS n FROM {EV} WHERE event = 'finished' GROUP BY 1)
SELECT epoch_us(s) AS us, CAST(n AS BIGINT) AS n FROM w, (SELECT max(ts) - INTERVAL 10 MINUTES AS wm FROM events WHERE event_type = 'purchase') c WHERE s + INTERVAL 10 MINUTES <= wm""")
def throughput_windows(t: Tables) -> DataFrame:
    return run(t, st.throughput(stream(t), "10 minutes")).select(micros("start").alias("us"), "n")


@query("T06", f"""
WITH w AS (SELECT {_buckets(5)} - k * INTERVAL 5 MINUTES AS s, count(*) AS n FROM {EV}, range(2) r(k) WHERE event = 'finished' GROUP BY 1)
SELECT epoch_us(s) AS us, CAST(n AS BIGINT) AS n FROM w, (SELECT max(ts) - INTERVAL 10 MINUTES AS wm FROM events WHERE event_type = 'purchase') c WHERE s + INTERVAL 10 MINUTES <= wm""")
def throughput_sliding(t: Tables) -> DataFrame:
    return run(t, st.throughput(stream(t), "10 minutes", "5 minutes")).select(micros("start").alias("us"), "n")


_SESS = f"""
p AS (SELECT scene, ts, event_id, lag(ts) OVER (PARTITION BY scene ORDER BY ts, event_id) AS pt FROM {EV}),
q AS (SELECT *, sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) > {{gap}} THEN 1 ELSE 0 END) OVER (PARTITION BY scene ORDER BY ts, event_id) AS session FROM p),
s AS (SELECT scene, session, min(ts) AS a, max(ts) AS b, count(*) AS n FROM q GROUP BY scene, session)"""


@query("T07", f"""WITH {_SESS.format(gap=7200 * 1000000)}
SELECT scene, CAST(session AS BIGINT) AS session, epoch_us(a) AS a_us, epoch_us(b) AS b_us, CAST(n AS BIGINT) AS n FROM s""")
def sessions(t: Tables) -> DataFrame:
    """Batch twin of the session stream."""
    out = st.batch_sessions(ad.task_events(t), 7200)
    return out.select("scene", "session", micros("start").alias("a_us"), micros("last").alias("b_us"), "n")


@query("T07", f"""WITH {_SESS.format(gap=7200 * 1000000 - 1)}
SELECT scene, epoch_us(a) AS a_us, epoch_us(b) + 7200000000 AS b_us, CAST(n AS BIGINT) AS n FROM s, (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events) c WHERE b + INTERVAL 2 HOURS <= wm""")
def session_stream(t: Tables) -> DataFrame:
    out = run(t, st.stream_sessions(stream(t), "2 hours"))
    return out.select("scene", micros("start").alias("a_us"), micros("end").alias("b_us"), "n")


@query("T08", f"""
WITH p AS (SELECT scene, task, max(ts) FILTER (event = 'failed') AS f, max(ts) FILTER (event = 'finished') AS g FROM {EV} GROUP BY scene, task)
SELECT scene, task, CASE WHEN f IS NULL AND g IS NULL THEN 'open' WHEN f IS NULL THEN 'succeeded' WHEN g IS NULL THEN 'crashed'
  WHEN epoch_us(g) - epoch_us(f) BETWEEN 0 AND 86400000000 THEN 'succeeded' ELSE 'crashed' END AS state FROM p""")
def late_completion(t: Tables) -> DataFrame:
    return st.corrected_states(stream(t), st.work_folder(t.spark), 86400)


@query("T08", f"""
WITH e AS (SELECT event_id * 7919 % 1000003 * 1099511627776 + event_id AS arrival, ts FROM {EV}), m AS (SELECT *, max(ts) OVER (ORDER BY arrival) AS newest FROM e)
SELECT arrival, epoch_us(ts) AS us FROM m WHERE epoch_us(newest) - epoch_us(ts) > 25 * 86400000000""")
def late_events(t: Tables) -> DataFrame:
    """Rows far behind the newest one when events arrive in a scattered order."""
    scattered = ad.task_events(t).withColumn("event_id", F.col("event_id") * 7919 % 1000003 * (1 << 40) + F.col("event_id"))
    return st.late_rows(scattered, 25 * 86400).select(F.col("event_id").alias("arrival"), micros("ts").alias("us"))


@query("T09", f"""
WITH w AS (SELECT {_buckets(10)} AS s, count(*) AS n FROM {EV} WHERE event IN ('submitted', 'running') GROUP BY 1),
a AS (SELECT s, n, ceil(least((epoch_us(s) + 600000000 - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 864000.0, 1.0) * 4) AS allowed FROM w)
SELECT epoch_us(s) AS us, CAST(n AS BIGINT) AS n, CAST(allowed AS BIGINT) AS allowed, n > allowed AS over FROM a, (SELECT max(ts) - INTERVAL 10 MINUTES AS wm FROM events WHERE event_type IN ('signup', 'view', 'click')) c WHERE s + INTERVAL 10 MINUTES <= wm""")
def warmup_ramp(t: Tables) -> DataFrame:
    config = t.spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS begin, 864000.0D AS warmup_s, 4 AS most")
    return run(t, st.ramp_alerts(stream(t), config)).select(micros("start").alias("us"), "n", "allowed", "over")


@query("T10 S02", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {EV}")
def incremental_ingestion(t: Tables) -> DataFrame:
    """The stream is taken up twice; the second run must not add rows again."""
    folder = st.work_folder(t.spark)
    st.run_to_table(stream(t), folder)
    return st.run_to_table(stream(t), folder).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("T11", f"""
SELECT s.scene, s.task, s.event_id AS start_id, f.event_id AS finish_id, (epoch_us(f.ts) - epoch_us(s.ts)) / 1e6 AS secs FROM {EV} s JOIN {EV} f
  ON f.scene = s.scene AND f.task = s.task AND f.event = 'finished' AND f.ts >= s.ts AND epoch_us(f.ts) - epoch_us(s.ts) <= 21600000000 WHERE s.event = 'submitted'""")
def start_finish_join(t: Tables) -> DataFrame:
    """Stream–stream join of starts and finishes."""
    return run(t, st.start_finish(stream(t).where("event = 'submitted'"), stream(t).where("event = 'finished'"), 21600))

"""Streams against what the same rows give in a table, with restarts in the middle."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioquery.operators.maintenance import bounded_bursts
from folioquery.plans.deploy import ship
from folioquery.streaming import debounce

START = datetime.datetime(2024, 1, 1)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table({"at": pa.array([a for a, _ in rows], pa.timestamp("us", "UTC")), "key": pa.array([k for _, k in rows], pa.string())}), folder / f"{name}.parquet")


@pytest.mark.parametrize("shuffled", [False, True])
def test_debounced_stream_is_the_table_s_bursts(spark, tmp_path, shuffled):
    """10 quiet seconds, 60 in all, arming anew; stopped and started twice, with changes out of order within the delay."""
    ship(spark)
    draw = random.Random(4)
    rows = sorted((START + datetime.timedelta(milliseconds=draw.randint(0, 900_000)), draw.choice(["a", "a", "a", "a", "b", "c"])) for _ in range(300))
    rows += [(START + datetime.timedelta(seconds=s), "edge") for s in (0, 10, 20, 30, 40, 50, 60, 70, 80, 81, 92)] + [(START, "edge"), (None, "edge")]
    rows.sort(key=lambda r: r[0] or START)
    if shuffled:
        rows.sort(key=lambda r: (r[0] or START) + datetime.timedelta(seconds=draw.randint(0, 25)))

    def run():
        stream = spark.readStream.schema("at timestamp, key string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with debounce.timers(spark):
            debounce.debounced(stream, "key", 10, 60, "30 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    third = len(rows) // 3 + 1
    for k in range(0, len(rows), third):
        put(tmp_path / "in", f"part-{k:04d}", rows[k : k + third])
        run()
    early = spark.read.parquet(str(tmp_path / "out")).count()
    put(tmp_path / "in", "part-9999", [(START + datetime.timedelta(days=1), None)])
    run()
    columns = ["key", "start", "fired", "changes"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    want = sorted(map(tuple, bounded_bursts(spark.createDataFrame(rows, "at timestamp, key string"), "key", 10, 60).select(*columns).collect()))
    assert got == want and 0 < early < len(want)
    assert [(r[1] - START).total_seconds() for r in got if r[0] == "edge"] == [0, 70, 92] and [r[3] for r in got if r[0] == "edge"] == [8, 3, 1]


def test_first_burst():
    assert debounce.first_burst([0], 10, 60) == (1, 10)
    assert debounce.first_burst([0, 10, 21], 10, 60) == (2, 20)
    assert debounce.first_burst([0, 9, 18], 10, 15) == (2, 15)


def test_the_session_s_state_store_is_put_back(spark):
    before = spark.conf.get(debounce.PROVIDER)
    with debounce.timers(spark):
        assert spark.conf.get(debounce.PROVIDER) == debounce.ROCKS
    assert spark.conf.get(debounce.PROVIDER) == before


# ---- tables that follow a stream ----


def bits(folder, spark, rows, schema):
    """One more file of a stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def files(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


PAYMENTS = "id long, item_id long, app string, outcome string, direction string, amount_paise long, amount_confidence double, payee string, upi_id string, paid_date string, paid_time string, reference string, problem string, decision string, entry long"


def some_payments(draw, entry, n):
    out = {}
    for _ in range(n):
        k = draw.randrange(25)
        out[k] = (
            k, k, None, draw.choice(["SUCCESS"] * 4 + ["FAILED"]), "PAID", draw.choice([None, 100, 100, 250, 999]), draw.choice([0.9, 0.4]), draw.choice(["A", "B"]), None, draw.choice([None, "2024-01-05", "2024-02-07", "2024-02-08"]),
            draw.choice([None, "10:00"]), draw.choice([None, None, "R1", "R2"]), None, draw.choice([None, None, "INCLUDE", "EXCLUDE"]), entry,
        )
    return list(out.values())


def test_live_ledger_is_the_ledger_after_each_batch(spark, tmp_path, monkeypatch):
    """Also where a batch stops after its payments are stored, or after its months are, and runs again."""
    from folioquery.operators import ledger as L
    from folioquery.sources.segments import Segments
    from folioquery.streaming import live

    draw, held = random.Random(6), {}
    own = live.LiveLedger(spark, f"file://{tmp_path}/ledger")
    items = spark.createDataFrame([(k, f"item {k}") for k in range(25)], "item_id long, name string")
    real = Segments._commit
    for turn in range(5):
        rows = some_payments(draw, turn, 9)
        held |= {r[0]: r for r in rows}
        bits(tmp_path / "in", spark, rows, PAYMENTS)
        keep = lambda: own.keep(files(spark, tmp_path / "in", PAYMENTS), f"file://{tmp_path}/log").awaitTermination()
        if turn in (1, 2, 3):
            stop = {1: ("months", False), 2: ("payments", False), 3: ("payments", True)}[turn]

            def failing(self, version, stop=stop):
                mine = self.folder.endswith(stop[0])
                done = real(self, version) if not mine or stop[1] else None
                if mine:
                    raise RuntimeError("stopped here")
                return done

            monkeypatch.setattr(Segments, "_commit", failing)
            with pytest.raises(Exception, match="stopped here"):
                keep()
            monkeypatch.setattr(Segments, "_commit", real)
        keep()
        batch = L.buckets(spark.createDataFrame(list(held.values()), PAYMENTS))
        want = sorted(map(tuple, L.month_totals(batch).collect()))
        assert sorted(map(tuple, own.month_totals().select("month", "total_paise", "payments").collect())) == want, turn
        assert {r.id for r in own.payments.read().collect()} == set(held)
    shown = own.with_items(items).collect()
    assert len(shown) == len(held) and [r.paid_date for r in shown] == sorted((r.paid_date for r in shown), key=lambda d: d or "", reverse=True) and all(r.name == f"item {r.id}" for r in shown)


def test_status_counts_follow(spark, tmp_path):
    from folioquery.sources.segments import Segments
    from folioquery.streaming import live

    draw, held = random.Random(2), {}
    items, counts = Segments(spark, f"file://{tmp_path}/items", "id"), Segments(spark, f"file://{tmp_path}/counts", "status")
    for turn in range(4):
        rows = [(draw.randrange(20), draw.choice(["PENDING", "INDEXED", "FAILED", None]) if turn < 3 else "INDEXED", 100 * turn + k) for k in range(12 if turn < 3 else 60)]
        held |= {k: s for k, s, _ in rows}
        bits(tmp_path / "in", spark, rows, "id long, status string, at long")
        live.keep_status_counts(files(spark, tmp_path / "in", "id long, status string, at long").where("status IS NOT NULL"), items, counts, f"file://{tmp_path}/log").awaitTermination()
        if turn == 0:
            known = {}
        for k, s, _ in rows:
            if s is not None:
                known[k] = s
        want = {s: list(known.values()).count(s) for s in known.values()}
        assert {r.status: r["items"] for r in counts.read().collect()} == want


def test_older_rows_that_come_late_change_nothing(spark, tmp_path):
    from folioquery.sources.segments import Segments
    from folioquery.streaming import live

    schema, items, counts = "id long, status string, at long", Segments(spark, f"file://{tmp_path}/items", "id"), Segments(spark, f"file://{tmp_path}/counts", "status")
    for part in ([(1, "INDEXED", 5), (2, "FAILED", 5)], [(1, "PENDING", 1), (2, "INDEXED", 6), (3, "PENDING", 1)], [(2, "PENDING", 2), (3, "PENDING", 0)]):
        bits(tmp_path / "in", spark, part, schema)
        live.keep_status_counts(files(spark, tmp_path / "in", schema), items, counts, f"file://{tmp_path}/log").awaitTermination()
    assert {(r.id, r.status) for r in items.read().collect()} == {(1, "INDEXED"), (2, "INDEXED"), (3, "PENDING")}
    assert {r.status: r["items"] for r in counts.read().collect()} == {"INDEXED": 2, "PENDING": 1}


def test_a_run_that_was_stopped_goes_on(spark, tmp_path, monkeypatch):
    """The sink fails once between writing and its batch's commit; then every row is there once, and work goes on with what is left."""
    from pyspark.sql import functions as F

    from folioquery.sources.segments import Segments
    from folioquery.streaming import live

    schema = "uri string, modified_at timestamp, text string"
    store = Segments(spark, f"file://{tmp_path}/items", "uri")
    run = lambda: live.ingest_files(files(spark, tmp_path / "in", schema), store, f"file://{tmp_path}/log").awaitTermination()
    for part in range(3):
        bits(tmp_path / "in", spark, [(f"f{part}-{k}", START, f"text {k}") for k in range(5)], schema)
    change, calls = Segments.change, []

    def failing(self, *a, **b):
        out = change(self, *a, **b)
        calls.append(b["note"])
        if len(calls) == 2:
            raise RuntimeError("killed after writing")
        return out

    monkeypatch.setattr(Segments, "change", failing)
    with pytest.raises(Exception, match="killed after writing"):
        run()
    run()
    assert len(calls) == 4 and calls[1] == calls[2]  # the second batch ran twice
    monkeypatch.setattr(Segments, "change", change)
    rows = store.read().collect()
    assert sorted(r.uri for r in rows) == sorted(f"f{p}-{k}" for p in range(3) for k in range(5)) and {r.status for r in rows} == {"PENDING"}
    assert live.work_off(store, lambda pending: pending.where("uri LIKE 'f1%'").withColumn("status", F.lit("INDEXED"))) == 5
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|killed"):
        live.work_off(store, lambda pending: pending.withColumn("status", F.raise_error(F.lit("killed")).cast("string")))
    assert live.work_off(store, lambda pending: pending.withColumn("status", F.lit("INDEXED"))) == 10
    assert live.work_off(store, lambda pending: pending) == 0
    bits(tmp_path / "in", spark, [("f1-1", START + datetime.timedelta(days=1), "changed"), ("new", START, None)], schema)
    run()
    assert {(r.uri, r.text) for r in store.read().where("status = 'PENDING'").collect()} == {("f1-1", "changed"), ("new", None)} and store.version().rows == 16


# ---- watchdogs ----

SCRIPTS = [
    # events (ms, event, attempt, text), and what they lead to (ms, why, state, attempt, text)
    ([(0, "start", None, ""), (500, "ready", 1, ""), (900, "partial", 1, "a"), (2000, "final", 1, "a b")], [(0, "start", "STARTING", 1, ""), (500, "ready", "LISTENING", 1, ""), (900, "partial", "LISTENING", 1, "a"), (2000, "final", "IDLE", 1, "a b")]),
    ([(0, "start", None, "")], [(0, "start", "STARTING", 1, ""), (8000, "watchdog", "FAILED", 2, "NO_RESPONSE")]),
    ([(0, "start", None, ""), (8000, "ready", 1, "")], [(0, "start", "STARTING", 1, ""), (8000, "watchdog", "FAILED", 2, "NO_RESPONSE")]),
    ([(0, "start", None, ""), (10, "ready", 1, "")], [(0, "start", "STARTING", 1, ""), (10, "ready", "LISTENING", 1, ""), (20010, "watchdog", "PROCESSING", 1, ""), (26010, "watchdog", "FAILED", 2, "NO_RESPONSE")]),
    ([(0, "start", None, ""), (10, "ready", 1, ""), (15000, "partial", 1, "x"), (34000, "partial", 1, "x y"), (40000, "stop", None, ""), (41000, "partial", 1, "x y z"), (45999, "final", 1, "x y z")], [(0, "start", "STARTING", 1, ""), (10, "ready", "LISTENING", 1, ""), (15000, "partial", "LISTENING", 1, "x"), (34000, "partial", "LISTENING", 1, "x y"), (40000, "stop", "PROCESSING", 1, "x y"), (41000, "partial", "PROCESSING", 1, "x y z"), (45999, "final", "IDLE", 1, "x y z")]),
    ([(0, "start", None, ""), (1, "cancel", None, ""), (2, "ready", 1, ""), (3, "start", None, ""), (4, "final", 1, "late"), (5, "error", 3, "NETWORK"), (6, "dismiss", None, "")], [(0, "start", "STARTING", 1, ""), (1, "cancel", "IDLE", 2, ""), (3, "start", "STARTING", 3, ""), (5, "error", "FAILED", 3, "NETWORK"), (6, "dismiss", "IDLE", 3, "")]),
    ([(0, "start", None, ""), (1, "ready", 1, ""), (2, "start", None, ""), (3, "final", 1, " ")], [(0, "start", "STARTING", 1, ""), (1, "ready", "LISTENING", 1, ""), (3, "final", "FAILED", 1, "NO_MATCH")]),
    ([(5, "stop", None, ""), (6, "dismiss", None, ""), (7, "partial", 9, "x"), (8, "what", 0, "")], []),
]


@pytest.mark.parametrize("events,want", SCRIPTS)
def test_scripts_of_sessions(events, want):
    from folioquery.streaming import watchdogs as W

    assert [(at, why, s.state, s.attempt, s.text) for at, why, s in W.steps(W.Session(), events, 1_000_000)] == want


def test_sessions_as_a_stream(spark, tmp_path):
    """All scripts and random ones at once, dealt over files with a restart after each, give what they give by themselves."""
    from folioquery.streaming import watchdogs as W

    ship(spark)
    draw = random.Random(9)
    scripts = {f"s{k}": events for k, (events, _) in enumerate(SCRIPTS)}
    for k in range(6):
        at = sorted(draw.sample(range(90_000), 40))
        scripts[f"r{k}"] = [(t, draw.choice(["start", "start", "ready", "ready", "partial", "final", "error", "stop", "cancel", "dismiss"]), draw.randint(1, 12), draw.choice(["", "x", "y"])) for t in at]
    rows = sorted(((START + datetime.timedelta(milliseconds=at), key, n, event, attempt, text) for key, events in scripts.items() for n, (at, event, attempt, text) in enumerate(events)), key=lambda r: r[0])
    schema = "at timestamp, key string, entry long, event string, attempt long, text string"

    def run():
        with debounce.timers(spark):
            W.watched(files(spark, tmp_path / "in", schema), "key", "5 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], [(START + datetime.timedelta(days=1), None, 0, None, None, None), (None, "s0", 0, "start", None, "")]):
        bits(tmp_path / "in", spark, part, schema)
        run()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect():
        got.setdefault(r.key, []).append((round((r.at - START).total_seconds() * 1000), r.why, r.state, r.attempt, r.text))
    for key, events in scripts.items():
        assert sorted(got.get(key, [])) == sorted((at, why, s.state, s.attempt, s.text) for at, why, s in W.steps(W.Session(), events, 10_000_000)), key


def test_watched_sessions_of_the_table(spark, sf):
    from folioquery.plans import queries_streams as Q
    from folioquery.streaming import watchdogs as W

    events = {}
    for r in Q.session_events(spark, sf).orderBy("at", "entry").collect():
        events.setdefault(str(r.user_id), []).append((int(r["at"].replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000) // 1000, r.event or "", r.attempt, r.text or ""))
    want = {}
    for user, own in events.items():
        for _, why, s in W.steps(W.Session(), own, 2**50):
            want[user, s.state, why] = want.get((user, s.state, why), 0) + 1
    ship(spark)
    got = {(r.user_id, r.state, r.why): r.changes for r in Q.sessions_under_watch(spark, sf).collect()}
    assert got == want and any(why == "watchdog" for _, _, why in got)

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.operators import flows as FL
from flowlens.operators import forest as FO
from flowlens.operators import incidents as I
from flowlens.operators import models as M
from flowlens.operators.reports import last_flows
from flowlens.plans import jobs
from flowlens.plans import views as V
from flowlens.session import scratch_path
from flowlens.sources.sinks import sessions
from flowlens.sources.tables import packet_stream
from flowlens.streaming import flow_state as ST
from flowlens.streaming.incident_store import IncidentStore
from flowlens.streaming.monitor import Monitor


def split_source(spark, sf, parts):
    """Packets in arrival order as several files, so that flows cross micro-batches."""
    path = scratch_path(spark, "source")
    packets = V.packets(spark, sf)
    n = packets.count()
    for i in range(parts):
        packets.where(F.floor(F.col("packet_seq") * parts / n) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def run(query_of, sink, check):
    query = query_of.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()


def comparable(df):
    names = sorted(c for c in df.columns if c not in ("termination_reason", "is_terminated"))
    types = dict(df.dtypes)
    return df.select(*[F.round(F.col(c) / (1e6 if "gap" in c else 1), 2).alias(c) if types[c] == "double" else F.col(c).cast("string").alias(c) for c in names])


def test_stream_equals_batch(spark, sf):
    source = split_source(spark, sf, 3)
    sink, check = scratch_path(spark, "sink"), scratch_path(spark, "check")
    flows = ST.stream_flows(packet_stream(spark, source, 1), V.IDLE_SECONDS, "30 days")
    run(flows, sink, check)
    before = spark.read.parquet(sink)
    assert before.where("termination_reason = 'active'").count() == 0  # nothing is drained while the stream runs
    ST.drain_packet(spark).write.mode("append").parquet(source)
    run(flows, sink, check)
    got, want = spark.read.parquet(sink), V.flows(spark, sf, V.IDLE_SECONDS)
    assert got.count() == want.count()
    assert comparable(got).exceptAll(comparable(want)).count() == 0
    reasons = {r[0]: r[1] for r in got.groupBy("termination_reason").count().collect()}
    expected = {r[0]: r[1] for r in want.groupBy("termination_reason").count().collect()}
    assert reasons == pytest.approx(expected)


def test_buckets_grow_with_a_micro_batch(spark, sf, monkeypatch):
    """A stream that reads everything at once takes buckets by its packets, and gives the flows of the batch form."""
    assert ST.buckets_for(0) == ST.buckets_for(100_000) == ST.BUCKETS and ST.buckets_for(36_000_000) * ST.BUCKET_PACKETS >= 36_000_000
    taken, make = [], ST.stream_flows
    monkeypatch.setattr(ST, "BUCKETS", 2)
    monkeypatch.setattr(ST, "BUCKET_PACKETS", 100)
    monkeypatch.setattr(ST, "stream_flows", lambda *a, **k: taken.append(k["buckets"]) or make(*a, **k))
    got, n = jobs.q_stream_split(spark, sf), V.packets(spark, sf).count()
    assert taken == [-(-(n + 1) // 100)] and taken[0] > 2
    want = V.flows(spark, sf, V.IDLE_SECONDS).select("flow_seq", "src_ip", "src_port", "packets")
    assert got.select(*want.columns).exceptAll(want).count() == want.exceptAll(got.select(*want.columns)).count() == 0


@pytest.fixture(scope="module")
def monitored(spark, sf):
    """A monitor over several micro-batches with real models, and what it counted after each of them."""
    train = jobs._generalized(spark, sf)
    root = scratch_path(spark, "models")
    M.save(M.fit_generalized(train, "is_bad", iterations=2, depth=3), f"{root}/model")
    FO.fit(train, SC.GENERALIZED_FEATURES, trees=5, key="row_key").write.parquet(f"{root}/forest")
    score = M.stream_scorer(spark, f"{root}/model", f"{root}/forest")
    source = split_source(spark, sf, 2)
    ST.drain_packet(spark).write.mode("append").parquet(source)
    monitor = Monitor(spark, scratch_path(spark, "monitor"), score, "mon-1", recent_rows=40)
    seen, store = [], monitor.store

    def watched(batch, batch_id):
        store(batch, batch_id)
        flows = monitor.flows()
        seen.append((monitor.live_counters().first(), flows.agg(F.count("*"), F.count_if("is_attack"), F.sum("packet_count")).first()))

    monitor.store = watched
    query = monitor.start(ST.stream_flows(packet_stream(spark, source, 1), V.IDLE_SECONDS, "30 days", with_late=True), available_now=True)
    query.awaitTermination()
    monitor.stop(query)
    return monitor, seen, score


def by_key(incidents):
    return {(r.src_ip, r.attack_category): (r.flow_count, r.risk_score, r.first_seen, r.last_seen) for r in incidents.collect()}


def test_monitor(spark, sf, monitored):
    monitor, seen, _ = monitored
    stored = monitor.flows()
    assert stored.count() == V.flows(spark, sf, V.IDLE_SECONDS).count() and stored.select("flow_id").distinct().count() == stored.count()
    assert by_key(monitor.incidents()) == by_key(I.correlate(stored)) and monitor.late().count() == 0
    state = sessions(spark.read.parquet(f"{monitor.root}/sessions")).first()
    assert (state.status, state.flow_count) == ("Stopped", stored.count())
    assert monitor.counters().first().flow_count == stored.count()


def test_counters_equal_the_store_after_every_batch(monitored):
    _, seen, _ = monitored
    assert len(seen) > 2
    for live, store in seen:
        assert (live.flows, live.attacks, live.packets or 0) == (store[0], store[1], store[2] or 0)


def test_recent_flows_are_those_of_the_store(spark, monitored):
    monitor, _, _ = monitored
    want = [r.flow_id for r in last_flows(monitor.flows(), 40).collect()]
    assert [r.flow_id for r in monitor.recent().collect()] == want
    assert [r.flow_id for r in monitor.recent(7).collect()] == want[-7:]
    # what is at hand has a fixed size, and a batch that runs again finds what it found before
    sizes = [r["count"] for r in spark.read.parquet(f"{monitor.root}/recent").groupBy("batch").count().collect()]
    assert max(sizes) == 40
    last = spark.read.parquet(f"{monitor.root}/flows").agg(F.max("batch")).first()[0]
    monitor._keep_recent(spark.read.parquet(f"{monitor.root}/flows/batch={last}"), last)
    assert [r.flow_id for r in monitor.recent().collect()] == want


def test_streamed_scores_equal_batch_scores(spark, sf, monitored):
    monitor, _, score = monitored
    names = ["flow_seq", "prediction", "risk_score", "anomaly_score", "is_anomaly", "generalized_prob", "generalized_prediction"]
    got = {r.flow_seq: tuple(r) for r in monitor.flows().select(*names).collect()}
    want = {r.flow_seq: tuple(r) for r in score(V.flows(spark, sf, V.IDLE_SECONDS)).select(*names).collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(want[k], abs=1e-3) for k, a in got.items())
    assert len({a[3] for a in got.values()}) > 1


def test_incidents_written_are_those_changed(spark):
    root = scratch_path(spark, "incident-store")
    store = IncidentStore(spark, root, buckets=4, compact_every=4)
    everything = None

    def fresh(batch, names):
        rows = [(f"inc-{batch}-{n}", f"t {n}", "New", "Medium", n, "10.9.9.9", "Bot", 1, 60.0 + batch, f"2024-01-0{batch + 1} 00:00:00") for n in names]
        df = spark.createDataFrame(rows, "incident_id string, title string, status string, severity string, src_ip string, dst_ip string, "
                                   "attack_category string, flow_count long, risk_score double, t string")
        t = F.col("t").cast("timestamp")
        return df.withColumns({"first_seen": t, "last_seen": t, "notes": F.lit(None).cast("string"), "analyst": F.lit(None).cast("string")}).drop("t")

    many = [f"10.0.0.{i}" for i in range(200)]
    for batch, names in enumerate([many, [None, "10.0.0.5"], [None], ["10.0.0.5", "new"], [None, "new"], ["10.0.0.7"]]):
        new = fresh(batch, names)
        store.merge(new, batch)
        everything = new if everything is None else I.upsert(everything, new)
        assert by_key(store.current()) == by_key(everything)
        before = by_key(store.current())
        store.merge(new, batch)
        assert by_key(store.current()) == before
        written = spark.read.parquet(f"{root}/changes").where(F.col("batch") == batch).count()
        assert written == len(names)
    got = by_key(store.current())
    assert got[None, "Bot"][:2] == (3, 64.0) and got["10.0.0.5", "Bot"][0] == 3 and len(got) == 202
    # states were written together once, and reading starts there
    assert {r[0] for r in spark.read.parquet(f"{root}/states").select("batch").distinct().collect()} <= {-1, 4}
    assert spark.read.parquet(f"{root}/states").where("batch = 4").count() == 202
    assert by_key(store.current(before=2)).get((None, "Bot"))[0] == 1


def odd_packets(spark):
    """Two conversations out of order, with nulls, told in two parts; the last packet comes after its time."""
    base = 1_700_000_000
    rows = [
        (1, base + 100, "a", "b", 1, 2, "TCP", 100, 2, 10, 20), (2, base + 130, "a", "b", 1, 2, "TCP", 50, 16, 10, 20),
        (3, base + 110, "b", "a", 2, 1, "TCP", None, None, None, None), (4, base + 105, "a", "b", 1, 2, None, 10, None, 5, 8),
        (5, base + 160, None, "b", None, 2, "UDP", 70, 0, None, 8),
        (6, base + 120, "a", "b", 1, 2, "TCP", 40, 16, 10, 20), (7, base + 115, "b", "a", 2, 1, "TCP", 60, 16, 9, 20),
        (8, base + 150, None, "b", None, 2, "UDP", 80, None, None, 8), (9, base + 170, "a", "b", 1, 2, "TCP", 30, 17, 10, 20),
        (10, base + 20, "a", "b", 1, 2, "TCP", 999, 16, 10, 20),
    ]
    names = "packet_seq long, s long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, pkt_len long, tcp_flags int, win_size int, header_len int"
    return spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds("s")).select("packet_seq", "ts", *[c.split()[0] for c in names.split(", ")[2:]])


def test_gaps_over_batches_nulls_and_late_packets(spark):
    packets = odd_packets(spark)
    source, sink, check = (scratch_path(spark, x) for x in ("source", "sink", "check"))
    for part in (packets.where("packet_seq <= 5"), packets.where("packet_seq > 5"), ST.drain_packet(spark)):
        part.coalesce(1).write.mode("append").parquet(source)
        run(ST.stream_flows(packet_stream(spark, source), 1e6, "60 seconds", with_late=True), sink, check)
    got = spark.read.parquet(sink)
    late = ST.late_packets(got).collect()
    assert [(r.packet_seq, r.src_ip, r.pkt_len) for r in late] == [(10, "a", 999)]
    flows = ST.on_time(got)
    want = FL.build_flows(packets.where("packet_seq < 10"), 1e6)
    assert flows.count() == want.count() == 3
    assert comparable(flows).exceptAll(comparable(want)).count() == 0


def test_a_bucket_of_flows_is_one_value_and_one_timer(spark):
    class Store:
        def __init__(self):
            self.value, self.calls, self.timers = None, 0, set()

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    def packets(first, times, tuples=300):
        rows = [(f"10.0.{i // 256}.{i % 256}", "b", 1, 2, "TCP", first + n * tuples + i, t * 1_000_000 + i, 60, 16, 5, 20, True)
                for n, t in enumerate(times) for i in range(tuples)]
        return pd.DataFrame(rows, columns=[*FL.KEY, *ST.PACKET_FIELDS])

    processor, store, clock = ST.FlowProcessor(10.0), Store(), Clock()
    processor.handle = processor.open = store
    assert not list(processor.handleInputRows((7,), iter([packets(0, [100, 101]), packets(600, [102])]), clock))
    assert store.calls == 1 and store.timers == {112_000}
    clock.now = 105_000
    assert not list(processor.handleInputRows((7,), iter([packets(900, [106], 5)]), clock))
    assert store.calls == 3 and store.timers == {112_000}
    # what is still open keeps the bucket's one timer
    clock.now, store.timers = 115_000, set()
    closed = pd.concat(processor.handleExpiredTimer((7,), clock, None))
    assert len(closed) == 295 and set(closed.packets) == {3} and set(closed.termination_reason) == {"inactivity_timeout"}
    assert store.timers == {116_000}
    clock.now, store.timers = ST.DRAIN_MILLIS, set()
    rest = pd.concat(processor.handleExpiredTimer((7,), clock, None))
    assert len(rest) == 5 and set(rest.packets) == {4} and set(rest.termination_reason) == {"active"} and not store.exists() and not store.timers


def test_a_bucket_is_folded_in_at_once(monkeypatch):
    """Cuts, ends and directions of many flows by one fold over the bucket; before, every flow was folded by itself."""
    calls, fold = [], ST.fold
    monkeypatch.setattr(ST, "fold", lambda *a: (calls.append(1), fold(*a)))
    rows = []
    for i in range(200):
        for n, (t, flags, from_a) in enumerate([(1, 16, True), (3, 16, False), (2, 17, True), (4, 16, False), (20, 4, True), (21, 16, True)]):
            rows.append((f"10.0.0.{i}", "b", 1, 2, "TCP", n * 200 + i, t * 1_000_000, 10 * (n + 1), flags, n, 5, from_a))
    processor, flows = ST.FlowProcessor(10.0), ST.Flows()
    tuples, p = processor._by_tuple(iter([pd.DataFrame(rows, columns=[*FL.KEY, *ST.PACKET_FIELDS])]), flows.five)
    reasons = processor._advance(tuples, p, flows)
    assert len(calls) == 1 and len(flows.five) == 800
    assert [reasons.count(r) for r in ("tcp_fin", "inactivity_timeout", "tcp_rst", None)] == [200] * 4
    flows.release(pd.Series(True, range(len(flows.at))).to_numpy())
    out = ST.closed_flows(flows, [r or "active" for r in reasons])
    fin = out[out.termination_reason == "tcp_fin"]
    assert set(fin.packets) == {3} and set(fin.bytes) == {60} and set(fin.fwd_packets) == {2} and set(fin.bwd_window) == {1}
    assert set(fin.gap_total) == {2e6} and set(fin.gap_max) == {1e6} and set(fin.first_fwd_gap) == {1e6} and set(fin.seconds) == {2.0}
    # the reply opens the flow after the end, so its sender is the source
    idle = out[out.termination_reason == "inactivity_timeout"]
    assert set(idle.src_ip) == {"b"} and set(idle.packets) == {1} and set(idle.fwd_bytes) == {40}

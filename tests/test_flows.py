import datetime as dt
import random

import pytest
from brute import flows as brute_flows

from flowlens.operators import flows as FL
from flowlens.schemas import PACKETS

A, B = ("192.168.1.10", 54321), ("10.0.0.5", 80)


def rows(packets):
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return [(p[0], epoch + dt.timedelta(microseconds=p[1]), *p[2:]) for p in packets]


def frame(spark, packets):
    return spark.createDataFrame(rows(packets), PACKETS)


def tcp(seq, seconds, src, dst, length, flags, win=65535, hdr=40, proto="TCP"):
    return (seq, int(round(seconds * 1e6)), src[0], dst[0], src[1], dst[1], proto, length, flags, win, hdr)


def collect(df):
    out = {}
    for r in df.collect():
        row = {"src_ip": r.src_ip, "dst_ip": r.dst_ip, "reason": r.termination_reason, "seconds": r.seconds, "first_fwd_gap": r.first_fwd_gap}
        for s in ("", "fwd_", "bwd_"):
            row[f"{s}len"] = (r[f"{s}len_min"], r[f"{s}len_max"], r[f"{s}len_mean"], r[f"{s}len_std"])
            row[f"{s}gap"] = (r[f"{s}gap_min"], r[f"{s}gap_max"], r[f"{s}gap_mean"], r[f"{s}gap_std"], r[f"{s}gap_total"])
            if s:
                for c in ("packets", "bytes", "header", "window"):
                    row[f"{s}{c}"] = r[f"{s}{c}"]
        out[r.flow_seq] = row
    return out


def same(got, want):
    assert set(got) == set(want)
    for seq in want:
        for name, value in want[seq].items():
            if isinstance(value, tuple) or isinstance(value, float):
                assert got[seq][name] == pytest.approx(value, rel=1e-9, abs=1e-6), (seq, name)
            else:
                assert got[seq][name] == value, (seq, name)


def test_three_packet_flow(spark):
    packets = [tcp(1, 100.0, A, B, 64, 2), tcp(2, 100.02, B, A, 120, 18), tcp(3, 100.1, A, B, 64, 17)]
    flows = FL.build_flows(frame(spark, packets))
    row = flows.select(*FL.header_columns()).first()
    assert (row.src_ip, row.packet_count, row.byte_count, row.termination_reason) == (A[0], 3, 248, "tcp_fin")
    assert row.is_terminated and row.duration == pytest.approx(0.1)
    c = flows.select(*FL.cicids_columns()).first()
    assert (c["Total Fwd Packets"], c["Total Backward Packets"], c["Destination Port"]) == (2, 1, 80)
    assert (c["SYN Flag Count"], c["ACK Flag Count"], c["FIN Flag Count"]) == (2, 2, 1)
    assert (c["Fwd IAT Total"], c["Flow IAT Max"], c["Fwd Header Length"]) == (100_000, 80_000, 80)
    u = flows.select(*FL.unsw_columns()).first()
    assert u["state"] == 2.0 and u["proto"] == 6.0 and u["tcprtt"] == pytest.approx(0.1)
    assert len(flows.select(*FL.cicids_columns()).columns) == 70
    assert len(flows.select(*FL.unsw_columns()).columns) == 42


def test_five_packet_flow(spark):
    c, s = ("192.168.1.10", 54321), ("1.1.1.1", 443)
    packets = [tcp(1, 0.0, c, s, 100, 2, 64240), tcp(2, 0.02, s, c, 60, 18), tcp(3, 0.05, c, s, 250, 24, 64240),
               tcp(4, 0.08, s, c, 800, 24), tcp(5, 0.1, c, s, 60, 17, 64240)]
    g = FL.build_flows(frame(spark, packets)).select(*FL.generalized_columns(), "fwd_window", "bwd_window").first()
    assert (g.forward_packets, g.forward_bytes, g.backward_packets, g.backward_bytes) == (3, 410, 2, 860)
    assert (g.total_packets, g.total_bytes, g.average_packet_size) == (5, 1270, 254)
    assert g.packets_per_second == pytest.approx(50) and g.bytes_per_second == pytest.approx(12_700)
    assert (g.fwd_window, g.bwd_window) == (64240, 65535)


TRAPS = [
    # FIN, then the peer's own FIN-ACK opens a second flow
    tcp(1, 1.0, A, B, 50, 17), tcp(2, 1.1, B, A, 60, 17),
    # FIN and RST in one packet; arrival order differs from time order
    tcp(3, 3.0, A, B, 10, 2, 0), tcp(4, 2.0, B, A, 20, 16, 500), tcp(5, 2.5, A, B, 30, 16, 700), tcp(6, 4.0, A, B, 5, 5),
    # both endpoints the same: all packets are forward
    tcp(7, 5.0, A, A, 40, 2), tcp(8, 5.5, A, A, 41, 16),
    # no ports
    (9, 6_000_000, "1.1.1.1", "2.2.2.2", 0, 0, "ICMP", 84, 0, 0, 0), (10, 6_500_000, "2.2.2.2", "1.1.1.1", 0, 0, "ICMP", 84, 0, 0, 0),
    # two packets at one instant
    tcp(11, 7.0, B, ("9.9.9.9", 1), 33, 16), tcp(12, 7.0, B, ("9.9.9.9", 1), 34, 16), tcp(13, 9.0, B, ("9.9.9.9", 1), 35, 16),
]


@pytest.mark.parametrize("block", [1 << 22, 2, 5])
@pytest.mark.parametrize("idle", [None, 0.75])
def test_traps(spark, block, idle):
    got = FL.build_flows(frame(spark, TRAPS), idle, block_rows=block, bucket_seconds=1)
    same(collect(got), brute_flows(TRAPS, None if idle is None else int(idle * 1e6)))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_packets_in_blocks(spark, seed):
    """One conversation holds most packets, times run out of order, blocks and buckets are tiny."""
    rnd = random.Random(seed)
    ends = [("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.3", 2000)]
    packets, t = [], 0
    for seq in range(220):
        t += rnd.choice([0, 1, 10_000, 300_000, 2_500_000])
        pair = ends[:2] if rnd.random() < 0.7 else rnd.sample(ends, 2)
        src, dst = rnd.sample(pair, 2)
        flags = rnd.choice([0, 2, 16, 16, 16, 16, 16, 24, 17 if seq % 3 else 16, 4 if seq % 7 == 0 else 16])
        packets.append((seq * 3, t - rnd.choice([0, 0, 0, 400_000]) + 1_000_000, src[0], dst[0], src[1], dst[1], rnd.choice(["TCP", "TCP", "UDP"]),
                        rnd.randrange(40, 1500), flags, rnd.choice([0, 500, 1000]), 20))
    df = frame(spark, packets).repartition(3)
    for idle in (None, 2.0):
        want = brute_flows(packets, None if idle is None else int(idle * 1e6))
        same(collect(FL.build_flows(df, idle)), want)
        same(collect(FL.build_flows(df, idle, block_rows=37, bucket_seconds=3)), want)


def test_idle_timeout_is_inclusive(spark):
    u = (("172.16.0.1", 12345), ("8.8.8.8", 53))
    packets = [tcp(1, 10.0, *u, 75, 0, 0, 8, "UDP"), tcp(2, 13.0, *u, 75, 0, 0, 8, "UDP")]
    reasons = {r.flow_seq: r.termination_reason for r in FL.build_flows(frame(spark, packets), 3.0).collect()}
    assert reasons == {1: "inactivity_timeout", 2: "active"}
    assert FL.build_flows(frame(spark, packets), 3.5).count() == 1


def test_open_flow_is_active(spark):
    packets = [tcp(1, 1000.0, A, B, 100, 2), tcp(2, 1000.1, B, A, 200, 18), tcp(3, 1000.2, A, B, 150, 16)]
    row = FL.build_flows(frame(spark, packets)).first()
    assert (row.termination_reason, row.is_terminated, row.packets) == ("active", False, 3)


def test_captures_do_not_mix(spark):
    from pyspark.sql import functions as F

    packets = frame(spark, [tcp(1, 1.0, A, B, 10, 2), tcp(2, 2.0, B, A, 10, 16)])
    both = packets.withColumn("capture", F.lit("a")).unionByName(packets.withColumn("capture", F.lit("b")))
    assert FL.build_flows(both).count() == 2
    assert FL.build_flows(both, block_rows=1).count() == 2


def test_partition_count_does_not_matter(spark, sf):
    from flowlens.plans import views as V

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted((r.flow_seq, r.packets, r.seconds) for r in V.flows(spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_tuples_as_blocks_need_one_shuffle(spark, sf):
    from flowlens.plans import views as V

    plan = FL.build_flows(V.packets(spark, sf), block_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

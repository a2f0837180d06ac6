"""Packet streams to flows: one small state per open flow, closed by FIN/RST, silence or the final drain.

The state is a fixed-size record (counts, moments, extremes, last times) and the times of the packets that wait in a
reorder buffer. A call into the state store costs far more than folding a flow's packets, so the five-tuples are dealt by
hash to a fixed number of buckets: a bucket's open flows are read, written and timed together, one value and one timer a
bucket. Packets of a micro-batch are put in arrival order per five-tuple, and all of a bucket's flows are cut, folded in
and put out by array operations over the bucket, not flow by flow. Gaps are taken in time order: a packet's time waits until the watermark has passed it, when no older packet
can follow, or until its flow ends; so gaps are those of the batch form, whatever the micro-batches. The buffer holds the
packets of ``lateness``, eight bytes each. How much one bucket may hold at once is bounded by the source's trigger options
and by the number of buckets: some 600 bytes an open flow, some hundred a packet of the micro-batch. A stream that reads
all it has in one micro-batch takes as many buckets as its packets ask for (``buckets_for``).

A packet that is not newer than the watermark of its micro-batch is late. It joins no flow and is put out by itself, with
``termination_reason`` ``late``; ``late_packets`` and ``on_time`` tell the two apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.functions.scalars import FLAG_BITS
from flowlens.operators.flows import KEY, prepared
from flowlens.session import STATE_STORE

# watermarks beyond this instant mean the stream is being drained (2200-01-01)
DRAIN_MILLIS = 7_258_118_400_000
DRAIN_PROTOCOL = "DRAIN"

SIDES = ("", "fwd_", "bwd_")
COUNTERS = ["fwd_header", "bwd_header", "fwd_window", "bwd_window", *[f"{f}_count" for f in FLAG_BITS]]
MOMENTS = ["n", "mean", "m2", "min", "max", "total"]
GROUPS = [f"{s}{kind}" for s in SIDES for kind in ("len", "gap")]
LAST = [f"{s}last" for s in SIDES]
FIELDS = COUNTERS + [f"{g}_{m}" for g in GROUPS for m in MOMENTS] + LAST + ["first_fwd_gap"]
INDEX = {name: i for i, name in enumerate(FIELDS)}

#: five-tuples are dealt to so many buckets
BUCKETS = 64
#: packets of a micro-batch that a bucket is meant to hold; a worker takes some kilobytes for each until the bucket is done
BUCKET_PACKETS = 1 << 14
#: closed flows handed on at once
OUTPUT_ROWS = 2000

# ``flows``: the pickled arrays of ``Flows``; ``timer``: when the bucket is looked at next
STATE_SCHEMA = "flows binary, timer long"
STAT_NAMES = [f"{s}{k}_{m}" for k in ("len", "gap") for s in SIDES for m in ("min", "max", "mean", "std")]
OUTPUT_SCHEMA = (
    "proto string, flow_seq long, fwd_packets long, bwd_packets long, fwd_bytes long, bwd_bytes long, fwd_header long, "
    "bwd_header long, fwd_window int, bwd_window int, "
    + ", ".join(f"{f}_count long" for f in FLAG_BITS) + ", "
    + ", ".join(f"{n} double" for n in STAT_NAMES)
    + ", len_var double, gap_total double, fwd_gap_total double, bwd_gap_total double, first_fwd_gap double, "
    "flow_id string, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, seconds double, "
    "packets long, bytes long, termination_reason string, is_terminated boolean"
)


def fresh_stats(flows: int) -> np.ndarray:
    """One row of statistics a flow."""
    stats = np.zeros((flows, len(FIELDS)))
    stats[:, [INDEX[x] for x in LAST]] = np.nan
    return stats


def begins_of(flow: np.ndarray) -> np.ndarray:
    """Places at which the next flow begins in rows that lie flow by flow."""
    return np.flatnonzero(np.diff(flow, prepend=-1))


def add_moments(stats: np.ndarray, group: str, flow: np.ndarray, values: np.ndarray) -> None:
    """Folds values, flow by flow, into the running counts, means, squared deviations and extremes of ``group``."""
    if not len(values):
        return
    begin, at = begins_of(flow), INDEX[f"{group}_n"]
    own = flow[begin]
    n, mean, m2, low, high, total = stats[own, at:at + 6].T
    k, sums = np.diff(begin, append=len(values)), np.add.reduceat(values, begin)
    shift = sums / k - mean
    least, most = np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin)
    stats[own, at:at + 6] = np.stack([
        n + k, mean + shift * k / (n + k),
        m2 + np.add.reduceat((values - np.repeat(sums / k, k)) ** 2, begin) + shift * shift * n * k / (n + k),
        np.where(n == 0, least, np.minimum(low, least)), np.where(n == 0, most, np.maximum(high, most)), total + sums,
    ], 1)


def fold(stats: np.ndarray, flow: np.ndarray, p: dict[str, np.ndarray], fwd: np.ndarray) -> None:
    """Folds packets (flow by flow, each in arrival order) into the flows' counts and lengths."""
    for side, rows in (("", np.ones(len(flow), bool)), ("fwd_", fwd), ("bwd_", ~fwd)):
        add_moments(stats, f"{side}len", flow[rows], p["pkt_len"][rows].astype(float))
        if side:
            stats[:, INDEX[f"{side}header"]] += np.bincount(flow[rows], p["header_len"][rows], len(stats))
            seen = rows & (p["win_size"] > 0)
            begin = begins_of(flow[seen])
            own, window = flow[seen][begin], INDEX[f"{side}window"]
            stats[own, window] = np.where(stats[own, window] == 0, p["win_size"][seen][begin], stats[own, window])
    for name, bit in FLAG_BITS.items():
        stats[:, INDEX[f"{name}_count"]] += np.bincount(flow[(p["tcp_flags"] & bit) != 0], minlength=len(stats))


def fold_gaps(stats: np.ndarray, flow: np.ndarray, t: np.ndarray, fwd: np.ndarray) -> None:
    """Folds times in, none of them before those of its flow folded in earlier, as gaps of the flows and their directions."""
    order = np.lexsort((t, flow))
    flow, t, fwd = flow[order], t[order].astype(float), fwd[order]
    for side, rows in (("", slice(None)), ("fwd_", fwd), ("bwd_", ~fwd)):
        times, own = t[rows], flow[rows]
        if not len(times):
            continue
        begin, last = begins_of(own), INDEX[f"{side}last"]
        before = np.concatenate(([0.0], times[:-1]))
        before[begin] = stats[own[begin], last]
        some = ~np.isnan(before)
        gaps, of = (times - before)[some], own[some]
        if side == "fwd_":
            first = begins_of(of)
            first = first[stats[of[first], INDEX["fwd_gap_n"]] == 0]
            stats[of[first], INDEX["first_fwd_gap"]] = gaps[first]
        add_moments(stats, f"{side}gap", of, gaps)
        stats[own[begin], last] = times[np.append(begin[1:], len(times)) - 1]


class Flows:
    """Flows of a bucket as arrays: five-tuple, times and statistics of each, and the times that the watermark has not passed."""

    def __init__(self, five=(), head=None, a_opens=(), stats=None, at=(), t=(), fwd=()):
        self.five = list(five)
        #: flow_seq, first and latest time
        self.head = np.zeros((0, 3), np.int64) if head is None else head
        #: the initiator is the lower endpoint
        self.a_opens = np.array(a_opens, bool)
        self.stats = fresh_stats(0) if stats is None else stats
        #: packets that wait: number of the flow, time, direction
        self.at, self.t, self.fwd = np.array(at, np.int64), np.array(t, np.int64), np.array(fwd, bool)

    def dump(self) -> bytes:
        return pickle.dumps((self.five, self.head, self.a_opens, self.stats, self.at, self.t, self.fwd))

    def add(self, five: list[tuple], head: np.ndarray, a_opens: np.ndarray) -> None:
        self.five += five
        self.head, self.a_opens = np.concatenate([self.head, head]), np.concatenate([self.a_opens, a_opens])
        self.stats = np.concatenate([self.stats, fresh_stats(len(five))])

    def wait(self, at: np.ndarray, t: np.ndarray, fwd: np.ndarray) -> None:
        self.at, self.t, self.fwd = (np.concatenate(x) for x in ((self.at, at), (self.t, t), (self.fwd, fwd)))

    def release(self, go: np.ndarray) -> None:
        """Folds in the waiting packets ``go`` and keeps the rest."""
        fold_gaps(self.stats, self.at[go], self.t[go], self.fwd[go])
        self.at, self.t, self.fwd = self.at[~go], self.t[~go], self.fwd[~go]

    def part(self, rows: np.ndarray) -> Flows:
        """The flows ``rows`` (ascending numbers) with what waits of them."""
        place = np.full(len(self.five), -1)
        place[rows] = np.arange(len(rows))
        own = place[self.at] >= 0
        return Flows([self.five[i] for i in rows], self.head[rows], self.a_opens[rows], self.stats[rows],
                     place[self.at[own]], self.t[own], self.fwd[own])

    def ends(self, idle: int) -> np.ndarray:
        """The millisecond at which each flow has been silent for the timeout."""
        return -(-(self.head[:, 2] + idle) // 1000)


def late_packets_of(tuples: list[tuple], p: dict[str, np.ndarray]) -> pd.DataFrame:
    """Late packets in the columns of flows; what a lone packet does not have is null."""
    rows = []
    for i, five in enumerate(p["five"].tolist()):
        key = tuples[five]
        ends = (key[0], key[1], key[2], key[3]) if p["from_a"][i] else (key[1], key[0], key[3], key[2])
        rows.append(dict(zip(("src_ip", "dst_ip", "src_port", "dst_port"), ends, strict=True)) | {
            "proto": key[4], "flow_seq": int(p["packet_seq"][i]), "timestamp": pd.Timestamp(int(p["t"][i]), unit="us", tz="UTC"),
            "packets": 1, "bytes": int(p["pkt_len"][i]), "termination_reason": "late", "is_terminated": False,
        })
    # objects, so that whole numbers and nulls stand beside each other
    frame = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in OUTPUT_COLUMNS})
    frame["timestamp"] = pd.to_datetime(frame["timestamp"], utc=True)
    return frame


def closed_flows(flows: Flows, reasons: list[str]) -> pd.DataFrame:
    """Flows that have ended, nothing of them waiting, in the columns of the batch form."""
    get = lambda name: flows.stats[:, INDEX[name]]
    whole = lambda name: get(name).astype(np.int64)
    ip_a, ip_b, port_a, port_b, proto = (np.array(x, object) for x in zip(*flows.five, strict=True))
    a = flows.a_opens
    out = {"proto": proto, "flow_seq": flows.head[:, 0]}
    for side in ("fwd", "bwd"):
        out[f"{side}_packets"], out[f"{side}_bytes"] = whole(f"{side}_len_n"), whole(f"{side}_len_total")
    for name in COUNTERS:
        out[name] = whole(name)
    for group in GROUPS:
        n = get(f"{group}_n")
        for m in ("min", "max", "mean"):
            out[f"{group}_{m}"] = get(f"{group}_{m}")
        out[f"{group}_std"] = np.sqrt(get(f"{group}_m2") / np.maximum(n, 1))
        if group.endswith("gap"):
            out[f"{group}_total"] = get(f"{group}_total")
    out["len_var"], out["first_fwd_gap"], out["flow_id"] = out["len_std"] ** 2, get("first_fwd_gap"), None
    out["timestamp"] = pd.to_datetime(flows.head[:, 1], unit="us", utc=True)
    out["src_ip"], out["dst_ip"] = np.where(a, ip_a, ip_b), np.where(a, ip_b, ip_a)
    out["src_port"], out["dst_port"] = np.where(a, port_a, port_b), np.where(a, port_b, port_a)
    out["seconds"] = np.maximum(1e-6, (flows.head[:, 2] - flows.head[:, 1]) / 1e6)
    out["packets"], out["bytes"] = out["fwd_packets"] + out["bwd_packets"], out["fwd_bytes"] + out["bwd_bytes"]
    out["termination_reason"], out["is_terminated"] = reasons, [r != "active" for r in reasons]
    return pd.DataFrame(out, columns=OUTPUT_COLUMNS)


class FlowProcessor(StatefulProcessor):
    def __init__(self, idle_timeout: float):
        self.idle = int(round(idle_timeout * 1_000_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        flows, timer = self._saved()
        tuples, p = self._by_tuple(rows, flows.five)
        late = p["t"] <= passed if passed > 0 else np.zeros(len(p["t"]), bool)
        if late.any():
            yield from in_parts(late_packets_of(tuples, {c: v[late] for c, v in p.items()}))
        reasons = self._advance(tuples, {c: v[~late] for c, v in p.items()}, flows)
        closed = np.array([r is not None for r in reasons], bool)
        go = closed[flows.at]
        flows.release(go | (flows.t <= passed) if passed > 0 else go)
        self._keep(flows.part(np.flatnonzero(~closed)), timer)
        if closed.any():
            yield from in_parts(closed_flows(flows.part(np.flatnonzero(closed)), [r for r in reasons if r is not None]))

    @staticmethod
    def _by_tuple(rows: Iterator[pd.DataFrame], known: list[tuple]) -> tuple[list[tuple], dict[str, np.ndarray]]:
        """Five-tuples, those of open flows first, and a micro-batch's packets by five-tuple and arrival."""
        number = {k: i for i, k in enumerate(known)}
        chunks = []
        for part in rows:
            part = part[part["proto"] != DRAIN_PROTOCOL]
            chunk = {c: part[c].to_numpy() for c in PACKET_FIELDS}
            chunk["five"] = np.array([number.setdefault(k, len(number)) for k in zip(*(part[c].tolist() for c in KEY), strict=True)], np.int64)
            chunks.append(chunk)
        p = {c: np.concatenate([chunk[c] for chunk in chunks]) for c in [*PACKET_FIELDS, "five"]}
        order = np.lexsort((p["packet_seq"], p["five"]))
        return list(number), {c: v[order] for c, v in p.items()}

    def _advance(self, tuples: list[tuple], p: dict[str, np.ndarray], flows: Flows) -> list[str | None]:
        """Folds packets into the open flows and those that they open; why each flow has ended, if it has."""
        size, known, five, t = len(p["t"]), len(flows.five), p["five"], p["t"]
        if not size:
            return [None] * known
        # a run of packets ends with its five-tuple, and with FIN or RST; the first of a five-tuple goes on with its open flow
        ended = (p["tcp_flags"] & 5) != 0
        first = np.diff(five, prepend=-1) != 0
        begins = first | np.concatenate(([False], ended[:-1]))
        run, begin = np.cumsum(begins) - 1, np.flatnonzero(begins)
        carried = first[begin][run] & (five < known)
        # the latest time before each packet of its run, by the times' ranks, as these do not overflow
        values, rank = np.unique(t, return_inverse=True)
        latest = values[np.maximum.accumulate(rank + run * size) - run * size]
        before = np.where(begins, t, np.concatenate((t[:1], latest[:-1])))
        last = flows.head[five[carried], 2]
        before[carried] = np.where(begins[carried], last, np.maximum(before[carried], last))
        silent = t - before >= self.idle
        opens = (begins & ~carried) | silent
        opened = np.cumsum(opens)
        same = carried & (opened == (opened - opens)[begin][run])
        flow = np.where(same, five, known + opened - 1)
        left = np.where(begins, five, np.concatenate((flow[:1], flow[:-1])))[silent]
        flows.add([tuples[i] for i in five[opens].tolist()], np.stack([p["packet_seq"], t, t], 1)[opens].astype(np.int64), p["from_a"][opens].astype(bool))
        order = np.argsort(flow, kind="stable")
        p, own = {c: v[order] for c, v in p.items()}, flow[order]
        fwd = p["from_a"] == flows.a_opens[own]
        fold(flows.stats, own, p, fwd)
        flows.wait(own, p["t"], fwd)
        at = begins_of(own)
        flows.head[own[at], 2] = np.maximum(flows.head[own[at], 2], np.maximum.reduceat(p["t"], at))
        reasons: list[str | None] = [None] * len(flows.five)
        for i in left.tolist():
            reasons[i] = "inactivity_timeout"
        over = (p["tcp_flags"] & 5) != 0
        for i, fin in zip(own[over].tolist(), (p["tcp_flags"][over] & 1).tolist(), strict=True):
            reasons[i] = "tcp_fin" if fin else "tcp_rst"
        return reasons

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        reason = "active" if now >= DRAIN_MILLIS else "inactivity_timeout"
        flows, _ = self._saved()
        due = flows.ends(self.idle) <= now
        self._keep(flows.part(np.flatnonzero(~due)), None)
        if due.any():
            ended = flows.part(np.flatnonzero(due))
            ended.release(np.ones(len(ended.at), bool))
            yield from in_parts(closed_flows(ended, [reason] * len(ended.five)))

    def _saved(self) -> tuple[Flows, int | None]:
        saved = self.open.get() if self.open.exists() else None
        return (Flows(*pickle.loads(saved[0])), saved[1]) if saved else (Flows(), None)

    def _keep(self, flows: Flows, timer: int | None) -> None:
        """Stores the bucket; its one timer is never later than the first end of its flows."""
        first = int(flows.ends(self.idle).min()) if flows.five else None
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        if timer is None:
            self.open.clear()
        else:
            self.open.update((flows.dump(), timer))


def in_parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), OUTPUT_ROWS):
        yield frame.iloc[at:at + OUTPUT_ROWS]


PACKET_FIELDS = ["packet_seq", "t", "pkt_len", "tcp_flags", "win_size", "header_len", "from_a"]
OUTPUT_COLUMNS = [part.split()[0] for part in OUTPUT_SCHEMA.split(", ")]


def buckets_for(packets: int) -> int:
    """Buckets of a stream whose micro-batches have up to so many packets; a small one keeps the usual number."""
    return max(BUCKETS, -(-packets // BUCKET_PACKETS))


def stream_flows(
    packets: DataFrame, idle_timeout: float = 3.0, lateness: str = "1 second", with_late: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Completed flows of a packet stream, in the columns of the batch form; ``with_late``: and the late packets.

    ``buckets``, the number of parts that the state is dealt to, stays as it is over the life of a checkpoint.

    Null fields are filled as in the batch form; packets without a time cannot be placed and are left out.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the time goes on as a number: Spark drops late rows unseen where the time column itself reaches the state
    rows, _ = prepared(packets.where("ts is not null").withWatermark("ts", lateness))
    keyed = rows.select(
        *KEY, "packet_seq", "t", "pkt_len", "tcp_flags", "win_size", "header_len",
        ((F.col("src_ip") == F.col("ip_a")) & (F.col("src_port") == F.col("port_a"))).alias("from_a"),
    )
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    flows = dealt.groupBy("bucket").transformWithStateInPandas(
        FlowProcessor(idle_timeout), outputStructType=OUTPUT_SCHEMA, outputMode="append", timeMode="eventTime",
    )
    return with_flow_id(flows if with_late else on_time(flows))


@contextmanager
def state_partitions(spark: SparkSession):
    """Starts streams whose state lies in no more partitions than there are cores.

    Each partition starts a worker and opens a store in every micro-batch. A stream keeps the number it started with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def on_time(flows: DataFrame) -> DataFrame:
    return flows.where("termination_reason <> 'late'")


def late_packets(flows: DataFrame) -> DataFrame:
    """Packets that came after the watermark had passed them."""
    return flows.where("termination_reason = 'late'").select(
        F.col("flow_seq").alias("packet_seq"), "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto", F.col("bytes").alias("pkt_len")
    )


def with_flow_id(flows: DataFrame) -> DataFrame:
    """The batch form's flow id, from the canonical key and the flow's first arrival number."""
    from flowlens.functions.scalars import hashed_id

    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return flows.withColumn(
        "flow_id", hashed_id("flow", low["ip"], high["ip"], low["port"], high["port"], F.col("proto"), F.col("flow_seq"))
    )


def drain_packet(spark) -> DataFrame:
    """One row that moves the watermark past every timer, to be appended to the source when a stream stops."""
    return spark.sql(
        f"SELECT -1L AS packet_seq, timestamp'2201-01-01 00:00:00' AS ts, '' AS src_ip, '' AS dst_ip, 0 AS src_port, "
        f"0 AS dst_port, '{DRAIN_PROTOCOL}' AS proto, 0L AS pkt_len, 0 AS tcp_flags, 0 AS win_size, 0 AS header_len"
    )

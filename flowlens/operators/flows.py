"""Packets to bidirectional flows.

A flow is all packets of one canonical five-tuple between two terminating packets (FIN or RST), optionally
also split where the tuple stayed silent for ``idle_timeout`` seconds. Numbering flows is a running
computation along the arrival order of one tuple, and a single tuple may hold a large part of the table, so it is
done in two levels: inside blocks of ``block_rows`` consecutive arrival numbers (a block of one tuple can never hold
more rows than that), then over one summary row per block, which carries the open flow into the next block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.schemas import CICIDS_FEATURES, GENERALIZED_FEATURES, UNSW_FEATURES
from flowlens.session import materialize

KEY = ["ip_a", "ip_b", "port_a", "port_b", "proto"]
BLOCK_ROWS = 1 << 22
BUCKET_SECONDS = 60


def with_canonical_key(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation get the same ``KEY``: endpoints ordered by (address, port)."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(src, dst), F.greatest(src, dst)
    return packets.withColumns(
        {"ip_a": low["ip"], "ip_b": high["ip"], "port_a": low["port"], "port_b": high["port"]}
    )


def prepared(packets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Packets with nulls filled and their key, and the names of the key's columns."""
    capture = ["capture"] if "capture" in packets.columns else []
    zero = F.lit(0)
    rows = packets.select(
        *capture,
        "packet_seq",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        F.coalesce(F.col("src_port").cast("int"), zero).alias("src_port"),
        F.coalesce(F.col("dst_port").cast("int"), zero).alias("dst_port"),
        F.coalesce("proto", F.lit("OTHER")).alias("proto"),
        F.coalesce(F.col("pkt_len").cast("long"), F.lit(0)).alias("pkt_len"),
        F.coalesce(F.col("tcp_flags").cast("int"), zero).alias("tcp_flags"),
        F.coalesce(F.col("win_size").cast("int"), zero).alias("win_size"),
        F.coalesce(F.col("header_len").cast("int"), zero).alias("header_len"),
    ).withColumn("term", S.has_flag(F.col("tcp_flags"), S.FIN | S.RST))
    return with_canonical_key(rows), capture + KEY


def _opener() -> Column:
    return F.struct("packet_seq", "t", "src_ip", "src_port", "dst_ip", "dst_port")


def assign_flows(
    packets: DataFrame,
    idle_timeout: float | None = None,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Every packet with ``flow_seq`` (arrival number of its flow's first packet), the flow's ``start_t``,
    ``a_opens`` (the lower endpoint of the key is the initiator), ``is_fwd``, ``timed_out`` (this packet is the last before an idle split) and ``wide`` (its tuple has more packets than a block).

    Without ``block_rows`` each tuple is one block: fewer shuffles, for tables without very long conversations. Nothing
    in the plan depends on the table's size.
    """
    rows, key = prepared(packets)
    single_block = block_rows is None
    block = key if single_block else key + ["block"]
    if not single_block:
        rows = rows.withColumn("block", F.floor(F.col("packet_seq") / block_rows))
    gap = None if idle_timeout is None else int(round(idle_timeout * 1_000_000))

    order = Window.partitionBy(*block).orderBy("packet_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    # segments end with a terminating packet; a candidate opens a flow unless one is carried in
    rows = rows.withColumn("prev_term", F.lag("term").over(order))
    first = F.col("prev_term").isNull()
    if gap is None:
        rows = rows.withColumn("candidate", first | F.col("prev_term"))
        if not single_block:
            rows = rows.withColumn("seg", F.sum(F.coalesce("prev_term", F.lit(False)).cast("int")).over(upto))
    else:
        rows = rows.withColumn("seg", F.sum(F.coalesce("prev_term", F.lit(False)).cast("int")).over(upto))
        rows = rows.withColumn("seen", F.max(F.struct("seg", "t")).over(before))
        silent = F.col("t") - F.col("seen")["t"] >= gap
        rows = rows.withColumn("candidate", first | F.col("prev_term") | silent).drop("seen")

    if single_block:
        rows = rows.withColumns({"starts": F.col("candidate"), "wide": F.lit(False)})
        rows = rows.withColumn("opener", F.last(F.when(F.col("starts"), _opener()), ignorenulls=True).over(upto))
        next_starts = F.lead("starts").over(order)
    else:
        carry = _carry(rows, key, block, gap, block_rows)
        rows = rows.join(carry, block)
        opens = F.col("open_t").isNull()
        if gap is not None:
            opens = opens | (F.col("t") - F.col("open_t") >= gap)
        rows = rows.withColumn("starts", F.col("candidate") & ((F.col("seg") > 0) | opens))
        local = F.last(F.when(F.col("starts"), _opener()), ignorenulls=True).over(upto)
        rows = rows.withColumn("opener", F.coalesce(local, F.col("open_flow")))
        next_starts = F.coalesce(F.lead("starts").over(order), F.col("ends_idle"))

    if gap is None:
        timed_out = F.lit(False)
    else:
        timed_out = ~F.col("term") & F.coalesce(next_starts, F.lit(False))
    opener = F.col("opener")
    return rows.select(
        *key, "packet_seq", "t", "src_ip", "src_port", "pkt_len", "tcp_flags", "win_size", "header_len", "wide",
        opener["packet_seq"].alias("flow_seq"),
        opener["t"].alias("start_t"),
        ((F.col("ip_a") == opener["src_ip"]) & (F.col("port_a") == opener["src_port"])).alias("a_opens"),
        ((F.col("src_ip") == opener["src_ip"]) & (F.col("src_port") == opener["src_port"])).alias("is_fwd"),
        timed_out.alias("timed_out"),
    )


def _carry(rows: DataFrame, key: list[str], block: list[str], gap: int | None, block_rows: int) -> DataFrame:
    """Per (tuple, block): the flow still open when the block begins, when it was last seen, and whether the
    block's last flow ends by silence before the next block."""
    ends = rows.groupBy(*block).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("term").alias("has_term"),
        F.max_by("term", "packet_seq").alias("last_term"),
        F.min_by("t", "packet_seq").alias("first_t"),
        F.max(F.struct("seg", "t"))["t"].alias("tail_t"),
        F.max(F.when(F.col("candidate"), _opener())).alias("last_open"),
    )
    along = Window.partitionBy(*key).orderBy("block")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("era", F.sum(F.col("has_term").cast("int")).over(upto))
    alive = F.when(~F.col("last_term"), F.col("tail_t"))
    ends = ends.withColumn("out_t", F.max(F.struct("era", alive.alias("t"))).over(upto)["t"])
    ends = ends.withColumns({
        "open_t": F.lag("out_t").over(along),
        "wide": F.sum("n").over(Window.partitionBy(*key)) > block_rows,
        "next_t": F.lead("first_t").over(along),
    })
    fresh = F.col("has_term") | F.col("open_t").isNull()
    if gap is not None:
        fresh = fresh | (F.col("last_open")["t"] - F.col("open_t") >= gap)
    ends = ends.withColumn("out_flow", F.when(fresh & ~F.col("last_term"), F.col("last_open")))
    open_flow = F.when(F.col("open_t").isNotNull(), F.last("out_flow", ignorenulls=True).over(before))
    ends_idle = F.lit(False) if gap is None else F.coalesce(F.col("next_t") - F.col("out_t") >= gap, F.lit(False))
    return ends.select(*block, "open_t", open_flow.alias("open_flow"), ends_idle.alias("ends_idle"), "wide")


def with_gaps(assigned: DataFrame, single_block: bool, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``gap`` and ``dir_gap``: microseconds since the previous packet of the flow and of the flow's direction,
    in time order (null for the first).

    Flows of tuples with more packets than a block are cut into time buckets, with the last times of earlier buckets
    carried over.
    """
    flow = [c for c in assigned.columns if c == "capture"] + KEY + ["flow_seq"]
    parts = flow
    rows = assigned
    if not single_block:
        bucket = F.when(F.col("wide"), F.floor(F.col("t") / (bucket_seconds * 1_000_000))).otherwise(F.lit(0))
        rows = rows.withColumn("bucket", bucket)
        parts = flow + ["bucket"]
    order = Window.partitionBy(*parts).orderBy("t", "packet_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t")
    fwd_t, bwd_t = F.when(F.col("is_fwd"), t), F.when(~F.col("is_fwd"), t)
    rows = rows.withColumns({
        "last_t": F.lag("t").over(order),
        "last_fwd": F.last(fwd_t, ignorenulls=True).over(before),
        "last_bwd": F.last(bwd_t, ignorenulls=True).over(before),
    })
    if not single_block:
        edges = rows.where("wide").groupBy(*parts).agg(
            F.max("t").alias("max_t"), F.max(fwd_t).alias("max_fwd"), F.max(bwd_t).alias("max_bwd")
        )
        earlier = Window.partitionBy(*flow).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(
            *parts,
            F.max("max_t").over(earlier).alias("edge_t"),
            F.max("max_fwd").over(earlier).alias("edge_fwd"),
            F.max("max_bwd").over(earlier).alias("edge_bwd"),
        )
        rows = rows.join(edges, parts, "left").withColumns({
            "last_t": F.coalesce("last_t", "edge_t"),
            "last_fwd": F.coalesce("last_fwd", "edge_fwd"),
            "last_bwd": F.coalesce("last_bwd", "edge_bwd"),
        }).drop("edge_t", "edge_fwd", "edge_bwd", "bucket")
    same_direction = F.when(F.col("is_fwd"), F.col("last_fwd")).otherwise(F.col("last_bwd"))
    return rows.withColumns({"gap": t - F.col("last_t"), "dir_gap": t - same_direction}).drop(
        "last_t", "last_fwd", "last_bwd"
    )


def _zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def aggregate_flows(rows: DataFrame) -> DataFrame:
    """One row per flow with every statistic the feature schemas need (times in seconds, gaps in microseconds)."""
    flow = [c for c in rows.columns if c == "capture"] + KEY + ["flow_seq"]
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")
    length = F.col("pkt_len")
    aggs = [
        F.min("start_t").alias("start_t"),
        F.max("a_opens").alias("a_opens"),
        F.max("t").alias("last_t"),
        F.max_by("tcp_flags", "packet_seq").alias("last_flags"),
        F.max("timed_out").alias("timed_out"),
        F.count_if(fwd).alias("fwd_packets"),
        F.count_if(bwd).alias("bwd_packets"),
        F.coalesce(F.sum(F.when(fwd, length)), F.lit(0)).alias("fwd_bytes"),
        F.coalesce(F.sum(F.when(bwd, length)), F.lit(0)).alias("bwd_bytes"),
        F.coalesce(F.sum(F.when(fwd, F.col("header_len"))), F.lit(0)).alias("fwd_header"),
        F.coalesce(F.sum(F.when(bwd, F.col("header_len"))), F.lit(0)).alias("bwd_header"),
    ]
    opened = F.col("win_size") > 0
    for side, test in (("fwd", fwd), ("bwd", bwd)):
        window = F.min_by(F.when(test & opened, F.col("win_size")), F.when(test & opened, F.col("packet_seq")))
        aggs.append(F.coalesce(window, F.lit(0)).alias(f"{side}_window"))
    aggs += [F.count_if(S.has_flag(F.col("tcp_flags"), bit)).alias(f"{name}_count") for name, bit in S.FLAG_BITS.items()]
    for side, value in (("len", length), ("fwd_len", F.when(fwd, length)), ("bwd_len", F.when(bwd, length))):
        aggs += [
            _zero(F.min(value)).alias(f"{side}_min"), _zero(F.max(value)).alias(f"{side}_max"),
            _zero(F.avg(value)).alias(f"{side}_mean"), _zero(F.stddev_pop(value)).alias(f"{side}_std"),
        ]
    aggs.append(_zero(F.var_pop(length)).alias("len_var"))
    gaps = (
        ("gap", F.col("gap")), ("fwd_gap", F.when(fwd, F.col("dir_gap"))), ("bwd_gap", F.when(bwd, F.col("dir_gap"))),
    )
    for side, value in gaps:
        aggs += [
            _zero(F.sum(value)).alias(f"{side}_total"), _zero(F.avg(value)).alias(f"{side}_mean"),
            _zero(F.stddev_pop(value)).alias(f"{side}_std"),
            _zero(F.max(value)).alias(f"{side}_max"), _zero(F.min(value)).alias(f"{side}_min"),
        ]
    second_fwd = F.min(F.when(fwd & F.col("dir_gap").isNotNull(), F.col("t")))
    aggs.append(_zero(second_fwd - F.min(F.when(fwd, F.col("t")))).alias("first_fwd_gap"))

    flags = F.col("last_flags")
    reason = (
        F.when(S.has_flag(flags, S.FIN), "tcp_fin").when(S.has_flag(flags, S.RST), "tcp_rst")
        .when(F.col("timed_out"), "inactivity_timeout").otherwise("active")
    )
    out = rows.groupBy(*flow).agg(*aggs)
    seconds = F.greatest(F.lit(1e-6), (F.col("last_t") - F.col("start_t")) / 1_000_000.0)

    def side(part: str, initiator: bool) -> Column:
        return F.when(F.col("a_opens") == F.lit(initiator), F.col(f"{part}_a")).otherwise(F.col(f"{part}_b"))

    return out.withColumns({
        "flow_id": S.hashed_id("flow", *[F.col(c) for c in flow]),
        "timestamp": F.timestamp_micros("start_t"),
        "src_ip": side("ip", True), "dst_ip": side("ip", False),
        "src_port": side("port", True), "dst_port": side("port", False),
        "seconds": seconds,
        "packets": F.col("fwd_packets") + F.col("bwd_packets"),
        "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "termination_reason": reason,
        "is_terminated": reason != "active",
    }).drop("start_t", "a_opens", "last_t", "last_flags", "timed_out", "ip_a", "ip_b", "port_a", "port_b")


def build_flows(
    packets: DataFrame,
    idle_timeout: float | None = None,
    block_rows: int | None = BLOCK_ROWS,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Packets to flow statistics: block-wise, or in one full shuffle with ``block_rows=None``.

    The block-wise form reads the assigned packets twice, so they are written to the shared folder once.
    """
    single = block_rows is None
    assigned = assign_flows(packets, idle_timeout, block_rows)
    if not single:
        assigned = materialize(assigned, "assigned-packets")
    return aggregate_flows(with_gaps(assigned, single, bucket_seconds))


# --- projections -----------------------------------------------------------
def header_columns() -> list[Column]:
    return [
        F.col("flow_id"), F.col("timestamp"), F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"),
        F.col("proto").alias("protocol"), F.round("seconds", 6).alias("duration"),
        F.col("packets").alias("packet_count"), F.col("bytes").alias("byte_count"),
        F.col("is_terminated"), F.col("termination_reason"),
    ]


def generalized_columns() -> list[Column]:
    d = F.col("seconds")
    values = {
        "duration_seconds": d,
        "forward_packets": F.col("fwd_packets"), "backward_packets": F.col("bwd_packets"),
        "forward_bytes": F.col("fwd_bytes"), "backward_bytes": F.col("bwd_bytes"),
        "total_packets": F.col("packets"), "total_bytes": F.col("bytes"),
        "packets_per_second": F.col("packets") / d, "bytes_per_second": F.col("bytes") / d,
        "average_packet_size": F.col("len_mean"),
    }
    return [values[name].cast("double").alias(name) for name in GENERALIZED_FEATURES]


def cicids_columns() -> list[Column]:
    d = F.col("seconds")
    c = F.col
    values: dict[str, Column] = {
        "Destination Port": c("dst_port"), "Flow Duration": d * 1_000_000.0,
        "Total Fwd Packets": c("fwd_packets"), "Total Backward Packets": c("bwd_packets"),
        "Total Length of Fwd Packets": c("fwd_bytes"), "Total Length of Bwd Packets": c("bwd_bytes"),
        "Flow Bytes/s": c("bytes") / d, "Flow Packets/s": c("packets") / d,
        "Fwd Packets/s": c("fwd_packets") / d, "Bwd Packets/s": c("bwd_packets") / d,
        "Min Packet Length": c("len_min"), "Max Packet Length": c("len_max"),
        "Packet Length Mean": c("len_mean"), "Packet Length Std": c("len_std"),
        "Packet Length Variance": c("len_var"), "Average Packet Size": c("len_mean"),
        "Down/Up Ratio": S.ratio(c("bwd_packets"), c("fwd_packets")),
        "Fwd Header Length": c("fwd_header"), "Fwd Header Length.1": c("fwd_header"),
        "Bwd Header Length": c("bwd_header"),
        "Fwd PSH Flags": c("psh_count"), "Fwd URG Flags": c("urg_count"),
        "Init_Win_bytes_forward": c("fwd_window"), "Init_Win_bytes_backward": c("bwd_window"),
        "act_data_pkt_fwd": c("fwd_packets"),
        "min_seg_size_forward": F.when(c("proto") == "TCP", 20.0).otherwise(8.0),
    }
    for flag in S.FLAG_BITS:
        values[f"{flag.upper()} Flag Count"] = c(f"{flag}_count")
    for side in ("Fwd", "Bwd"):
        s = side.lower()
        values[f"Avg {side} Segment Size"] = c(f"{s}_len_mean")
        values[f"Subflow {side} Packets"] = c(f"{s}_packets")
        values[f"Subflow {side} Bytes"] = c(f"{s}_bytes")
        values[f"{side} IAT Total"] = c(f"{s}_gap_total")
        for stat in ("Max", "Mean", "Min", "Std"):
            values[f"{side} Packet Length {stat}"] = c(f"{s}_len_{stat.lower()}")
            values[f"{side} IAT {stat}"] = c(f"{s}_gap_{stat.lower()}")
    for stat in ("Max", "Mean", "Min", "Std"):
        values[f"Flow IAT {stat}"] = c(f"gap_{stat.lower()}")
        values[f"Active {stat}"] = F.lit(0.0)
        values[f"Idle {stat}"] = F.lit(0.0)
    return [values[name].cast("double").alias(name) for name in CICIDS_FEATURES]


def unsw_columns() -> list[Column]:
    d = F.col("seconds")
    c = F.col
    milli = 1000.0
    first_gap = c("first_fwd_gap") / 1_000_000.0
    same_endpoint = (c("src_ip") == c("dst_ip")) & (c("src_port") == c("dst_port"))
    values = {
        "dur": d, "proto": S.protocol_code(c("proto")),
        "state": F.when((c("syn_count") > 0) & (c("ack_count") > 0), 2.0).otherwise(1.0),
        "spkts": c("fwd_packets"), "dpkts": c("bwd_packets"), "sbytes": c("fwd_bytes"), "dbytes": c("bwd_bytes"),
        "rate": c("packets") / d, "sload": c("fwd_bytes") * 8 / d, "dload": c("bwd_bytes") * 8 / d,
        "sinpkt": c("fwd_gap_mean") / milli, "dinpkt": c("bwd_gap_mean") / milli,
        "sjit": c("fwd_gap_std") / milli, "djit": c("bwd_gap_std") / milli,
        "swin": c("fwd_window"), "dwin": c("bwd_window"),
        "tcprtt": first_gap, "synack": first_gap / 2.0, "ackdat": first_gap / 2.0,
        "smean": c("fwd_len_mean"), "dmean": c("bwd_len_mean"),
        "is_sm_ips_ports": F.when(same_endpoint, 1.0).otherwise(0.0),
    }
    # fixed values: columns a single flow cannot measure
    constants = {"sttl": 64.0, "dttl": 64.0, "ct_srv_src": 1.0, "ct_state_ttl": 1.0, "ct_dst_ltm": 1.0,
                 "ct_src_dport_ltm": 1.0, "ct_dst_sport_ltm": 1.0, "ct_dst_src_ltm": 1.0, "ct_src_ltm": 1.0,
                 "ct_srv_dst": 1.0}
    return [
        values.get(name, F.lit(constants.get(name, 0.0))).cast("double").alias(name) for name in UNSW_FEATURES
    ]

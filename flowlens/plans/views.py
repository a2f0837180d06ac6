"""Views of the driver's tables in this library's input shapes (deterministic, the same in SQL: see ``oracle``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalars as S
from flowlens.operators import decide as D
from flowlens.operators import flows as FL
from flowlens.schemas import GENERALIZED_FEATURES, THRESHOLDS
from flowlens.session import spread

IDLE_SECONDS = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as packets: users talk to eight servers, some event types are the server's answers."""
    # parsed once: the optimizer keeps an expensive column apart when it is read several times
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, kind, k = F.col("user_id"), F.col("event_type"), F.col("k")
    udp = k % 4 == 3
    client_ip = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    client_port = (F.lit(40000) + user % 1000).cast("int")
    server_ip = F.concat(F.lit("172.16.0."), (k % 8).cast("string"))
    server_port = F.when(k % 4 == 0, 80).when(k % 4 == 1, 443).when(k % 4 == 2, 22).otherwise(53)
    answer = kind.isin("view", "purchase")
    flags = (
        F.when(udp, 0).when(kind == "signup", 17).when(kind == "error", 4).when(kind == "click", 2)
        .when(kind == "view", 16).when(kind == "purchase", 24).otherwise(0)
    )
    return e.select(
        F.col("event_id").alias("packet_seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(answer, server_ip).otherwise(client_ip).alias("src_ip"),
        F.when(answer, client_ip).otherwise(server_ip).alias("dst_ip"),
        F.when(answer, server_port).otherwise(client_port).alias("src_port"),
        F.when(answer, client_port).otherwise(server_port).alias("dst_port"),
        F.when(udp, "UDP").otherwise("TCP").alias("proto"),
        (F.lit(40) + F.floor("value")).cast("long").alias("pkt_len"),
        flags.alias("tcp_flags"),
        F.when(udp, 0).otherwise(F.lit(1000) + k).cast("int").alias("win_size"),
        F.when(udp, 8).otherwise(20).alias("header_len"),
    )


def flows(spark: SparkSession, sf_dir: str, idle_timeout: float | None = None) -> DataFrame:
    return FL.build_flows(packets(spark, sf_dir), idle_timeout)


def flow_columns() -> list[Column]:
    """``lineitem`` columns as one flow row each; ``row_key`` is unique in every scale of the table."""
    part, price = F.col("l_partkey"), F.col("l_extendedprice")
    return [
        F.concat_ws(
            "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), part.cast("string"),
            F.col("l_suppkey").cast("string"), F.round(price * 100).cast("long").cast("string"),
        ).alias("row_key"),
        (part % 16).cast("int").alias("dst_port"),
        F.col("l_quantity").alias("fwd_pkts"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_linenumber").cast("double")).alias("bwd_pkts"),
        F.when(part % 200 == 0, price * 2000).otherwise(price * 10).alias("fwd_bytes"),
        F.col("l_tax").alias("duration"),
        F.when(F.col("l_linestatus") == "O", "TCP").otherwise("UDP").alias("protocol"),
        F.col("l_returnflag").alias("label"),
    ]


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its order's customer as the source: an arbitrary flow table for profiling and rules."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        *flow_columns(),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src_ip"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def dirty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow table with nulls, NaN, infinities and exact copies in it."""
    line = table(spark, sf_dir, "lineitem")
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return line.select(
        order.alias("flow_key"),
        F.when(order % 11 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("packets"),
        F.when(part % 13 == 0, F.lit(float("nan"))).when(part % 17 == 0, F.lit(float("inf")))
        .when(part % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice")).alias("bytes"),
        F.when(supp % 7 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("protocol"),
        F.explode(F.sequence(F.lit(1), F.when(order % 5 == 0, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


ACTUAL = ["BENIGN", "Bot", "DDoS", "PortScan", "Infiltration"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as scored rows with a true and a predicted class."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(*labelled_columns())


def labelled_columns() -> list[Column]:
    names = F.array(*[F.lit(c) for c in ACTUAL])
    true = (F.col("l_partkey") % 5).cast("int")
    wrong = ((F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0).cast("int")
    shifted = (true + wrong) % 5
    noise = F.col("l_quantity") + F.col("l_discount") * 100
    prob = F.when(shifted == 0, noise * 8 / 1000).otherwise(F.lit(0.35) + noise / 100)
    return [
        *flow_columns(),
        F.get(names, true).alias("actual"),
        F.get(names, shifted).alias("predicted"),
        F.round(prob, 4).alias("attack_prob"),
        F.round(F.lit(0.5) + noise / 125, 4).alias("confidence"),
        F.round(noise / 62.5, 4).alias("margin"),
    ]


def scored(spark: SparkSession, sf_dir: str, idle_timeout: float | None = None) -> DataFrame:
    """Flows of ``packets`` with the deterministic scorer's decisions."""
    return score_flows(flows(spark, sf_dir, idle_timeout))


def score_flows(closed: DataFrame) -> DataFrame:
    """Flows of a table or of a micro-batch with the deterministic scorer's decisions."""
    base = closed.select("flow_seq", *FL.header_columns(), *FL.generalized_columns())
    p = D.logistic_probability()
    port = F.col("dst_port")
    category = (
        F.when(port == 80, "DDoS").when(port == 443, "Web Attack - XSS").when(port == 22, "Bot")
        .when(port == 53, "PortScan").otherwise("Infiltration")
    )
    seq = F.col("flow_seq")
    rows = base.withColumn("p", p).withColumns({
        "is_attack": F.col("p") >= 0.5,
        "attack_probability": F.round("p", 4),
        "confidence": F.round(F.greatest(F.col("p"), 1.0 - F.col("p")), 4),
        "prediction_margin": F.round(F.abs(F.col("p") * 2.0 - 1.0), 4),
        "risk_score": S.risk_score(F.col("p")),
        "anomaly_score": F.round(F.lit(0.3) - F.log1p("total_bytes") / 25.0, 4),
        "generalized_prediction": F.when(F.col("p") >= THRESHOLDS["generalized"], "Attack").otherwise("Normal"),
        "dataset": F.lit("CICIDS2017"),
        "source_type": F.when(seq % 3 == 0, "csv").when(seq % 3 == 1, "pcap").otherwise("live"),
        "job_id": F.concat(F.lit("job-"), (seq % 7).cast("string")),
        "session_id": F.concat(F.lit("mon-"), (seq % 5).cast("string")),
    })
    return rows.withColumns({
        "risk_level": S.risk_level(F.col("risk_score")),
        "is_anomaly": F.col("anomaly_score") < THRESHOLDS["isolation_forest"],
        "prediction": F.when(F.col("is_attack"), category).otherwise("BENIGN"),
    })


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled`` as a prediction log."""
    line = table(spark, sf_dir, "lineitem")
    keyed = line.select(
        *labelled_columns(), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_linestatus").alias("st"), F.col("l_partkey").alias("pk"),
    )
    return keyed.select(
        F.concat(F.lit("pred-"), "row_key").alias("prediction_id"), "timestamp",
        F.when(F.col("st") == "O", "UNSW-NB15").otherwise("CICIDS2017").alias("dataset"),
        F.col("predicted").alias("prediction"), (F.col("predicted") != "BENIGN").alias("is_attack"),
        F.col("attack_prob").alias("attack_probability"), "confidence",
        S.risk_score(F.col("attack_prob")).alias("risk_score"),
        S.risk_level(S.risk_score(F.col("attack_prob"))).alias("risk_level"),
        F.when(F.col("pk") % 3 != 0, "manual").alias("input_source"),
    )


# names as files of different origin write them; what each order bundle holds decides what it can feed
HEADER_NAMES = [
    "dur", "Flow Duration", "spkts", "Total Fwd Packets", "dpkts", "bwd_packets", "sbytes", "fwd-bytes", "dbytes",
    "Total Length of Bwd Packets", "total.packets", "BYTES_PER_SECOND", "rate", "Label", "Flow Bytes/s", "junk_col",
]


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four consecutive orders as one file whose columns are named by their lines' parts."""
    line = table(spark, sf_dir, "lineitem")
    place = (F.col("l_partkey") % len(HEADER_NAMES)).cast("int")
    return line.select(
        F.concat(F.lit("file-"), F.floor(F.col("l_orderkey") / 4).cast("string")).alias("file"),
        place.alias("position"), F.get(F.array(*[F.lit(n) for n in HEADER_NAMES]), place).alias("column"),
    ).distinct()


def feature_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose generalized features sit in a map, some of them absent, some not numbers."""
    line = spread(table(spark, sf_dir, "lineitem"))
    cells = []
    for i, name in enumerate(GENERALIZED_FEATURES):
        key = name.upper() if i % 2 else name
        value = F.when((F.col("l_suppkey") + i) % 9 == 0, "n/a").otherwise((F.col("l_quantity") * (i + 1)).cast("string"))
        absent = (F.col("l_partkey") + F.col("l_suppkey") * i) % 6 == 0
        cells.append(F.when(~absent, F.struct(F.lit(key).alias("k"), value.alias("v"))))
    return line.select(
        flow_columns()[0], F.map_from_entries(F.array_compact(F.array(*cells))).alias("features")
    )

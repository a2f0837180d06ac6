"""The registered queries: each runs an operator over the driver's tables (see ``views``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.functions import scalars as S
from flowlens.functions import sketches as SKE
from flowlens.operators import adapt as A
from flowlens.operators import audit as AU
from flowlens.operators import decide as D
from flowlens.operators import evaluate as E
from flowlens.operators import explain as X
from flowlens.operators import flows as FL
from flowlens.operators import incidents as I
from flowlens.operators import profile as P
from flowlens.operators import reports as R
from flowlens.operators import rules as RU
from flowlens.plans import views as V
from flowlens.plans.mapping import split_labels
from flowlens.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def snake(name: str) -> str:
    return name.lower().replace("/", "_").replace(" ", "_").replace(".", "_")


def rounded(df: DataFrame, digits: int = 4, **other: int) -> DataFrame:
    """Doubles rounded; ``other`` gives the digits of single columns (fewer for large numbers)."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), other.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def is_attack() -> Column:
    return F.col("actual") != "BENIGN"


def time_text(name: str) -> Column:
    return S.iso_time(F.col(name)).alias(name)


# --- flow construction -----------------------------------------------------
@query
def q_flow_header(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.header_columns())
    return rows.withColumn("timestamp", S.iso_time(F.col("timestamp")))


@query
def q_flow_counts(spark, sf):
    return V.flows(spark, sf).select(
        "flow_seq", "fwd_packets", "bwd_packets", "packets", "fwd_bytes", "bwd_bytes", "bytes"
    )


@query
def q_flow_lengths(spark, sf):
    names = [f"{p}len_{s}" for p in ("", "fwd_", "bwd_") for s in ("min", "max", "mean", "std")]
    return rounded(V.flows(spark, sf).select("flow_seq", *names, "len_var"), 6)


@query
def q_flow_iat(spark, sf):
    names = [f"{p}gap_{s}" for p in ("", "fwd_", "bwd_") for s in ("total", "mean", "std", "max", "min")]
    return V.flows(spark, sf).select(
        "flow_seq", *[F.round(F.col(n) / 1e6, 3).alias(n) for n in names], F.round(F.col("first_fwd_gap") / 1e6, 3).alias("first_fwd_gap")
    )


@query
def q_flow_flags(spark, sf):
    return V.flows(spark, sf).select("flow_seq", *[f"{f}_count" for f in S.FLAG_BITS], "termination_reason", "is_terminated")


@query
def q_flow_rates(spark, sf):
    d = F.col("seconds")
    return rounded(V.flows(spark, sf).select(
        "flow_seq", F.col("seconds"), (F.col("packets") / d).alias("packets_per_second"),
        (F.col("bytes") / d).alias("bytes_per_second"), S.ratio(F.col("bwd_packets"), F.col("fwd_packets")).alias("down_up"),
    ), 4)


@query
def q_flow_windows(spark, sf):
    return V.flows(spark, sf).select("flow_seq", "fwd_header", "bwd_header", "fwd_window", "bwd_window")


@query
def q_flow_generalized(spark, sf):
    return rounded(V.flows(spark, sf).select("flow_seq", *FL.generalized_columns()))


@query
def q_flow_cicids(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.cicids_columns())
    out = []
    for c in SC.CICIDS_FEATURES:
        v = F.col(f"`{c}`")
        out.append((F.round(v / 1e6, 3) if " IAT " in c or c == "Flow Duration" else F.round(v, 3 if c.endswith("/s") else 6)).alias(snake(c)))
    return rows.select("flow_seq", *out)


@query
def q_flow_unsw(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.unsw_columns())
    out = []
    for c in SC.UNSW_FEATURES:
        v = F.col(c)
        out.append((F.round(v / 1e3, 3) if c in ("sinpkt", "dinpkt", "sjit", "djit") else F.round(v, 6 if c in ("smean", "dmean") else 3)).alias(c))
    return rows.select("flow_seq", *out)


@query
def q_flow_idle_split(spark, sf):
    return V.flows(spark, sf, V.IDLE_SECONDS).select(
        "flow_seq", "src_ip", "src_port", "packets", "bytes", F.round("seconds", 6).alias("seconds"), "termination_reason"
    )


@query
def q_packet_gaps(spark, sf):
    packets = V.packets(spark, sf)
    rows = FL.with_gaps(FL.assign_flows(packets, None, block_rows=None), True)
    return rows.select("packet_seq", "flow_seq", "is_fwd", "gap", "dir_gap")


@query
def q_gap_buckets(spark, sf):
    """The same from blocks and time buckets, far smaller than the tables' conversations."""
    assigned = materialize(FL.assign_flows(V.packets(spark, sf), None, block_rows=64), "assigned-packets")
    return FL.with_gaps(assigned, False, bucket_seconds=5).select("packet_seq", "flow_seq", "is_fwd", "gap", "dir_gap")


@query
def q_flow_blocks(spark, sf):
    """Idle splits, block by block."""
    flows = FL.build_flows(V.packets(spark, sf), V.IDLE_SECONDS, block_rows=64, bucket_seconds=5)
    return flows.select(
        "flow_seq", "src_ip", "src_port", "packets", "bytes", F.round("seconds", 6).alias("seconds"), "termination_reason"
    )


@query
def q_packet_keys(spark, sf):
    keyed = FL.with_canonical_key(V.packets(spark, sf))
    return keyed.select(
        "packet_seq", *FL.KEY, S.protocol_code(F.col("proto")).alias("protocol_code"), time_text("ts"),
        *[S.has_flag(F.col("tcp_flags"), b).alias(n) for n, b in S.FLAG_BITS.items()],
    )


# --- adaptation ------------------------------------------------------------
@query
def q_normalize_token(spark, sf):
    line = V.headers(spark, sf)
    return line.select("column", S.normalize_token(F.col("column")).alias("token")).groupBy("column", "token").agg(
        F.count(F.lit(1)).alias("files")
    )


@query
def q_label_isolation(spark, sf):
    table = V.flow_table(spark, sf)
    features, labels = split_labels(table.columns)
    return table.select("row_key", *[c for c in features if c not in ("row_key", "timestamp")])


@query
def q_adapt_alias(spark, sf):
    raw = V.flow_table(spark, sf).select(
        "row_key", F.col("duration").alias("dur_s"), F.col("fwd_pkts").alias("Tot.Fwd-Pkts"),
        F.col("bwd_pkts").alias("BWD_PKTS"), F.col("fwd_bytes").alias("totlen_fwd_pkts"),
        F.col("dst_port").alias("destination port"),
    )
    out = A.adapt(raw, "cicids2017", keep=["row_key"], partial=True)
    return rounded(out.select(*[F.col(f"`{c}`").alias(snake(c)) for c in out.columns]), 6)


@query
def q_adapt_units(spark, sf):
    micro = V.flow_table(spark, sf).select("row_key", (F.col("duration") * 1e6).alias("duration"), "fwd_pkts", "bwd_pkts", "fwd_bytes")
    return rounded(A.adapt(micro, "generalized", keep=["row_key"], partial=True).select("row_key", "duration_seconds"), 6)


@query
def q_adapt_derive_gen(spark, sf):
    raw = V.flow_table(spark, sf).select(
        "row_key", F.col("duration").alias("dur"), F.col("fwd_pkts").alias("spkts"), F.col("bwd_pkts").alias("dpkts"),
        F.col("fwd_bytes").alias("sbytes"), (F.col("bwd_pkts") * 100).alias("dbytes"),
    )
    return rounded(A.adapt(raw, "generalized", keep=["row_key"]), 6, bytes_per_second=2)


@query
def q_adapt_derive_cicids(spark, sf):
    raw = V.flow_table(spark, sf).select(
        "row_key", F.col("duration").alias("Flow Duration"), F.col("fwd_pkts").alias("Total Fwd Packets"),
        F.col("bwd_pkts").alias("Total Backward Packets"), F.col("fwd_bytes").alias("Total Length of Fwd Packets"),
        (F.col("bwd_pkts") * 100).alias("Total Length of Bwd Packets"), (F.col("fwd_pkts") * 20).alias("Fwd Header Length"),
    )
    out = A.adapt(raw, "cicids2017", keep=["row_key"], partial=True)
    return rounded(out.select(*[F.col(f"`{c}`").alias(snake(c)) for c in out.columns]), 6, flow_bytes_s=2)


@query
def q_adapt_derive_unsw(spark, sf):
    raw = V.flow_table(spark, sf).select(
        "row_key", F.col("duration").alias("dur"), F.col("fwd_pkts").alias("src_pkts"), F.col("bwd_pkts").alias("dst_pkts"),
        F.col("fwd_bytes").alias("src_bytes"), (F.col("bwd_pkts") * 100).alias("dst_bytes"),
    )
    return rounded(A.adapt(raw, "unsw-nb15", keep=["row_key"], partial=True), 6, sload=0, dload=0)


@query
def q_adapt_clean(spark, sf):
    rows = V.dirty_table(spark, sf)
    return rows.groupBy("protocol").agg(
        F.round(F.sum(S.clean_double(F.col("bytes"))), 2).alias("bytes"),
        F.round(F.sum(S.clean_double(F.col("packets"))), 2).alias("packets"),
        F.round(F.sum(S.clean_double(F.col("protocol"))), 2).alias("text_as_number"),
    )


@query
def q_adapt_reject(spark, sf):
    rows = V.feature_maps(spark, sf)
    rejected = A.lacks_too_many(F.col("features"), SC.GENERALIZED_FEATURES)
    return rows.select("row_key", F.when(rejected, "rejected").otherwise("accepted").alias("outcome"))


@query
def q_adapt_lenient(spark, sf):
    rows = V.feature_maps(spark, sf)
    return rows.select("row_key", *A.lenient_features(F.col("features"), SC.GENERALIZED_FEATURES))


@query
def q_schema_mapping(spark, sf):
    rows = AU.mapping_rows(V.headers(spark, sf)).where(F.col("status") == "mapped")
    return rows.select("file", "model", "target_feature", "source_feature", "transform_type")


@query
def q_schema_audit(spark, sf):
    return AU.compatibility(V.headers(spark, sf))


@query
def q_schema_choice(spark, sf):
    return AU.choose_schema(V.headers(spark, sf))


@query
def q_schema_requested(spark, sf):
    return AU.choose_schema(V.headers(spark, sf), "UNSW-NB15").select("file", "model", "status", "match_percentage")


@query
def q_schema_missing(spark, sf):
    """Required features a file lacks, per model, as one sorted text."""
    rows = AU.mapping_rows(V.headers(spark, sf)).where((F.col("status") == "missing") & (F.col("model") == "generalized"))
    return rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("target_feature")), ",").alias("missing_features"))


@query
def q_schema_extra(spark, sf):
    """Columns of a file the generalized model does not use, in file order."""
    return AU.extra_columns(V.headers(spark, sf), "generalized").select("file", F.array_join("extra_features", ",").alias("extra_features"))


@query
def q_mapping_search(spark, sf):
    rows = AU.mapping_rows(V.headers(spark, sf)).where(F.col("model") == "generalized")
    q = "alias"
    hit = F.lower("target_feature").contains(q) | F.lower(F.coalesce("source_feature", F.lit(""))).contains(q) \
        | F.lower("transform_type").contains(q) | F.lower("status").contains(q)
    return rows.where(hit).groupBy("target_feature", "source_feature").agg(F.count(F.lit(1)).alias("files"))


# --- profile ---------------------------------------------------------------
@query
def q_prof_missing(spark, sf):
    return P.missing_cells(V.dirty_table(spark, sf))


@query
def q_prof_inf(spark, sf):
    return P.infinite_cells(V.dirty_table(spark, sf))


@query
def q_prof_dups(spark, sf):
    return P.duplicates(V.dirty_table(spark, sf))


@query
def q_prof_numeric(spark, sf):
    return P.numeric_summary(V.flow_table(spark, sf), ["fwd_pkts", "bwd_pkts", "fwd_bytes", "duration", "dst_port"])


@query
def q_prof_protocol(spark, sf):
    return P.protocol_distribution(V.dirty_table(spark, sf), 10)


@query
def q_prof_time(spark, sf):
    rows = P.time_coverage(V.flow_table(spark, sf))
    return rows.select("column", time_text("earliest"), time_text("latest"), "valid_timestamps_count")


@query
def q_prof_labels(spark, sf):
    return P.label_distribution(V.flow_table(spark, sf))


@query
def q_prof_imbalance(spark, sf):
    return P.imbalance_ratio(P.label_distribution(V.flow_table(spark, sf)))


@query
def q_prof_totals(spark, sf):
    return P.quality_totals(V.dirty_table(spark, sf), label="protocol")


@query
def q_prof_warnings(spark, sf):
    return P.quality_warnings(P.quality_totals(V.dirty_table(spark, sf), label="protocol"))


@query
def q_feature_search(spark, sf):
    return P.search_features(P.numeric_summary(V.flow_table(spark, sf), ["fwd_pkts", "bwd_pkts", "fwd_bytes", "duration", "dst_port"]), "PKTS")


# --- behaviour rules -------------------------------------------------------
def flagged(spark, sf):
    return RU.flag_rows(V.flow_table(spark, sf))


def _rule(name: str) -> Query:
    def run(spark, sf):
        return flagged(spark, sf).where(name).select("row_key", F.round("rule_rate", 2).alias("rate"), F.round("rule_volume", 2).alias("volume"))
    return run


for _name in SC.INDICATORS:
    QUERIES[f"q_rule_{_name}"] = _rule(_name)


@query
def q_rule_scan_sources(spark, sf):
    rows = V.flow_table(spark, sf)
    return RU.probing_sources(rows, F.col("src_ip"), RU.number(F.col("dst_port")))


@query
def q_rule_scan_nosrc(spark, sf):
    rows = V.flow_table(spark, sf).drop("src_ip")
    return RU.flag_rows(rows).groupBy("label").agg(F.count_if("scan").alias("probes"), F.count(F.lit(1)).alias("n"))


@query
def q_rule_fan_out_rows(spark, sf):
    """Rows of probing sources, by semi join."""
    rows = V.flow_table(spark, sf)
    probing = RU.probing_sources(rows, F.col("src_ip"), RU.number(F.col("dst_port")))
    return rows.join(probing.withColumnRenamed("probing_source", "src_ip"), "src_ip", "left_semi").groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def q_rule_thresholds(spark, sf):
    rows = V.flow_table(spark, sf)
    inputs = RU.rule_inputs(rows.columns)
    written = RU.measured(rows, inputs)
    limits = RU.thresholds(rows, inputs, written)
    counted = written.agg(F.count(F.lit(1)).alias("total_rows"))
    return counted.select("total_rows", *[F.round(F.lit(v), 2).alias(f"{k}_threshold") for k, v in sorted(limits.items())])


@query
def q_rule_summary(spark, sf):
    return RU.indicator_summary(flagged(spark, sf))


@query
def q_rule_evidence(spark, sf):
    top = RU.top_evidence(RU.with_evidence(flagged(spark, sf)), "row_key")
    return top.select("row_key", "n_flags", F.array_join("indicators", "|").alias("indicators"), "evidence")


@query
def q_evidence_export(spark, sf):
    numeric = ["dst_port", "fwd_pkts", "bwd_pkts", "fwd_bytes", "duration"]
    rows = RU.with_evidence(flagged(spark, sf))
    hits = RU.flagged_evidence(rows.withColumn("key_features", RU.key_features(rows, numeric)))
    return RU.export_evidence(hits, "row_key", "label", numeric)


@query
def q_evidence_search(spark, sf):
    hits = RU.flagged_evidence(RU.with_evidence(flagged(spark, sf)))
    return RU.search_evidence(hits, "Volume", "label").select("row_key", "n_flags")


# --- decisions -------------------------------------------------------------
@query
def q_score(spark, sf):
    """Every scored flow with its secondary telemetry."""
    return V.scored(spark, sf).select(
        "flow_seq", "flow_id", "prediction", "is_attack", "confidence", "attack_probability", "risk_score", "risk_level",
        "prediction_margin", "anomaly_score", "is_anomaly", "generalized_prediction",
    )


@query
def q_risk(spark, sf):
    """Risk bands of scored flows with every band present."""
    return R.risk_distribution(V.scored(spark, sf))


@query
def q_risk_from_benign(spark, sf):
    p = S.attack_probability(F.lit(1.3) - F.col("attack_prob") * 1.6)
    rows = V.labelled(spark, sf).select("row_key", p.alias("p"))
    return rows.select(
        "row_key", F.round("p", 4).alias("attack_probability"), S.risk_score(F.col("p")).alias("risk_score"),
        S.risk_level(S.risk_score(F.col("p"))).alias("risk_level"),
    )


@query
def q_severity(spark, sf):
    return V.predictions(spark, sf).groupBy("risk_level").agg(
        F.max(S.incident_severity(F.col("risk_level"))).alias("incident_severity"),
        F.max(S.alert_severity(F.col("risk_level"))).alias("alert_severity"), F.count(F.lit(1)).alias("n"),
    )


@query
def q_alert(spark, sf):
    return V.predictions(spark, sf).select("prediction_id", *[v.alias(k) for k, v in D.alert_columns().items()])


@query
def q_isolation_prob(spark, sf):
    rows = V.labelled(spark, sf).select("row_key", (F.lit(0.3) - F.col("attack_prob") * 0.7).alias("s"))
    return D.decide_isolation(rows, "s").drop("s")


@query
def q_binary_decision(spark, sf):
    rows = V.labelled(spark, sf).select("row_key", F.when(F.col("dst_port") != 3, F.col("attack_prob")).alias("p"))
    return D.decide_binary(rows, "p", "generalized").drop("p")


@query
def q_fallback_dist(spark, sf):
    """One attack probability spread over ten classes, then the multiclass decision."""
    rows = V.labelled(spark, sf).select("row_key", (F.col("attack_prob") * 1.05).alias("p"))
    probs = S.spread_binary(F.col("p"), SC.UNSW_CLASSES, "Normal")
    out = D.decide_multiclass(rows.withColumn("probs", probs), "probs", "unsw-nb15")
    return out.select(
        "row_key", "prediction", "is_attack", "confidence", "attack_probability", "risk_score", "risk_level",
        "prediction_margin", F.round(F.get("probs", F.lit(0)), 4).alias("p_first"), F.round(F.get("probs", F.lit(6)), 4).alias("p_normal"),
    )


@query
def q_threshold_dim(spark, sf):
    return D.early_warning(V.predictions(spark, sf)).groupBy("dataset", "decision_threshold").agg(
        F.count_if("early_warning").alias("warned"), F.count_if("is_attack").alias("attacks"), F.count(F.lit(1)).alias("n")
    )


@query
def q_top_features(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.generalized_columns())
    return rows.select("flow_seq", F.inline(X.top_features("generalized")))


@query
def q_instance_attr(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.generalized_columns())
    return X.explain_rows(rows, "generalized", "flow_seq", keep=5).drop("description")


@query
def q_attr_lookup(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.generalized_columns())
    values = X.unpivot_features(rows, "flow_seq", SC.GENERALIZED_FEATURES)
    return X.attribution_lookup(values, "isolation_forest").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("importance"), 4).alias("max_importance"), F.round(F.min("importance"), 4).alias("min_importance")
    )


@query
def q_global_attr(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.generalized_columns())
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("attribution")) for k, v in D.logistic_attributions().items()])
    return X.global_ranking(rows.select(F.inline(cells)))


@query
def q_attr_search(spark, sf):
    rows = V.flows(spark, sf).select("flow_seq", *FL.generalized_columns())
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("attribution")) for k, v in D.logistic_attributions().items()])
    return X.search_attributions(X.global_ranking(rows.select(F.inline(cells))), "BYTES").select("feature", "mean_abs")


@query
def q_recommend(spark, sf):
    rows = X.recommend(V.scored(spark, sf))
    return rows.select("flow_seq", "prediction", F.array_join("recommendations", " ").alias("recommendations"))


# --- incidents -------------------------------------------------------------
def _incident_view(df: DataFrame) -> DataFrame:
    return df.select(
        "title", "status", "severity", "src_ip", "dst_ip", "attack_category", "flow_count", "risk_score",
        time_text("first_seen"), time_text("last_seen"), "notes", "analyst",
    )


def _stored(spark, sf):
    """Scored flows as the stored table incidents are made from."""
    columns = ["flow_seq", "src_ip", "dst_ip", "is_attack", "is_anomaly", "prediction", "risk_score", "source_type", "dataset", "timestamp"]
    return materialize(V.scored(spark, sf).select(*columns), "scored-flows")


def _halves(scored):
    early = F.col("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    return I.correlate(scored.where(early)), I.correlate(scored.where(~early))


def _existing(first):
    """Incidents of the first half, some of them already resolved."""
    done = F.col("flow_count") % 3 == 0
    return first.withColumn("status", F.when(done, "Resolved").when(F.col("flow_count") % 3 == 1, "Investigating").otherwise("New"))


@query
def q_incidents(spark, sf):
    return _incident_view(I.correlate(V.scored(spark, sf)))


@query
def q_incident_upsert(spark, sf):
    first, second = _halves(_stored(spark, sf))
    existing = _existing(first)
    # some keys have a second open incident; the older one takes what is new
    again = existing.where((F.col("status") != "Resolved") & (F.col("flow_count") % 5 == 0)).withColumns({
        "incident_id": F.concat("incident_id", F.lit("-2")), "title": F.concat("title", F.lit(" (2)")),
        "first_seen": F.col("first_seen") + F.expr("INTERVAL 1 HOUR"),
    })
    return _incident_view(I.upsert(existing.unionByName(again), second))


@query
def q_incident_list(spark, sf):
    return _incident_view(I.list_incidents(I.correlate(V.scored(spark, sf)), status="New", severity="Critical", limit=20))


@query
def q_incident_get(spark, sf):
    rows = I.correlate(V.scored(spark, sf))
    key = S.hashed_id("inc", F.col("src_ip"), F.col("attack_category"), F.col("first_seen"))
    return _incident_view(rows.where(F.col("incident_id") == key).where(F.col("src_ip") == "10.0.0.7"))


@query
def q_incident_triage(spark, sf):
    existing = _existing(_halves(_stored(spark, sf))[0])
    n = F.col("flow_count")
    updates = existing.where(n % 2 == 0).select(
        "incident_id", F.col("last_seen").alias("updated_at"), F.when(n % 4 == 0, "Acknowledged").otherwise("").alias("status"),
        F.when(n % 6 == 0, F.lit("checked")).alias("notes"), F.lit("ana").alias("analyst"),
    )
    later = updates.select(
        "incident_id", (F.col("updated_at") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"), F.lit(None).cast("string").alias("status"),
        F.lit("second note").alias("notes"), F.lit("").alias("analyst"),
    ).where(F.col("notes").isNotNull())
    return _incident_view(I.triage(existing, updates.unionByName(later)))


@query
def q_incident_attr(spark, sf):
    rows = X.incident_attributions(I.correlate(V.scored(spark, sf)), "cicids2017")
    return rows.groupBy("feature", "base").agg(F.count(F.lit(1)).alias("incidents"), F.sum("flow_count").alias("flows"))


# --- reports ---------------------------------------------------------------
@query
def q_batch_summary(spark, sf):
    return R.batch_summary(V.scored(spark, sf))


@query
def q_job_summary(spark, sf):
    return R.job_summaries(V.scored(spark, sf))


@query
def q_category_dist(spark, sf):
    return R.category_distribution(V.scored(spark, sf))


@query
def q_summary_maps(spark, sf):
    rows = R.summary_with_maps(V.scored(spark, sf))
    def text(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumns({"category_distribution": text("category_distribution"), "risk_distribution": text("risk_distribution")})


@query
def q_summary_json(spark, sf):
    """The risk map encoded to JSON for the sink and decoded again."""
    rows = R.summary_with_maps(V.scored(spark, sf)).select(F.to_json("risk_distribution").alias("j"))
    return rows.select(F.explode(F.from_json("j", "map<string,long>")).alias("risk_level", "n"))


def _alerts(spark, sf):
    return R.alert_rows(V.predictions(spark, sf), V.scored(spark, sf))


@query
def q_alert_union(spark, sf):
    return _alerts(spark, sf).groupBy("dataset", "input_source", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("risk_score"), 2).alias("risk")
    )


@query
def q_dashboard(spark, sf):
    return R.dashboard(_alerts(spark, sf), "CICIDS2017")


@query
def q_recent_alerts(spark, sf):
    return R.recent(_alerts(spark, sf), "timestamp", "record_id", 15).withColumn("timestamp", S.iso_time(F.col("timestamp")))


@query
def q_history(spark, sf):
    rows = R.history(V.predictions(spark, sf), dataset="unsw", risk_level="High", limit=40)
    return rows.select("prediction_id", time_text("timestamp"), "prediction", "risk_score")


@query
def q_analysis_summary(spark, sf):
    return R.analysis_summary(V.predictions(spark, sf))


@query
def q_warnings(spark, sf):
    return R.warnings(V.predictions(spark, sf))


@query
def q_paging(spark, sf):
    rows = R.page(V.predictions(spark, sf), 3, 50)
    return rows.select(F.col("record_id").cast("long").alias("record_id"), "prediction_id", "warning", "risk_score")


@query
def q_paging_deep(spark, sf):
    """A page far into the history, read from one range of the indexed history."""
    path = scratch_path(spark, "history")
    R.page_index(V.predictions(spark, sf), path, 1000)
    rows = R.deep_page(spark, path, 115, 50)
    return rows.select(F.col("record_id").cast("long").alias("record_id"), "prediction_id", "warning", "risk_score")


@query
def q_search(spark, sf):
    return R.search_flows(V.scored(spark, sf), " XSS ", "high_risk").select("flow_seq", "src_ip", "dst_ip", "prediction")


@query
def q_search_port(spark, sf):
    return R.search_flows(V.scored(spark, sf), "4001", "tcp").select("flow_seq", "src_port", "dst_port")


@query
def q_alert_search(spark, sf):
    return R.search_alerts(V.predictions(spark, sf), "Scan").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query
def q_tab_counts(spark, sf):
    return R.tab_counts(V.scored(spark, sf))


@query
def q_job_flows(spark, sf):
    return R.flows_of_job(V.scored(spark, sf), "job-3").select("flow_seq", "src_ip", "prediction", "risk_score")


@query
def q_recent_flows(spark, sf):
    return R.recent_flows(V.scored(spark, sf), "live", 30).select("flow_seq", time_text("timestamp"), "prediction")


@query
def q_last_flows(spark, sf):
    return R.last_flows(V.scored(spark, sf), 25).select("flow_seq", time_text("timestamp"))


@query
def q_session_counters(spark, sf):
    return R.session_counters(V.scored(spark, sf))


@query
def q_export(spark, sf):
    return R.export_results(V.scored(spark, sf))


# --- evaluation ------------------------------------------------------------
@query
def q_class_dist(spark, sf):
    return E.class_distribution(V.labelled(spark, sf), "actual")


@query
def q_class_weights(spark, sf):
    return E.class_weights(V.labelled(spark, sf), "actual", cap=1.0)


@query
def q_confusion(spark, sf):
    out = E.confusion_matrix(V.labelled(spark, sf), V.ACTUAL)
    return out.select(*[F.col(f"`{c}`").alias(snake(c)) for c in out.columns])


@query
def q_confusion_norm(spark, sf):
    out = E.normalized_confusion(V.labelled(spark, sf), V.ACTUAL)
    return out.select(*[F.col(f"`{c}`").alias(snake(c)) for c in out.columns])


@query
def q_class_report(spark, sf):
    return E.classification_report(V.labelled(spark, sf))


@query
def q_top_confusions(spark, sf):
    return E.top_confusions(V.labelled(spark, sf), 3)


@query
def q_binary_metrics(spark, sf):
    return E.binary_metrics(V.labelled(spark, sf), is_attack(), "attack_prob", 0.5)


@query
def q_cell_percent(spark, sf):
    return E.cell_percentages(E.binary_metrics(V.labelled(spark, sf), is_attack(), "attack_prob", 0.5))


@query
def q_threshold_sweep(spark, sf):
    return E.threshold_sweep(V.labelled(spark, sf), is_attack(), "attack_prob", 50, 99, 1)


@query
def q_threshold_sweep_coarse(spark, sf):
    return E.threshold_sweep(V.labelled(spark, sf), is_attack(), "attack_prob", 10, 95, 5)


@query
def q_best_threshold(spark, sf):
    return E.best_threshold(E.threshold_sweep(V.labelled(spark, sf), is_attack(), "attack_prob", 10, 95, 5))


@query
def q_detection_rate(spark, sf):
    return E.detection_rates(V.labelled(spark, sf).where(is_attack()), "actual", "attack_prob", 0.5)


@query
def q_fn_by_cat(spark, sf):
    return E.false_negatives(V.labelled(spark, sf).where(is_attack()), "actual", "attack_prob", 0.5)


@query
def q_classwise_risk(spark, sf):
    return E.classwise_risk(V.labelled(spark, sf))


@query
def q_auc(spark, sf):
    return E.roc_auc(V.labelled(spark, sf), is_attack(), "attack_prob")


def _odds(spark, sf):
    rows = V.labelled(spark, sf).where((F.col("attack_prob") > 0) & (F.col("attack_prob") < 1))
    return rows.withColumns({"odds": F.log(F.col("attack_prob") / (1.0 - F.col("attack_prob"))), "depth": -F.sqrt("fwd_bytes")})


@query
def q_auc_scales(spark, sf):
    """AUC of scores that are no probabilities: log odds, and a measure below zero."""
    rows = _odds(spark, sf)
    return E.roc_auc(rows, is_attack(), "odds").withColumn("scale", F.lit("log odds")).unionByName(
        E.roc_auc(rows, is_attack(), "depth").withColumn("scale", F.lit("depth"))
    )


@query
def q_threshold_sweep_odds(spark, sf):
    return E.sweep_at(_odds(spark, sf), is_attack(), "odds", [-3.0, -1.0, -0.5, 0.25, 1.0, 2.0])


@query
def q_scan_sketches(spark, sf):
    """Ports a source from sketches kept by month, stored and merged."""
    path = scratch_path(spark, "port-sketches")
    rows = V.flow_table(spark, sf)
    SKE.write_periods(SKE.source_sketches(rows, F.trunc("timestamp", "month"), F.col("src_ip"), F.col("dst_port")), path)
    found = SKE.distinct_ports(spark.read.parquet(path), RU.SCAN_PORTS)
    return found.select(F.col("source").alias("probing_source"), "ports")


@query
def q_threshold_sketches(spark, sf):
    """Quartiles of the rules' measures from sketches kept by month, held against exact ranks."""
    path = scratch_path(spark, "measure-sketches")
    rows = V.flow_table(spark, sf)
    inputs = RU.rule_inputs(rows.columns)
    measures = {"dos": inputs.rate, "exfil": inputs.volume}
    SKE.write_periods(SKE.measure_sketches(rows, F.trunc("timestamp", "month"), measures), path)
    shares = [0.25, 0.75]
    stored = spark.read.parquet(path)
    found = SKE.quantiles(stored, shares)
    months = stored.groupBy("measure").agg(F.count(F.lit(1)).alias("months"))
    near = {r["measure"]: r["q"] for r in found.collect()}
    ranks = rows.agg(*[
        F.array(*[(F.count_if(v < near[m][i]) <= (p + 0.01) * F.count(v)) & (F.count_if(v <= near[m][i]) >= (p - 0.01) * F.count(v))
                  for i, p in enumerate(shares)]).alias(m) for m, v in measures.items()
    ]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m)[0].alias("low_ok"), F.col(m)[1].alias("high_ok")) for m in measures])))
    return found.select("measure", "n").join(months, "measure").join(ranks, "measure")


@query
def q_feature_means(spark, sf):
    rows = V.labelled(spark, sf).where(F.col("actual") == "Bot")
    return E.feature_means(rows, F.col("attack_prob") >= 0.5, ["fwd_pkts", "bwd_pkts", "fwd_bytes", "duration"])


@query
def q_calibrate(spark, sf):
    return E.calibrate(V.labelled(spark, sf), is_attack(), "attack_prob", [0.01, 0.1])


@query
def q_stratified_split(spark, sf):
    return E.stratified_split(V.labelled(spark, sf), "actual", "row_key").select("row_key", "actual", "split")


@query
def q_split_dist(spark, sf):
    return E.split_distribution(E.stratified_split(V.labelled(spark, sf), "actual", "row_key"), "actual")

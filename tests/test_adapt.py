import math

import pytest
from pyspark.sql import functions as F

from flowlens import schemas as SC
from flowlens.operators import adapt as A
from flowlens.operators import audit as AU
from flowlens.plans import mapping as MP


def table(spark, names, rows):
    return spark.createDataFrame(rows, [f"c{i}" for i in range(len(names))]).toDF(*names)


def test_alias_table_sizes():
    assert {m: sum(len(v) for v in t.values()) for m, t in SC.ALIASES.items()} == {"cicids": 262, "unsw": 55, "generalized": 97}
    assert all(set(SC.ALIASES[m]) <= set(SC.FEATURES[m]) for m in SC.FEATURES)


def test_exact_schema_isolates_label(spark):
    names = SC.CICIDS_FEATURES + ["Label"]
    plan = MP.resolve(names, "cicids")
    assert (plan.status, plan.match_percentage, plan.extra) == (SC.EXACT_MATCH, 100.0, [])
    out = A.adapt(table(spark, names, [tuple(float(i) for i in range(70)) + ("BENIGN",)]), "cicids2017")
    assert out.columns == SC.CICIDS_FEATURES
    assert MP.split_labels(["Label", "label", "x"]) == (["x"], ["Label", "label"])


def test_exact_unsw(spark):
    names = SC.UNSW_FEATURES + ["attack_cat", "label"]
    assert MP.choose_model(names)[0] == "unsw"
    assert A.adapt(table(spark, names, [(1.0,) * 42 + ("DoS", 1)]), "UNSW-NB15").columns == SC.UNSW_FEATURES


def test_aliased_schema():
    rename = {"Destination Port": "dst_port", "Flow Duration": "flow_duration", "Total Fwd Packets": "tot_fwd_pkts",
              "Total Backward Packets": "tot_bwd_pkts", "Total Length of Fwd Packets": "totlen_fwd_pkts",
              "Total Length of Bwd Packets": "totlen_bwd_pkts", "Flow Bytes/s": "flow_byts_s", "Flow Packets/s": "flow_pkts_s",
              "FIN Flag Count": "fin_flag_cnt", "SYN Flag Count": "syn_flag_cnt", "RST Flag Count": "rst_flag_cnt",
              "PSH Flag Count": "psh_flag_cnt", "ACK Flag Count": "ack_flag_cnt"}
    plan = MP.resolve([rename.get(f, f) for f in SC.CICIDS_FEATURES], "cicids")
    assert plan.status == SC.TRANSFORMABLE and len(plan.sources) - plan.matched >= 10


def test_case_differences_still_match_exactly():
    assert MP.resolve([f.upper() for f in SC.UNSW_FEATURES], "unsw").status == SC.EXACT_MATCH


@pytest.mark.parametrize("name,value,want", [("Flow Duration", 0.0015, 1500.0), ("flow_duration_us", 0.0015, 0.0015),
                                             ("dur_s", 2.0, 2_000_000.0), ("Flow Duration", 800.0, 800.0)])
def test_duration_units(spark, name, value, want):
    names = [name if f == "Flow Duration" else f for f in SC.CICIDS_FEATURES]
    row = A.adapt(table(spark, names, [tuple(value if n == name else 1.0 for n in names)]), "cicids2017").first()
    assert row["Flow Duration"] == pytest.approx(want)


def test_duration_unit_is_the_tables_not_the_rows(spark):
    names = ["duration", "spkts", "dpkts", "sbytes", "dbytes"]
    rows = [(60_000.0, 1.0, 1.0, 1.0, 1.0), (2.0, 1.0, 1.0, 1.0, 1.0)]
    got = sorted(r.duration_seconds for r in A.adapt(table(spark, names, rows), "generalized").collect())
    assert got == pytest.approx([2e-6, 0.06])
    kept = sorted(r.duration_seconds for r in A.adapt(table(spark, names, rows), "generalized", duration_unit="s").collect())
    assert kept == [2.0, 60_000.0]


def test_derivable_cicids(spark):
    derived = set(SC.DERIVABLE["cicids"]) - {"Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s"}
    names = [f for f in SC.CICIDS_FEATURES if f not in derived]
    values = {"Total Fwd Packets": 20.0, "Total Backward Packets": 5.0, "Total Length of Fwd Packets": 1000.0,
              "Total Length of Bwd Packets": 500.0, "Fwd Header Length": 64.0}
    assert len(names) == 61
    row = A.adapt(table(spark, names, [tuple(values.get(n, 1.0) for n in names)]), "cicids2017").first()
    want = {"Average Packet Size": 60, "Avg Fwd Segment Size": 50, "Avg Bwd Segment Size": 100, "Down/Up Ratio": 0.25,
            "Subflow Fwd Packets": 20, "Subflow Fwd Bytes": 1000, "Subflow Bwd Packets": 5, "Subflow Bwd Bytes": 500,
            "Fwd Header Length.1": 64}
    assert {k: row[k] for k in want} == want


def test_generalized_from_five_columns(spark):
    rows = [(0.1, 4, 3, 300, 600), (120.0, 20, 0, 1200, 0), (2.5, 10, 8, 800, 1500)]
    out = A.adapt(table(spark, ["dur", "spkts", "dpkts", "sbytes", "dbytes"], rows), "generalized")
    assert out.columns == SC.GENERALIZED_FEATURES
    row = out.where("duration_seconds = 120").first()
    assert (row.total_packets, row.total_bytes, row.bytes_per_second, row.average_packet_size) == (20, 1200, 10, 60)
    assert row.packets_per_second == pytest.approx(1 / 6)


@pytest.mark.parametrize("names", [
    SC.CICIDS_FEATURES[:35],
    ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp", "duration", "fwd_pkts_x", "state", "label"],
    ["host_score", "connection_confidence", "model_prediction", "cpu_load", "memory_free_pct"],
    ["ip_src", "ip_dst", "port", "bytes", "packets"],
])
def test_unsupported_inputs(spark, names):
    model, plan = MP.choose_model(names)
    assert plan.status == SC.UNSUPPORTED and plan.missing
    with pytest.raises(ValueError):
        A.adapt(table(spark, names, [(1.0,) * len(names)]), "cicids2017")


def test_renamed_input_gives_the_same_values(spark):
    base = [(float(i), i * 3.0, i * 2.0, i * 100.0, i * 50.0) for i in range(1, 20)]
    a = A.adapt(table(spark, ["dur", "spkts", "dpkts", "sbytes", "dbytes"], base), "generalized")
    b = A.adapt(table(spark, ["Duration_Sec", "FWD.PKTS", "bwd-packets", "total_fwd_bytes", "totlen_bwd_pkts"], base), "generalized")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bad_cells_become_zero(spark):
    df = table(spark, ["dur", "spkts", "dpkts", "sbytes", "dbytes"],
               [("1.0", "x", "2", None, "inf"), ("nan", "4", "5", "6", "-inf")])
    rows = sorted(map(tuple, A.adapt(df, "generalized").select("duration_seconds", "forward_packets", "forward_bytes", "backward_bytes").collect()))
    assert rows == [(0.0, 4.0, 6.0, 0.0), (1.0, 0.0, 0.0, 0.0)]


def test_names_differing_in_case_only(spark):
    df = table(spark, ["dur", "Spkts", "SPKTS", "dpkts", "sbytes", "dbytes", "a.b"], [(1.0, 2.0, 9.0, 3.0, 4.0, 5.0, 6.0)])
    row = A.adapt(df, "generalized", keep=["a.b"]).first()
    assert (row.forward_packets, row["a.b"]) == (9.0, 6.0)  # the last of equally folded names counts


def test_repeated_header_names():
    assert MP.unique_names(["A", " X", "X ", "X"]) == ["A", "X", "X.1", "X.2"]
    assert MP.unique_names(["X", "X", "X.1"]) == ["X", "X.2", "X.1"]


def test_validate_and_reject(spark):
    with pytest.raises(ValueError):
        A.validate(spark.createDataFrame([(1.0,)], ["dur"]), "unsw")
    full = {f: "1" for f in SC.GENERALIZED_FEATURES}
    two = dict(list(full.items())[2:])
    three = {k.upper(): v for k, v in list(full.items())[3:]}
    df = spark.createDataFrame([(1, full), (2, two), (3, three)], "id int, features map<string,string>")
    accepted, rejected = A.split_incomplete(df, SC.GENERALIZED_FEATURES)
    assert {r.id for r in accepted.collect()} == {1, 2} and {r.id for r in rejected.collect()} == {3}
    row = df.where("id = 2").select(*A.lenient_features(F.col("features"), SC.GENERALIZED_FEATURES)).first()
    assert row.duration_seconds == 0.0 and row.total_bytes == 1.0


def test_audit_agrees_with_plan_time_resolution(spark):
    files = {
        "a": SC.CICIDS_FEATURES + ["Label"], "b": ["dur", "spkts", "dpkts", "sbytes", "dbytes"], "c": ["x", "label"],
        "d": [f.upper() for f in SC.UNSW_FEATURES], "e": ["Flow.Duration", "tot_fwd_pkts", "Total-Backward-Packets", "fwd_header_len"],
    }
    rows = [(f, i, c) for f, names in files.items() for i, c in enumerate(names)]
    headers = spark.createDataFrame(rows, "file string, position int, column string")
    audit = {(r.file, r.model): r for r in AU.compatibility(headers).collect()}
    mapped = {(r.file, r.model, r.target_feature): (r.source_feature, r.transform_type) for r in AU.mapping_rows(headers).collect()}
    for file, names in files.items():
        for model in SC.FEATURES:
            plan = MP.resolve(names, model)
            got = audit[file, model]
            assert (got.status, got.missing, got.derived, got.matched) == (plan.status, len(plan.missing), len(plan.derived), plan.matched)
            assert got.match_percentage == pytest.approx(plan.match_percentage)
            for target, (source, how) in plan.sources.items():
                assert mapped[file, model, target] == (source, how)
    chosen = {r.file: r for r in AU.choose_schema(headers).collect()}
    for file, names in files.items():
        model, plan = MP.choose_model(names)
        assert (chosen[file].model, chosen[file].status) == (model, plan.status)
    assert "100% compatible with CICIDS2017" in chosen["a"].explanation
    asked = {r.file: r.status for r in AU.choose_schema(headers, "unsw").collect()}
    assert asked["a"] == SC.UNSUPPORTED and asked["d"] == SC.EXACT_MATCH


def test_dataset_names():
    assert SC.resolve_dataset(" Isolation-Forest ") == "isolation_forest"
    assert SC.resolve_dataset("Generalized-XGB") == "generalized"
    assert SC.resolve_dataset("UNSW_NB15") == "unsw-nb15" and SC.resolve_dataset("CICIDS2017") == "cicids2017"
    with pytest.raises(ValueError):
        SC.resolve_dataset("other")
    assert not math.isnan(SC.THRESHOLDS["generalized"])

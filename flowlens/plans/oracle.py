"""SQL for the registered queries, written independently of the operators, for DuckDB over the same tables."""

from __future__ import annotations

import re

from flowlens import schemas as SC
from flowlens.operators.decide import LOGISTIC, LOGISTIC_BIAS
from flowlens.plans.mapping import name_rules
from flowlens.plans.views import ACTUAL, HEADER_NAMES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


# --- shared table expressions ----------------------------------------------
CTE: dict[str, tuple[list[str], str]] = {}

CTE["packets"] = ([], """
  SELECT event_id AS packet_seq, ts, epoch_us(ts) AS t,
    CASE WHEN answer THEN server_ip ELSE client_ip END AS src_ip,
    CASE WHEN answer THEN client_ip ELSE server_ip END AS dst_ip,
    CASE WHEN answer THEN server_port ELSE client_port END AS src_port,
    CASE WHEN answer THEN client_port ELSE server_port END AS dst_port,
    CASE WHEN k % 4 = 3 THEN 'UDP' ELSE 'TCP' END AS proto,
    40 + CAST(floor(value) AS BIGINT) AS pkt_len,
    CASE WHEN k % 4 = 3 THEN 0 WHEN event_type = 'signup' THEN 17 WHEN event_type = 'error' THEN 4
         WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 16 WHEN event_type = 'purchase' THEN 24
         ELSE 0 END AS tcp_flags,
    CASE WHEN k % 4 = 3 THEN 0 ELSE 1000 + k END AS win_size,
    CASE WHEN k % 4 = 3 THEN 8 ELSE 20 END AS header_len
  FROM (SELECT *, event_type IN ('view', 'purchase') AS answer,
      '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip, 40000 + user_id % 1000 AS client_port,
      '172.16.0.' || (k % 8) AS server_ip,
      CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 53 END AS server_port
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))""")

CTE["keyed"] = (["packets"], """
  SELECT *, CASE WHEN low THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN low THEN dst_ip ELSE src_ip END AS ip_b,
    CASE WHEN low THEN src_port ELSE dst_port END AS port_a, CASE WHEN low THEN dst_port ELSE src_port END AS port_b,
    (tcp_flags & 5) <> 0 AS term
  FROM (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS low FROM packets)""")

CTE["segments"] = (["keyed"], """
  SELECT *, coalesce(sum(CASE WHEN term THEN 1 ELSE 0 END) OVER (
      PARTITION BY ip_a, ip_b, port_a, port_b, proto ORDER BY packet_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM keyed""")

CTE["idle"] = (["segments"], """
  SELECT *, sum(CASE WHEN t - seen >= 86400000000 THEN 1 ELSE 0 END) OVER (
      PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg ORDER BY packet_seq) AS part
  FROM (SELECT *, max(t) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg ORDER BY packet_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM segments)""")

_FLOW_WINDOW = "PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg ORDER BY packet_seq"
CTE["assigned"] = (["segments"], f"""
  SELECT *, src_ip = init_ip AND src_port = init_port AS is_fwd
  FROM (SELECT *, first_value(packet_seq) OVER w AS flow_seq, first_value(t) OVER w AS start_t,
      first_value(src_ip) OVER w AS init_ip, first_value(src_port) OVER w AS init_port,
      first_value(dst_ip) OVER w AS resp_ip, first_value(dst_port) OVER w AS resp_port
    FROM segments WINDOW w AS ({_FLOW_WINDOW}))""")

CTE["gaps"] = (["assigned"], """
  SELECT *, t - lag(t) OVER (PARTITION BY flow_seq ORDER BY t, packet_seq) AS gap,
    t - lag(t) OVER (PARTITION BY flow_seq, is_fwd ORDER BY t, packet_seq) AS dir_gap
  FROM assigned""")


def _stats() -> str:
    out = []
    for name, expr, cond in (("len", "pkt_len", "true"), ("fwd_len", "pkt_len", "is_fwd"), ("bwd_len", "pkt_len", "NOT is_fwd"),
                             ("gap", "gap", "true"), ("fwd_gap", "dir_gap", "is_fwd"), ("bwd_gap", "dir_gap", "NOT is_fwd")):
        for stat, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"), ("total", "sum")):
            out.append(f"coalesce(CAST({fn}({expr}) FILTER (WHERE {cond}) AS DOUBLE), 0.0) AS {name}_{stat}")
    for flag, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("ece", 64), ("cwe", 128)):
        out.append(f"count(*) FILTER (WHERE tcp_flags & {bit} <> 0) AS {flag}_count")
    return ",\n    ".join(out)


CTE["flows"] = (["gaps"], f"""
  SELECT *, greatest(1e-6, (last_t - start_t) / 1000000.0) AS seconds, fwd_packets + bwd_packets AS packets,
    fwd_bytes + bwd_bytes AS bytes, reason <> 'active' AS is_terminated,
    'flow-' || sha256(concat_ws('|', ip_a, ip_b, port_a, port_b, proto, flow_seq)) AS flow_id
  FROM (SELECT flow_seq, any_value(ip_a) AS ip_a, any_value(ip_b) AS ip_b, any_value(port_a) AS port_a,
    any_value(port_b) AS port_b, any_value(proto) AS proto, any_value(init_ip) AS src_ip, any_value(resp_ip) AS dst_ip,
    any_value(init_port) AS src_port, any_value(resp_port) AS dst_port, any_value(start_t) AS start_t, max(t) AS last_t,
    CASE WHEN arg_max(tcp_flags, packet_seq) & 1 <> 0 THEN 'tcp_fin'
         WHEN arg_max(tcp_flags, packet_seq) & 4 <> 0 THEN 'tcp_rst' ELSE 'active' END AS reason,
    count(*) FILTER (WHERE is_fwd) AS fwd_packets, count(*) FILTER (WHERE NOT is_fwd) AS bwd_packets,
    CAST(coalesce(sum(pkt_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fwd_bytes,
    CAST(coalesce(sum(pkt_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bwd_bytes,
    CAST(coalesce(sum(header_len) FILTER (WHERE is_fwd), 0) AS BIGINT) AS fwd_header,
    CAST(coalesce(sum(header_len) FILTER (WHERE NOT is_fwd), 0) AS BIGINT) AS bwd_header,
    coalesce(arg_min(win_size, packet_seq) FILTER (WHERE is_fwd AND win_size > 0), 0) AS fwd_window,
    coalesce(arg_min(win_size, packet_seq) FILTER (WHERE NOT is_fwd AND win_size > 0), 0) AS bwd_window,
    coalesce(CAST(var_pop(pkt_len) AS DOUBLE), 0.0) AS len_var,
    coalesce(CAST(min(t) FILTER (WHERE is_fwd AND dir_gap IS NOT NULL) - min(t) FILTER (WHERE is_fwd) AS DOUBLE), 0.0) AS first_fwd_gap,
    {_stats()}
  FROM gaps GROUP BY flow_seq)""")

CTE["gen"] = (["flows"], """
  SELECT *, seconds AS duration_seconds, CAST(fwd_packets AS DOUBLE) AS forward_packets,
    CAST(bwd_packets AS DOUBLE) AS backward_packets, CAST(fwd_bytes AS DOUBLE) AS forward_bytes,
    CAST(bwd_bytes AS DOUBLE) AS backward_bytes, CAST(packets AS DOUBLE) AS total_packets,
    CAST(bytes AS DOUBLE) AS total_bytes, packets / seconds AS packets_per_second, bytes / seconds AS bytes_per_second,
    len_mean AS average_packet_size
  FROM flows""")

_LOGIT = " + ".join([str(LOGISTIC_BIAS)] + [f"({w}) * (ln(1 + {f}) - {m})" for f, (w, m) in LOGISTIC.items()])
_BAND = "CASE WHEN risk_score < 30 THEN 'Low' WHEN risk_score < 60 THEN 'Moderate' WHEN risk_score < 80 THEN 'High' ELSE 'Critical' END"
CTE["scored"] = (["gen"], f"""
  SELECT *, {_BAND} AS risk_level, anomaly_score < 0.02341647 AS is_anomaly,
    CASE WHEN NOT is_attack THEN 'BENIGN' WHEN dst_port = 80 THEN 'DDoS' WHEN dst_port = 443 THEN 'Web Attack - XSS'
         WHEN dst_port = 22 THEN 'Bot' WHEN dst_port = 53 THEN 'PortScan' ELSE 'Infiltration' END AS prediction
  FROM (SELECT *, p >= 0.5 AS is_attack, round(p, 4) AS attack_probability, round(greatest(p, 1 - p), 4) AS confidence,
      round(abs(p * 2 - 1), 4) AS prediction_margin, round(p * 100, 2) AS risk_score,
      round(0.3 - ln(1 + total_bytes) / 25.0, 4) AS anomaly_score,
      CASE WHEN p >= 0.1743 THEN 'Attack' ELSE 'Normal' END AS generalized_prediction, 'CICIDS2017' AS dataset,
      CASE flow_seq % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'pcap' ELSE 'live' END AS source_type,
      'job-' || (flow_seq % 7) AS job_id, 'mon-' || (flow_seq % 5) AS session_id, make_timestamp(start_t) AS ts,
      proto AS protocol
    FROM (SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS p FROM gen))""")

_KEY = ("l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
        "CAST(round(l_extendedprice * 100) AS BIGINT)")
_FLOW_COLS = f"""{_KEY} AS row_key, CAST(l_partkey % 16 AS INTEGER) AS dst_port, l_quantity AS fwd_pkts,
    CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS bwd_pkts,
    CASE WHEN l_partkey % 200 = 0 THEN l_extendedprice * 2000 ELSE l_extendedprice * 10 END AS fwd_bytes,
    l_tax AS duration, CASE WHEN l_linestatus = 'O' THEN 'TCP' ELSE 'UDP' END AS protocol, l_returnflag AS label"""

CTE["flow_table"] = ([], f"""
  SELECT {_FLOW_COLS}, 'c' || o_custkey AS src_ip, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

CTE["dirty"] = ([], """
  SELECT l_orderkey AS flow_key, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS packets,
    CASE WHEN l_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN l_partkey % 17 = 0 THEN 'inf'::DOUBLE
         WHEN l_partkey % 19 = 0 THEN '-inf'::DOUBLE ELSE l_extendedprice END AS bytes,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_linestatus END AS protocol
  FROM lineitem, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR l_orderkey % 5 = 0""")

_NAMES = text_list(ACTUAL)
CTE["labelled"] = ([], f"""
  SELECT *, {_NAMES}[CAST(cls AS INTEGER) + 1] AS actual, {_NAMES}[CAST(shifted AS INTEGER) + 1] AS predicted,
    round(CASE WHEN shifted = 0 THEN noise * 8 / 1000 ELSE 0.35 + noise / 100 END, 4) AS attack_prob,
    round(0.5 + noise / 125, 4) AS confidence, round(noise / 62.5, 4) AS margin
  FROM (SELECT *, (cls + CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 1 ELSE 0 END) % 5 AS shifted
    FROM (SELECT {_FLOW_COLS}, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_linestatus, l_partkey % 5 AS cls,
      l_quantity + l_discount * 100 AS noise FROM lineitem))""")

CTE["predictions"] = (["labelled"], f"""
  SELECT *, {_BAND} AS risk_level
  FROM (SELECT 'pred-' || row_key AS prediction_id, l_shipdate AS ts,
      CASE WHEN l_linestatus = 'O' THEN 'UNSW-NB15' ELSE 'CICIDS2017' END AS dataset, predicted AS prediction,
      predicted <> 'BENIGN' AS is_attack, attack_prob AS attack_probability, confidence,
      round(attack_prob * 100, 2) AS risk_score, CASE WHEN l_partkey % 3 <> 0 THEN 'manual' END AS input_source
    FROM labelled)""")

CTE["headers"] = ([], f"""
  SELECT DISTINCT 'file-' || (l_orderkey // 4) AS file, {text_list(HEADER_NAMES)}[CAST(l_partkey % {len(HEADER_NAMES)} AS INTEGER) + 1] AS "column", l_partkey % {len(HEADER_NAMES)} AS position
  FROM lineitem""")

CTE["rules"] = ([], "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(m)}, {quoted(t)}, {p}, {quoted(how)}, {quoted(kind)}, {quoted(key)})"
    for m in ("cicids", "unsw", "generalized") for t, p, how, kind, key in name_rules(m)
) + ") AS r(model, target, priority, how, kind, key)")

CTE["targets"] = ([], "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(m)}, {quoted(t)})" for m in ("cicids", "unsw", "generalized") for t in SC.FEATURES[m]
) + ") AS r(model, target)")

CTE["derivable"] = ([], "SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(m)}, {quoted(t)}, {i}, {quoted(b)})"
    for m, table in SC.DERIVABLE.items() for t, sets in table.items() for i, s in enumerate(sets) for b in s
) + ") AS r(model, target, set_no, base)")

CTE["found"] = (["headers", "rules"], """
  SELECT file, model, target, arg_min("column", priority) AS source, arg_min(how, priority) AS how
  FROM headers JOIN rules ON key = CASE kind WHEN 'exact' THEN trim("column") WHEN 'lower' THEN lower(trim("column"))
    ELSE trim(regexp_replace(lower("column"), '[._/\\-\\s]+', ' ', 'g')) END
  WHERE lower("column") NOT IN ('label') GROUP BY file, model, target""")

CTE["derived"] = (["found", "derivable"], """
  SELECT DISTINCT file, model, target FROM (
    SELECT f.file, d.model, d.target, d.set_no, count(*) AS have,
      (SELECT count(*) FROM derivable x WHERE x.model = d.model AND x.target = d.target AND x.set_no = d.set_no) AS need
    FROM found f JOIN derivable d ON f.model = d.model AND f.target = d.base GROUP BY ALL)
  WHERE have = need""")

CTE["mapping"] = (["headers", "targets", "found", "derived"], """
  SELECT h.file, t.model, t.target AS target_feature, f.source AS source_feature,
    CASE WHEN f.how IS NOT NULL THEN f.how WHEN d.target IS NOT NULL THEN 'DERIVED_CALCULATION' ELSE 'MISSING' END AS transform_type
  FROM (SELECT DISTINCT file FROM headers) h CROSS JOIN targets t
    LEFT JOIN found f ON f.file = h.file AND f.model = t.model AND f.target = t.target
    LEFT JOIN derived d ON d.file = h.file AND d.model = t.model AND d.target = t.target""")

CTE["compat"] = (["mapping"], f"""
  SELECT *, round((total_required - missing) * 100.0 / total_required, 1) AS match_percentage, missing = 0 AS is_inferable,
    CASE WHEN matched = total_required THEN '{SC.EXACT_MATCH}' WHEN missing = 0 THEN '{SC.TRANSFORMABLE}' ELSE '{SC.UNSUPPORTED}' END AS status
  FROM (SELECT file, model, count(*) AS total_required,
      count(*) FILTER (WHERE transform_type IN ('EXACT_MATCH', 'CASE_NORMALIZED')) AS matched,
      count(*) FILTER (WHERE transform_type = 'ALIAS_MAPPED') AS transformed,
      count(*) FILTER (WHERE transform_type = 'DERIVED_CALCULATION') AS derived,
      count(*) FILTER (WHERE transform_type = 'MISSING') AS missing
    FROM mapping GROUP BY file, model)""")

CTE["flagged"] = (["flow_table"], """
  SELECT *, rate > rate_limit AS dos, fwd_bytes > volume_limit AS exfil, fwd_pkts >= 20 AND bwd_pkts = 0 AS asym,
    src_ip IN (SELECT src_ip FROM flow_table GROUP BY src_ip HAVING count(DISTINCT dst_port) >= 15) AS scan
  FROM (SELECT *, fwd_pkts / greatest(duration, 1e-6) AS rate FROM flow_table),
    (SELECT CASE WHEN q[2] > q[1] THEN greatest(5000.0, q[2] + 3 * (q[2] - q[1])) ELSE 5000.0 END AS rate_limit,
        CASE WHEN v[2] > v[1] THEN greatest(1e7, v[2] + 4 * (v[2] - v[1])) ELSE 1e7 END AS volume_limit
      FROM (SELECT quantile_cont(fwd_pkts / greatest(duration, 1e-6), [0.25, 0.75]) AS q,
          quantile_cont(fwd_bytes, [0.25, 0.75]) AS v FROM flow_table))""")

CTE["evidence"] = (["flagged"], """
  SELECT *, CASE WHEN n_flags = 0 THEN ['Baseline / Unflagged'] ELSE names END AS indicators,
    CASE WHEN n_flags = 0 THEN 'No heuristic indicators triggered.' ELSE array_to_string(details, '; ') END AS evidence
  FROM (SELECT *, len(names) AS n_flags FROM (SELECT *,
      list_filter([CASE WHEN dos THEN 'High-Rate DoS-like Burst' END, CASE WHEN scan THEN 'Port Scanning / Probe' END,
        CASE WHEN asym THEN 'Asymmetric Unresponsive Flow' END, CASE WHEN exfil THEN 'Extreme Data Volume' END], lambda x: x IS NOT NULL) AS names,
      list_filter([CASE WHEN dos THEN 'Packet Rate: ' || format('{:,.1f}', rate) || ' pkts/s' END,
        CASE WHEN scan THEN 'Dst Port: ' || CAST(CAST(dst_port AS DOUBLE) AS VARCHAR) END,
        CASE WHEN asym THEN 'Fwd Pkts: ' || CAST(fwd_pkts AS VARCHAR) || ', Bwd Pkts: 0' END,
        CASE WHEN exfil THEN 'Payload Bytes: ' || format('{:,.0f}', fwd_bytes) END], lambda x: x IS NOT NULL) AS details
    FROM flagged))""")
CTE["top_evidence"] = (["evidence"], "SELECT * FROM evidence ORDER BY n_flags DESC, row_key LIMIT 50")

_INCIDENT = """
  SELECT src_ip, attack_category, count(*) AS flow_count, max(risk_score) AS risk_score,
    arg_min(dst_ip, flow_seq) AS dst_ip, min(ts) AS first_seen, max(ts) AS last_seen,
    'Potential ' || attack_category || ' attack from ' || src_ip AS title, 'New' AS status,
    CASE WHEN max(risk_score) >= 80 THEN 'Critical' WHEN max(risk_score) >= 60 THEN 'High' ELSE 'Medium' END AS severity,
    'Correlated from ' || arg_min(source_type, flow_seq) || ' flow analysis (' || arg_min(dataset, flow_seq) || ').' AS notes,
    CAST(NULL AS VARCHAR) AS analyst
  FROM (SELECT *, CASE WHEN is_attack THEN prediction ELSE 'Anomaly' END AS attack_category FROM scored
    WHERE is_attack OR is_anomaly) WHERE {when} GROUP BY src_ip, attack_category"""
CTE["incidents"] = (["scored"], _INCIDENT.format(when="true"))
CTE["first_half"] = (["scored"], _INCIDENT.format(when="ts < TIMESTAMP '2024-01-15'"))
CTE["second_half"] = (["scored"], _INCIDENT.format(when="ts >= TIMESTAMP '2024-01-15'"))
CTE["existing"] = (["first_half"], """
  SELECT * REPLACE (CASE WHEN flow_count % 3 = 0 THEN 'Resolved' WHEN flow_count % 3 = 1 THEN 'Investigating' ELSE 'New' END AS status)
  FROM first_half""")
CTE["alerts"] = (["predictions", "scored"], """
  SELECT prediction_id AS record_id, ts, dataset, prediction, is_attack, risk_score, risk_level, confidence,
    coalesce(input_source, 'manual') AS input_source FROM predictions
  UNION ALL SELECT flow_id, ts, dataset, prediction, is_attack, risk_score, risk_level, confidence, source_type FROM scored""")

_RATES = """round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy,
    round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
    round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr,
    round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr"""


def _cells(threshold: str, source: str = "labelled") -> str:
    return f"""count(*) FILTER (WHERE actual <> 'BENIGN' AND attack_prob >= {threshold}) AS tp,
    count(*) FILTER (WHERE actual = 'BENIGN' AND attack_prob >= {threshold}) AS fp,
    count(*) FILTER (WHERE actual = 'BENIGN' AND attack_prob < {threshold}) AS tn,
    count(*) FILTER (WHERE actual <> 'BENIGN' AND attack_prob < {threshold}) AS fn"""


def _sweep(start: int, stop: int, step: int) -> str:
    return f"""SELECT *, {_RATES} FROM (SELECT th AS threshold, {_cells('th')}
      FROM labelled, (SELECT unnest(range({start}, {stop + 1}, {step})) / 100.0 AS th) GROUP BY th)"""


CTE["sweep_coarse"] = (["labelled"], _sweep(10, 95, 5))
CTE["split"] = (["labelled"], """
  SELECT row_key, actual, CASE WHEN place_no <= round(n * 0.7) THEN 'train' WHEN place_no <= round(n * 0.85) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT row_key, actual, row_number() OVER (PARTITION BY actual ORDER BY md5(row_key), row_key) AS place_no,
    count(*) OVER (PARTITION BY actual) AS n FROM labelled)""")


def sql(body: str, *names: str, instead: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``body`` over the named table expressions; ``instead`` puts others in their place."""
    order: list[str] = []
    defined = CTE | (instead or {})

    def add(name: str) -> None:
        if name not in order:
            for needed in defined[name][0]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({defined[n][1]})" for n in order) + "\n" + body


# flows split at idle times: the segments, cut once more
IDLE_FLOWS = {"segments": (["raw_segments"], """
  SELECT * EXCLUDE (seg, seen), seg * 1000000 + sum(CASE WHEN t - seen >= 86400000000 THEN 1 ELSE 0 END) OVER (
      PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg ORDER BY packet_seq) AS seg
  FROM (SELECT *, max(t) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg ORDER BY packet_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM raw_segments)"""), "raw_segments": CTE["segments"]}
# packets that arrive out of order in four parts; one is late when a day older than the newest of an earlier part
DELAYED = {"in_order": CTE["packets"], "arriving": (["in_order"], """
  SELECT * REPLACE ((packet_seq + CASE WHEN packet_seq % 101 = 0 THEN 1500 WHEN packet_seq % 5 = 0 THEN 37 ELSE 0 END) * 4096
      + packet_seq % 4096 AS packet_seq) FROM in_order"""), "dealt": (["arriving"], """
  SELECT *, floor(packet_seq * 4 / (SELECT max(packet_seq) + 1 FROM arriving)) AS part FROM arriving"""), "judged": (["dealt"], """
  SELECT *, coalesce(t <= (max(t) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // 1000 * 1000 - 86400000000, false) AS late
  FROM dealt"""), "packets": (["judged"], "SELECT * FROM judged WHERE NOT late")}


def iso(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') AS {name or column}"


def rnd(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _snake(name: str) -> str:
    return name.lower().replace("/", "_").replace(" ", "_").replace(".", "_")


_INCIDENT_OUT = ("title, status, severity, src_ip, dst_ip, attack_category, flow_count, risk_score, "
                 + iso("first_seen") + ", " + iso("last_seen") + ", notes, analyst")
_GEN = SC.GENERALIZED_FEATURES
_COUNTS = """count(*) AS total_records, count(*) FILTER (WHERE NOT is_attack) AS benign_count,
  count(*) FILTER (WHERE is_attack) AS attack_count, round(count(*) FILTER (WHERE is_attack) * 100.0 / count(*), 2) AS attack_percentage,
  round(sum(CAST(round(risk_score * 100) AS BIGINT)) / 100.0 / count(*), 2) AS average_risk_score, count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count,
  count(*) FILTER (WHERE risk_level = 'Critical') AS critical_risk_count"""


def _cicids_sql() -> str:
    c = {
        "Destination Port": "dst_port", "Flow Duration": "seconds * 1000000.0", "Total Fwd Packets": "fwd_packets",
        "Total Backward Packets": "bwd_packets", "Total Length of Fwd Packets": "fwd_bytes",
        "Total Length of Bwd Packets": "bwd_bytes", "Flow Bytes/s": "bytes / seconds", "Flow Packets/s": "packets / seconds",
        "Fwd Packets/s": "fwd_packets / seconds", "Bwd Packets/s": "bwd_packets / seconds",
        "Average Packet Size": "len_mean", "Packet Length Variance": "len_var", "Packet Length Mean": "len_mean",
        "Packet Length Std": "len_std", "Min Packet Length": "len_min", "Max Packet Length": "len_max",
        "Down/Up Ratio": "CASE WHEN fwd_packets > 0 THEN bwd_packets / fwd_packets ELSE 0 END",
        "Fwd Header Length": "fwd_header", "Fwd Header Length.1": "fwd_header", "Bwd Header Length": "bwd_header",
        "Init_Win_bytes_forward": "fwd_window", "Init_Win_bytes_backward": "bwd_window", "act_data_pkt_fwd": "fwd_packets",
        "min_seg_size_forward": "CASE WHEN proto = 'TCP' THEN 20.0 ELSE 8.0 END", "Fwd PSH Flags": "psh_count",
        "Fwd URG Flags": "urg_count", "Avg Fwd Segment Size": "fwd_len_mean", "Avg Bwd Segment Size": "bwd_len_mean",
        "Subflow Fwd Packets": "fwd_packets", "Subflow Bwd Packets": "bwd_packets", "Subflow Fwd Bytes": "fwd_bytes",
        "Subflow Bwd Bytes": "bwd_bytes",
    }
    out = []
    for f in SC.CICIDS_FEATURES:
        if f in c:
            e = c[f]
        elif f.endswith("Flag Count"):
            e = f.split()[0].lower() + "_count"
        elif f.startswith(("Active", "Idle")):
            e = "0.0"
        else:  # "<side> <Packet Length|IAT> <Stat>"
            words = f.lower().split()
            side = "" if words[0] == "flow" else words[0] + "_"
            e = f"{side}{'gap' if 'iat' in words else 'len'}_{words[-1]}"
        e = f"CAST({e} AS DOUBLE)"
        e = f"round({e} / 1e6, 3)" if " IAT " in f or f == "Flow Duration" else f"round({e}, {3 if f.endswith('/s') else 6})"
        out.append(f"{e} AS {_snake(f)}")
    return ", ".join(out)


def _unsw_sql() -> str:
    u = {
        "dur": "seconds", "proto": "CASE proto WHEN 'TCP' THEN 6.0 WHEN 'UDP' THEN 17.0 ELSE 1.0 END",
        "state": "CASE WHEN syn_count > 0 AND ack_count > 0 THEN 2.0 ELSE 1.0 END", "spkts": "fwd_packets", "dpkts": "bwd_packets",
        "sbytes": "fwd_bytes", "dbytes": "bwd_bytes", "rate": "packets / seconds", "sttl": "64.0", "dttl": "64.0",
        "sload": "fwd_bytes * 8 / seconds", "dload": "bwd_bytes * 8 / seconds", "sinpkt": "fwd_gap_mean / 1000.0 / 1e3",
        "dinpkt": "bwd_gap_mean / 1000.0 / 1e3", "sjit": "fwd_gap_std / 1000.0 / 1e3", "djit": "bwd_gap_std / 1000.0 / 1e3",
        "swin": "fwd_window", "dwin": "bwd_window", "tcprtt": "first_fwd_gap / 1e6", "synack": "first_fwd_gap / 1e6 / 2.0",
        "ackdat": "first_fwd_gap / 1e6 / 2.0", "smean": "fwd_len_mean", "dmean": "bwd_len_mean",
        "is_sm_ips_ports": "CASE WHEN src_ip = dst_ip AND src_port = dst_port THEN 1.0 ELSE 0.0 END",
    }
    ones = ("ct_srv_src", "ct_state_ttl", "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm", "ct_src_ltm", "ct_srv_dst")
    return ", ".join(
        f"round(CAST({u.get(f, '1.0' if f in ones else '0.0')} AS DOUBLE), {6 if f in ('smean', 'dmean') else 3}) AS {f}" for f in SC.UNSW_FEATURES
    )


def _decision(p: str, hit: str, name: str, confidence: str, margin: str, dataset: str) -> str:
    score = f"round({p} * 100, 2)"
    return f"""'{dataset}' AS dataset, CASE WHEN {p} IS NULL THEN 'Unclassifiable' ELSE {name} END AS prediction,
  CASE WHEN {p} IS NULL THEN false ELSE {hit} END AS is_attack, coalesce(round({confidence}, 4), 0.0) AS confidence,
  coalesce(round({p}, 4), 0.0) AS attack_probability, coalesce({score}, 0.0) AS risk_score,
  CASE WHEN coalesce({score}, 0) < 30 THEN 'Low' WHEN {score} < 60 THEN 'Moderate' WHEN {score} < 80 THEN 'High' ELSE 'Critical' END AS risk_level,
  coalesce(round({margin}, 4), 0.0) AS prediction_margin"""


def _attributions() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg(abs(({w}) * (ln(1 + {f}) - {m}))), 6) AS r, avg(abs(({w}) * (ln(1 + {f}) - {m}))) AS a FROM gen"
        for f, (w, m) in LOGISTIC.items()
    )


def _unpivot(dataset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT flow_seq, {quoted(f)} AS feature, CAST({f} AS DOUBLE) AS v, {b} AS base, {i} AS place FROM gen"
        for i, (f, b, _d) in enumerate(SC.ATTRIBUTION_BASES[dataset])
    )


def _missing(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {test}) AS missing, round(count(*) FILTER (WHERE {test}) * 100.0 / count(*), 2) AS missing_percentage FROM dirty"
        for c, test in columns.items()
    )


_DIRTY = {"flow_key": "flow_key IS NULL", "packets": "packets IS NULL OR isnan(packets)", "bytes": "bytes IS NULL OR isnan(bytes)", "protocol": "protocol IS NULL"}
_NUMERIC = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
    f"round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS p25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median, "
    f"round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM flow_table"
    for c in ("fwd_pkts", "bwd_pkts", "fwd_bytes", "duration", "dst_port")
)
_TOTALS = """SELECT total_records, missing_cells, infinite_cells, round(missing_cells * 100.0 / (total_records * 4), 2) AS missing_percentage,
  duplicate_records, round(duplicate_records * 100.0 / total_records, 2) AS duplicate_percentage, class_imbalance_ratio
 FROM (SELECT count(*) AS total_records, count(*) FILTER (WHERE packets IS NULL) + count(*) FILTER (WHERE isnan(bytes)) + count(*) FILTER (WHERE protocol IS NULL) AS missing_cells,
    count(*) FILTER (WHERE isinf(bytes)) AS infinite_cells FROM dirty),
  (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_records FROM (SELECT count(*) AS n FROM dirty GROUP BY flow_key, packets, CASE WHEN isnan(bytes) THEN NULL ELSE bytes END, protocol)),
  (SELECT round(max(n) / min(n), 2) AS class_imbalance_ratio FROM (SELECT count(*) AS n FROM dirty GROUP BY protocol))"""


def _per_class_report() -> str:
    return """, per AS (SELECT class, CAST(sum(s) AS BIGINT) AS support, CASE WHEN sum(c) > 0 THEN sum(h) / sum(c) ELSE 0 END AS precision,
    CASE WHEN sum(s) > 0 THEN sum(h) / sum(s) ELSE 0 END AS recall, sum(h) AS hit
  FROM (SELECT actual AS class, 1 AS s, 0 AS c, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS h FROM labelled
    UNION ALL SELECT predicted, 0, 1, 0 FROM labelled) GROUP BY class),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)
 SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)"""


def _incident_upsert() -> str:
    return f"""SELECT {_INCIDENT_OUT} FROM (
  SELECT coalesce(o.title, n.title) AS title, coalesce(o.status, n.status) AS status,
    CASE WHEN n.risk_score > coalesce(o.risk_score, -1) THEN n.severity ELSE o.severity END AS severity,
    coalesce(o.src_ip, n.src_ip) AS src_ip, coalesce(o.dst_ip, n.dst_ip) AS dst_ip, coalesce(o.attack_category, n.attack_category) AS attack_category,
    coalesce(o.flow_count, 0) + coalesce(n.flow_count, 0) AS flow_count, greatest(coalesce(o.risk_score, -1), coalesce(n.risk_score, -1)) AS risk_score,
    coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen,
    coalesce(o.notes, n.notes) AS notes, coalesce(o.analyst, n.analyst) AS analyst
  FROM (SELECT * FROM existing WHERE status <> 'Resolved') o FULL OUTER JOIN second_half n ON o.src_ip = n.src_ip AND o.attack_category = n.attack_category
  UNION ALL SELECT title, status, severity, src_ip, dst_ip, attack_category, flow_count, risk_score, first_seen, last_seen, notes, analyst
  FROM existing WHERE status = 'Resolved'
  UNION ALL SELECT title || ' (2)', status, severity, src_ip, dst_ip, attack_category, flow_count, risk_score, first_seen + INTERVAL 1 HOUR, last_seen, notes, analyst
  FROM existing WHERE status <> 'Resolved' AND flow_count % 5 = 0)"""


def _feature_present(i: int) -> str:
    return f"(l_partkey + l_suppkey * {i}) % 6 <> 0"


def all_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # flows
    q["q_flow_header"] = sql("SELECT flow_seq, flow_id, " + iso("make_timestamp(start_t)", "timestamp") + """, src_ip, dst_ip, src_port, dst_port,
      proto AS protocol, round(seconds, 6) AS duration, packets AS packet_count, bytes AS byte_count, is_terminated, reason AS termination_reason FROM flows""", "flows")
    q["q_flow_counts"] = sql("SELECT flow_seq, fwd_packets, bwd_packets, packets, fwd_bytes, bwd_bytes, bytes FROM flows", "flows")
    lengths = [f"{p}len_{s}" for p in ("", "fwd_", "bwd_") for s in ("min", "max", "mean", "std")]
    q["q_flow_lengths"] = sql(f"SELECT flow_seq, {rnd(lengths + ['len_var'], 6)} FROM flows", "flows")
    gaps = [f"{p}gap_{s}" for p in ("", "fwd_", "bwd_") for s in ("total", "mean", "std", "max", "min")] + ["first_fwd_gap"]
    q["q_flow_iat"] = sql("SELECT flow_seq, " + ", ".join(f"round({g} / 1e6, 3) AS {g}" for g in gaps) + " FROM flows", "flows")
    q["q_flow_flags"] = sql("SELECT flow_seq, fin_count, syn_count, rst_count, psh_count, ack_count, urg_count, ece_count, cwe_count, reason AS termination_reason, is_terminated FROM flows", "flows")
    q["q_flow_rates"] = sql("""SELECT flow_seq, round(seconds, 4) AS seconds, round(packets / seconds, 4) AS packets_per_second,
      round(bytes / seconds, 4) AS bytes_per_second, round(CASE WHEN fwd_packets > 0 THEN bwd_packets / fwd_packets ELSE 0 END, 4) AS down_up FROM flows""", "flows")
    q["q_flow_windows"] = sql("SELECT flow_seq, fwd_header, bwd_header, fwd_window, bwd_window FROM flows", "flows")
    q["q_flow_generalized"] = sql(f"SELECT flow_seq, {rnd(_GEN)} FROM gen", "gen")
    q["q_flow_cicids"] = sql(f"SELECT flow_seq, {_cicids_sql()} FROM flows", "flows")
    q["q_flow_unsw"] = sql(f"SELECT flow_seq, {_unsw_sql()} FROM flows", "flows")
    q["q_flow_idle_split"] = sql("""SELECT flow_seq, src_ip, src_port, packets, bytes, round(greatest(1e-6, (last_t - start_t) / 1000000.0), 6) AS seconds,
      CASE WHEN last_flags & 1 <> 0 THEN 'tcp_fin' WHEN last_flags & 4 <> 0 THEN 'tcp_rst' WHEN part < last_part THEN 'inactivity_timeout' ELSE 'active' END AS termination_reason
     FROM (SELECT min(packet_seq) AS flow_seq, arg_min(src_ip, packet_seq) AS src_ip, arg_min(src_port, packet_seq) AS src_port, count(*) AS packets,
        CAST(sum(pkt_len) AS BIGINT) AS bytes, max(t) AS last_t, arg_min(t, packet_seq) AS start_t, arg_max(tcp_flags, packet_seq) AS last_flags, part, any_value(last_part) AS last_part
      FROM (SELECT *, max(part) OVER (PARTITION BY ip_a, ip_b, port_a, port_b, proto, seg) AS last_part FROM idle)
      GROUP BY ip_a, ip_b, port_a, port_b, proto, seg, part)""", "idle")
    q["q_packet_gaps"] = sql("SELECT packet_seq, flow_seq, is_fwd, gap, dir_gap FROM gaps", "gaps")
    q["q_packet_keys"] = sql("SELECT packet_seq, ip_a, ip_b, port_a, port_b, proto, CASE proto WHEN 'TCP' THEN 6.0 WHEN 'UDP' THEN 17.0 ELSE 1.0 END AS protocol_code, "
                             + iso("ts") + ", " + ", ".join(f"tcp_flags & {b} <> 0 AS {n}" for n, b in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32), ("ece", 64), ("cwe", 128)))
                             + " FROM keyed", "keyed")
    # adaptation
    q["q_normalize_token"] = sql("""SELECT "column", trim(regexp_replace(lower(trim("column")), '[._/\\-\\s]+', ' ', 'g')) AS token, count(*) AS files FROM headers GROUP BY 1, 2""", "headers")
    q["q_label_isolation"] = sql("SELECT row_key, dst_port, fwd_pkts, bwd_pkts, fwd_bytes, duration, protocol, src_ip FROM flow_table", "flow_table")
    q["q_adapt_alias"] = sql("""SELECT row_key, CAST(dst_port AS DOUBLE) AS destination_port, round(duration * 1000000.0, 6) AS flow_duration, bwd_pkts AS total_backward_packets,
      fwd_pkts AS total_fwd_packets, fwd_bytes AS total_length_of_fwd_packets, round(CASE WHEN fwd_pkts = 0 THEN fwd_bytes ELSE fwd_bytes / fwd_pkts END, 6) AS avg_fwd_segment_size,
      round(bwd_pkts / CASE WHEN fwd_pkts = 0 THEN 1 ELSE fwd_pkts END, 6) AS down_up_ratio, round((fwd_pkts + bwd_pkts) / CASE WHEN duration = 0 THEN 1e-6 ELSE duration * 1e6 / 1e6 END, 6) AS flow_packets_s,
      round(fwd_pkts / CASE WHEN duration = 0 THEN 1e-6 ELSE duration * 1e6 / 1e6 END, 6) AS fwd_packets_s, round(bwd_pkts / CASE WHEN duration = 0 THEN 1e-6 ELSE duration * 1e6 / 1e6 END, 6) AS bwd_packets_s,
      fwd_pkts AS subflow_fwd_packets, bwd_pkts AS subflow_bwd_packets, fwd_bytes AS subflow_fwd_bytes FROM flow_table""", "flow_table")
    q["q_adapt_units"] = sql("SELECT row_key, round(CASE WHEN (SELECT max(duration * 1e6) FROM flow_table) > 50000 THEN duration * 1e6 / 1e6 ELSE duration * 1e6 END, 6) AS duration_seconds FROM flow_table", "flow_table")
    dur = "CASE WHEN duration = 0 THEN 1e-6 ELSE duration END"
    q["q_adapt_derive_gen"] = sql(f"""SELECT row_key, round(duration, 6) AS duration_seconds, fwd_pkts AS forward_packets, bwd_pkts AS backward_packets, round(fwd_bytes, 6) AS forward_bytes,
      bwd_pkts * 100 AS backward_bytes, fwd_pkts + bwd_pkts AS total_packets, round(fwd_bytes + bwd_pkts * 100, 6) AS total_bytes, round((fwd_pkts + bwd_pkts) / {dur}, 6) AS packets_per_second,
      round((fwd_bytes + bwd_pkts * 100) / {dur}, 2) AS bytes_per_second, round((fwd_bytes + bwd_pkts * 100) / (fwd_pkts + bwd_pkts), 6) AS average_packet_size FROM flow_table""", "flow_table")
    us = "(duration * 1000000.0)"
    sec = f"CASE WHEN {us} / 1000000.0 = 0 THEN 1e-6 ELSE {us} / 1000000.0 END"
    q["q_adapt_derive_cicids"] = sql(f"""SELECT row_key, round({us}, 6) AS flow_duration, fwd_pkts AS total_fwd_packets, bwd_pkts AS total_backward_packets, round(fwd_bytes, 6) AS total_length_of_fwd_packets,
      bwd_pkts * 100 AS total_length_of_bwd_packets, fwd_pkts * 20 AS fwd_header_length, fwd_pkts * 20 AS fwd_header_length_1, round((fwd_bytes + bwd_pkts * 100) / (fwd_pkts + bwd_pkts), 6) AS average_packet_size,
      round(fwd_bytes / fwd_pkts, 6) AS avg_fwd_segment_size, round(bwd_pkts * 100 / CASE WHEN bwd_pkts = 0 THEN 1 ELSE bwd_pkts END, 6) AS avg_bwd_segment_size, round(bwd_pkts / fwd_pkts, 6) AS down_up_ratio,
      fwd_pkts AS subflow_fwd_packets, round(fwd_bytes, 6) AS subflow_fwd_bytes, bwd_pkts AS subflow_bwd_packets, bwd_pkts * 100 AS subflow_bwd_bytes, round((fwd_bytes + bwd_pkts * 100) / {sec}, 2) AS flow_bytes_s,
      round((fwd_pkts + bwd_pkts) / {sec}, 6) AS flow_packets_s, round(fwd_pkts / {sec}, 6) AS fwd_packets_s, round(bwd_pkts / {sec}, 6) AS bwd_packets_s FROM flow_table""", "flow_table")
    q["q_adapt_derive_unsw"] = sql(f"""SELECT row_key, round(duration, 6) AS dur, fwd_pkts AS spkts, bwd_pkts AS dpkts, round(fwd_bytes, 6) AS sbytes, bwd_pkts * 100 AS dbytes, round((fwd_pkts + bwd_pkts) / {dur}, 6) AS rate,
      round(fwd_bytes * 8 / {dur}, 0) AS sload, round(bwd_pkts * 100 * 8 / {dur}, 0) AS dload, round(fwd_bytes / fwd_pkts, 6) AS smean, CASE WHEN bwd_pkts = 0 THEN 0.0 ELSE 100.0 END AS dmean FROM flow_table""", "flow_table")
    q["q_adapt_clean"] = sql("""SELECT protocol, round(sum(CASE WHEN isnan(bytes) OR isinf(bytes) THEN 0 ELSE bytes END), 2) AS bytes, round(sum(coalesce(packets, 0)), 2) AS packets, 0.0 AS text_as_number
      FROM dirty GROUP BY protocol""", "dirty")
    absent = " + ".join(f"CASE WHEN {_feature_present(i)} THEN 0 ELSE 1 END" for i in range(10))
    q["q_adapt_reject"] = f"SELECT {_KEY} AS row_key, CASE WHEN {absent} > 2 THEN 'rejected' ELSE 'accepted' END AS outcome FROM lineitem"
    q["q_adapt_lenient"] = f"SELECT {_KEY} AS row_key, " + ", ".join(
        f"CASE WHEN {_feature_present(i)} AND (l_suppkey + {i}) % 9 <> 0 THEN l_quantity * {i + 1} ELSE 0.0 END AS {f}" for i, f in enumerate(_GEN)
    ) + " FROM lineitem"
    q["q_schema_mapping"] = sql("SELECT * FROM mapping WHERE transform_type <> 'MISSING'", "mapping")
    q["q_schema_audit"] = sql("SELECT * FROM compat", "compat")
    gaps_text = " || ".join(
        quoted(p) if i % 2 == 0 else f"CAST(m_{p} AS VARCHAR)" for i, p in enumerate(re.split(r"\{(\w+)\}", SC.EXPLAIN_UNSUPPORTED))
    )
    place = "CASE model WHEN 'cicids' THEN 1 WHEN 'unsw' THEN 2 ELSE 3 END"
    name = "CASE model " + " ".join(f"WHEN '{m}' THEN {quoted(n)}" for m, n in SC.SCHEMA_NAME.items()) + " END"
    adapted = "CASE model " + " ".join(f"WHEN '{m}' THEN {quoted(n)}" for m, n in SC.ADAPTED_NAME.items()) + " END"
    schema = f"CASE status WHEN 'EXACT_MATCH' THEN {name} WHEN 'TRANSFORMABLE' THEN {adapted} ELSE 'Partial / Custom Schema' END"
    q["q_schema_choice"] = sql(f"""SELECT file, model, {schema} AS detected_schema, status, match_percentage, is_inferable,
      CASE status WHEN 'EXACT_MATCH' THEN replace({quoted(SC.EXPLAIN_EXACT)}, '{{schema}}', {schema}) WHEN 'TRANSFORMABLE' THEN replace({quoted(SC.EXPLAIN_ADAPTED)}, '{{schema}}', {schema}) ELSE {gaps_text} END AS explanation,
      CASE status WHEN 'EXACT_MATCH' THEN {quoted(SC.ACTION_EXACT)} WHEN 'TRANSFORMABLE' THEN replace({quoted(SC.ACTION_ADAPTED)}, '{{n}}', CAST(transformed + derived AS VARCHAR)) ELSE {quoted(SC.ACTION_UNSUPPORTED)} END AS recommended_action
     FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY is_inferable DESC, CASE WHEN is_inferable THEN 0 ELSE match_percentage END DESC, {place}) AS place_no,
        max(missing) FILTER (WHERE model = 'cicids') OVER (PARTITION BY file) AS m_c, max(missing) FILTER (WHERE model = 'unsw') OVER (PARTITION BY file) AS m_u,
        max(missing) FILTER (WHERE model = 'generalized') OVER (PARTITION BY file) AS m_g FROM compat) WHERE place_no = 1""", "compat")
    q["q_schema_requested"] = sql("SELECT file, model, status, match_percentage FROM compat WHERE model = 'unsw'", "compat")
    q["q_schema_missing"] = sql("SELECT file, string_agg(target_feature, ',' ORDER BY target_feature) AS missing_features FROM mapping WHERE model = 'generalized' AND transform_type = 'MISSING' GROUP BY file", "mapping")
    q["q_schema_extra"] = sql("""SELECT file, coalesce(string_agg("column", ',' ORDER BY position) FILTER (WHERE NOT used), '') AS extra_features
      FROM (SELECT h.*, EXISTS (SELECT 1 FROM found f WHERE f.file = h.file AND f.model = 'generalized' AND f.source = h."column") AS used FROM headers h WHERE h."column" <> 'Label') GROUP BY file""", "headers", "found")
    q["q_mapping_search"] = sql("SELECT target_feature, source_feature, count(*) AS files FROM mapping WHERE model = 'generalized' AND transform_type = 'ALIAS_MAPPED' GROUP BY 1, 2", "mapping")
    # profile
    q["q_prof_missing"] = sql(_missing(_DIRTY), "dirty")
    q["q_prof_inf"] = sql("""SELECT 'packets' AS "column", count(*) FILTER (WHERE isinf(packets)) AS infinite FROM dirty UNION ALL SELECT 'bytes', count(*) FILTER (WHERE isinf(bytes)) FROM dirty""", "dirty")
    q["q_prof_dups"] = sql("""SELECT CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(n - 1) AS BIGINT) AS duplicate_records, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_percentage
      FROM (SELECT count(*) AS n FROM dirty GROUP BY flow_key, packets, CASE WHEN isnan(bytes) THEN NULL ELSE bytes END, protocol)""", "dirty")
    q["q_prof_numeric"] = sql(_NUMERIC, "flow_table")
    q["q_feature_search"] = sql(f"""SELECT * FROM ({_NUMERIC}) WHERE "column" LIKE '%pkts%'""", "flow_table")
    q["q_prof_protocol"] = sql("SELECT coalesce(protocol, 'nan') AS value, count(*) AS n FROM dirty GROUP BY 1 ORDER BY n DESC, value LIMIT 10", "dirty")
    q["q_prof_time"] = sql("SELECT 'timestamp' AS \"column\", " + iso("min(ts)", "earliest") + ", " + iso("max(ts)", "latest") + ", count(ts) AS valid_timestamps_count FROM flow_table", "flow_table")
    q["q_prof_labels"] = sql("SELECT label AS value, count(*) AS n FROM flow_table GROUP BY 1", "flow_table")
    q["q_prof_imbalance"] = sql("SELECT count(*) AS classes, round(max(n) / min(n), 2) AS class_imbalance_ratio FROM (SELECT count(*) AS n FROM flow_table GROUP BY label)", "flow_table")
    q["q_prof_totals"] = sql(_TOTALS, "dirty")
    q["q_prof_warnings"] = sql(f""", tot AS ({_TOTALS})
      SELECT 'High missingness: ' || missing_percentage || '% of dataset cells contain NaN/null values.' AS warning FROM tot WHERE missing_percentage > 5
      UNION ALL SELECT 'Dataset contains ' || infinite_cells || ' infinite values across numeric features.' FROM tot WHERE infinite_cells > 0
      UNION ALL SELECT 'High duplicate rate: ' || duplicate_percentage || '% of rows are exact duplicates.' FROM tot WHERE duplicate_percentage > 10
      UNION ALL SELECT 'Severe class imbalance detected: Majority class is ' || class_imbalance_ratio || 'x larger than minority class.' FROM tot WHERE class_imbalance_ratio > 20""", "dirty")
    # rules
    for rule in SC.INDICATORS:
        q[f"q_rule_{rule}"] = sql(f"SELECT row_key, round(rate, 2) AS rate, round(fwd_bytes, 2) AS volume FROM flagged WHERE {rule}", "flagged")
    q["q_rule_scan_sources"] = sql("SELECT src_ip AS probing_source, count(DISTINCT dst_port) AS ports FROM flow_table GROUP BY 1 HAVING ports >= 15", "flow_table")
    q["q_rule_scan_nosrc"] = sql("""SELECT label, count(*) FILTER (WHERE bwd_pkts = 0 AND dst_port > 0 AND (SELECT count(*) FROM flow_table WHERE bwd_pkts = 0 AND dst_port > 0) > 5) AS probes, count(*) AS n FROM flow_table GROUP BY label""", "flow_table")
    q["q_rule_fan_out_rows"] = sql("SELECT src_ip, count(*) AS n FROM flow_table GROUP BY src_ip HAVING count(DISTINCT dst_port) >= 15", "flow_table")
    q["q_rule_thresholds"] = sql("SELECT count(*) AS total_rows, round(any_value(rate_limit), 2) AS dos_threshold, round(any_value(volume_limit), 2) AS exfil_threshold FROM flagged", "flagged")
    peak = {"dos": "round(max(rate), 2)", "scan": "CAST(NULL AS DOUBLE)", "asym": "CAST(NULL AS DOUBLE)", "exfil": "round(max(fwd_bytes) / 1048576, 2)"}
    q["q_rule_summary"] = sql(" UNION ALL ".join(
        f"SELECT {quoted(v[0])} AS indicator_id, {quoted(v[1])} AS name, {quoted(v[2])} AS category, {quoted(v[3])} AS severity, count(*) FILTER (WHERE {k}) > 0 AS detected, "
        f"count(*) FILTER (WHERE {k}) AS affected_records_count, round(count(*) FILTER (WHERE {k}) * 100.0 / count(*), 2) AS affected_percentage, {peak[k]} AS peak FROM flagged"
        for k, v in SC.INDICATORS.items()), "flagged")
    q["q_rule_evidence"] = sql("SELECT row_key, n_flags, array_to_string(indicators, '|') AS indicators, evidence FROM top_evidence", "top_evidence")
    q["q_evidence_export"] = sql("""SELECT row_key AS row_index, label AS actual_dataset_label, array_to_string(indicators, ', ') AS potential_threat_indicators, 0.0 AS statistical_outlier_score, evidence AS evidence_details,
      CAST(dst_port AS DOUBLE) AS feature_dst_port, fwd_pkts AS feature_fwd_pkts, bwd_pkts AS feature_bwd_pkts, round(fwd_bytes, 2) AS feature_fwd_bytes, round(duration, 2) AS feature_duration FROM evidence WHERE n_flags > 0""", "evidence")
    q["q_evidence_search"] = sql("SELECT row_key, n_flags FROM evidence WHERE n_flags > 0 AND (lower(label) LIKE '%volume%' OR lower(evidence) LIKE '%volume%' OR lower(array_to_string(indicators, '|')) LIKE '%volume%')", "evidence")
    # decisions
    q["q_score"] = sql("SELECT flow_seq, flow_id, prediction, is_attack, confidence, attack_probability, risk_score, risk_level, prediction_margin, anomaly_score, is_anomaly, generalized_prediction FROM scored", "scored")
    q["q_risk"] = sql("""SELECT band, b.risk_level, count(s.flow_seq) AS n FROM (VALUES (0, 'Low'), (1, 'Moderate'), (2, 'High'), (3, 'Critical')) AS b(band, risk_level) LEFT JOIN scored s ON s.risk_level = b.risk_level GROUP BY 1, 2""", "scored")
    q["q_risk_from_benign"] = sql(f"""SELECT row_key, attack_probability, risk_score, {_BAND} AS risk_level FROM (SELECT row_key, round(p, 4) AS attack_probability, round(p * 100, 2) AS risk_score
      FROM (SELECT row_key, least(1.0, greatest(0.0, 1.0 - (1.3 - attack_prob * 1.6))) AS p FROM labelled))""", "labelled")
    q["q_severity"] = sql("""SELECT risk_level, CASE WHEN risk_level IN ('High', 'Critical') THEN risk_level ELSE 'Medium' END AS incident_severity,
      CASE risk_level WHEN 'Critical' THEN 'critical' WHEN 'High' THEN 'high' WHEN 'Moderate' THEN 'warning' ELSE 'info' END AS alert_severity, count(*) AS n FROM predictions GROUP BY 1""", "predictions")
    q["q_alert"] = sql("""SELECT prediction_id, risk_level IN ('High', 'Critical') AS alert_triggered, CASE risk_level WHEN 'Critical' THEN 'critical' WHEN 'High' THEN 'high' WHEN 'Moderate' THEN 'warning' ELSE 'info' END AS severity,
      'Security Alert: ' || risk_level || ' Risk Traffic Detected (' || prediction || ')' AS title,
      'Network flow evaluated with a risk score of ' || risk_score || '/100. Classified as ' || prediction || '.' AS description FROM predictions""", "predictions")
    iso_p = "round(CASE WHEN s < 0.02341647 THEN least(1.0, greatest(0.0, (0.02341647 - s) * 2 + 0.5)) ELSE greatest(0.01, least(0.49, 0.5 - (s - 0.02341647) * 2)) END, 4)"
    conf = "round(least(1.0, abs(s - 0.02341647) * 5 + 0.5), 4)"
    q["q_isolation_prob"] = sql(f"SELECT row_key, {_decision(iso_p, 's < 0.02341647', chr(67) + 'ASE WHEN s < 0.02341647 THEN ' + quoted('Anomaly') + ' ELSE ' + quoted('Normal') + ' END', conf, f'abs({conf} - 0.5)', 'Isolation-Forest')} FROM (SELECT row_key, 0.3 - attack_prob * 0.7 AS s FROM labelled)", "labelled")
    q["q_binary_decision"] = sql(f"SELECT row_key, {_decision('p', 'p >= 0.1743', 'CASE WHEN p >= 0.1743 THEN ' + quoted('Attack') + ' ELSE ' + quoted('Normal') + ' END', 'greatest(p, 1 - p)', 'abs(p * 2 - 1)', 'Generalized-XGB')} FROM (SELECT row_key, CASE WHEN dst_port <> 3 THEN attack_prob END AS p FROM labelled)", "labelled")
    q["q_fallback_dist"] = sql("""SELECT row_key, CASE WHEN n >= o THEN 'Normal' ELSE 'Analysis' END AS prediction, n < o AS is_attack, round(greatest(n, o), 4) AS confidence, round(a, 4) AS attack_probability, round(a * 100, 2) AS risk_score,
      CASE WHEN round(a * 100, 2) < 30 THEN 'Low' WHEN round(a * 100, 2) < 60 THEN 'Moderate' WHEN round(a * 100, 2) < 80 THEN 'High' ELSE 'Critical' END AS risk_level,
      round(CASE WHEN n >= o THEN n - o ELSE 0 END, 4) AS prediction_margin, round(o, 4) AS p_first, round(n, 4) AS p_normal
     FROM (SELECT row_key, 1 - p AS n, p / 9.0 AS o, least(1.0, greatest(0.0, 1.0 - (1 - p))) AS a FROM (SELECT row_key, attack_prob * 1.05 AS p FROM labelled))""", "labelled")
    q["q_threshold_dim"] = sql("""SELECT dataset, th AS decision_threshold, count(*) FILTER (WHERE attack_probability >= th) AS warned, count(*) FILTER (WHERE is_attack) AS attacks, count(*) AS n
      FROM predictions JOIN (VALUES ('CICIDS2017', CAST(0.94 AS DOUBLE)), ('UNSW-NB15', CAST(0.5 AS DOUBLE))) AS m(d, th) ON d = dataset GROUP BY 1, 2""", "predictions")
    q["q_top_features"] = sql(" UNION ALL ".join(
        f"SELECT flow_seq, '{f}' AS feature, round({f}, 2) AS value, round(least(1.0, abs({f}) * 0.01 + 0.1), 4) AS importance, CASE WHEN {f} > 0 THEN 'positive' ELSE 'negative' END AS direction FROM gen" for f in _GEN), "gen")
    q["q_instance_attr"] = sql(f"""SELECT flow_seq, importance, feature, round(v, 2) AS value, CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS direction
     FROM (SELECT *, row_number() OVER (PARTITION BY flow_seq ORDER BY importance DESC, place) AS place_no FROM (SELECT *, CAST(round(CAST(CAST(abs(v) * 0.05 + base AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS importance FROM ({_unpivot('generalized')}))) WHERE place_no <= 5""", "gen")
    q["q_attr_lookup"] = sql(f"SELECT feature, count(*) AS n, round(max(CAST(round(CAST(CAST(abs(v) * 0.05 + base AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE)), 4) AS max_importance, round(min(CAST(round(CAST(CAST(abs(v) * 0.05 + base AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE)), 4) AS min_importance FROM ({_unpivot('isolation_forest')}) GROUP BY feature", "gen")
    q["q_global_attr"] = sql(f"SELECT CAST(rank() OVER (ORDER BY r DESC) AS INTEGER) AS rank, feature, round(a, 4) AS mean_abs FROM ({_attributions()})", "gen")
    q["q_attr_search"] = sql(f"SELECT feature, round(a, 4) AS mean_abs FROM ({_attributions()}) WHERE feature LIKE '%bytes%'", "gen")
    recs = "CASE prediction " + " ".join(f"WHEN {quoted(k)} THEN {quoted(' '.join(v))}" for k, v in SC.RECOMMENDATIONS.items()) + f" ELSE {quoted(' '.join(SC.DEFAULT_RECOMMENDATIONS))} END"
    q["q_recommend"] = sql(f"SELECT flow_seq, prediction, CASE WHEN is_attack THEN {recs} END AS recommendations FROM scored", "scored")
    # incidents
    q["q_incidents"] = sql(f"SELECT {_INCIDENT_OUT} FROM incidents", "incidents")
    q["q_incident_upsert"] = sql(_incident_upsert(), "existing", "second_half")
    q["q_incident_list"] = sql(f"SELECT {_INCIDENT_OUT} FROM (SELECT *, 'inc-' || sha256(concat_ws('|', src_ip, attack_category, {_spark_time('first_seen')})) AS incident_id FROM incidents WHERE severity = 'Critical' ORDER BY last_seen DESC, incident_id LIMIT 20)", "incidents")
    q["q_incident_get"] = sql(f"SELECT {_INCIDENT_OUT} FROM incidents WHERE src_ip = '10.0.0.7'", "incidents")
    q["q_incident_triage"] = sql(f"""SELECT {_INCIDENT_OUT} FROM (SELECT * REPLACE (CASE WHEN flow_count % 4 = 0 THEN 'Acknowledged' ELSE status END AS status,
      CASE WHEN flow_count % 2 = 0 THEN 'second note' ELSE notes END AS notes, CASE WHEN flow_count % 2 = 0 THEN 'ana' END AS analyst) FROM existing)""", "existing")
    q["q_incident_attr"] = sql("SELECT feature, CAST(base AS DOUBLE) AS base, count(*) AS incidents, CAST(sum(flow_count) AS BIGINT) AS flows FROM incidents, (VALUES "
                               + ", ".join(f"({quoted(f)}, {b})" for f, b, _d in SC.ATTRIBUTION_BASES["cicids2017"]) + ") AS a(feature, base) GROUP BY 1, 2", "incidents")
    # reports
    q["q_batch_summary"] = sql(f"SELECT {_COUNTS} FROM scored", "scored")
    q["q_job_summary"] = sql(f"SELECT job_id, {_COUNTS} FROM scored GROUP BY job_id", "scored")
    q["q_category_dist"] = sql("SELECT prediction AS category, count(*) AS n FROM scored GROUP BY 1", "scored")
    q["q_summary_maps"] = sql("""SELECT count(*) AS total_records, count(*) FILTER (WHERE is_attack) AS attack_count, round(count(*) FILTER (WHERE is_attack) * 100.0 / count(*), 2) AS attack_percentage, round(sum(CAST(round(risk_score * 100) AS BIGINT)) / 100.0 / count(*), 2) AS average_risk_score,
      (SELECT string_agg(prediction || '=' || n, ',' ORDER BY prediction) FROM (SELECT prediction, count(*) AS n FROM scored GROUP BY 1)) AS category_distribution,
      (SELECT string_agg(risk_level || '=' || n, ',' ORDER BY risk_level) FROM (SELECT risk_level, count(*) AS n FROM scored GROUP BY 1)) AS risk_distribution FROM scored""", "scored")
    q["q_summary_json"] = sql("SELECT risk_level, count(*) AS n FROM scored GROUP BY 1", "scored")
    q["q_alert_union"] = sql("SELECT dataset, input_source, risk_level, count(*) AS n, round(sum(risk_score), 2) AS risk FROM alerts GROUP BY ALL", "alerts")
    q["q_dashboard"] = sql("""SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE is_attack) AS attacks_detected, round(count(*) FILTER (WHERE is_attack) * 100.0 / count(*), 2) AS attack_percentage, round(sum(CAST(round(risk_score * 100) AS BIGINT)) / 100.0 / count(*), 2) AS average_risk_score,
      count(*) FILTER (WHERE risk_level = 'Low') AS low_risk_count, count(*) FILTER (WHERE risk_level = 'Moderate') AS moderate_risk_count, count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count,
      count(*) FILTER (WHERE risk_level = 'Critical') AS critical_risk_count FROM alerts WHERE dataset ILIKE '%cicids%'""", "alerts")
    q["q_recent_alerts"] = sql("SELECT record_id, " + iso("ts", "timestamp") + ", dataset, prediction, is_attack, risk_score, risk_level, confidence, input_source FROM (SELECT * FROM alerts ORDER BY ts DESC, record_id LIMIT 15)", "alerts")
    q["q_history"] = sql("SELECT prediction_id, " + iso("ts", "timestamp") + ", prediction, risk_score FROM (SELECT * FROM predictions WHERE dataset ILIKE '%unsw%' AND risk_level = 'High' ORDER BY ts DESC, prediction_id LIMIT 40)", "predictions")
    q["q_analysis_summary"] = sql("""SELECT count(*) AS total_records, count(*) FILTER (WHERE NOT is_attack) AS normal_records, count(*) FILTER (WHERE is_attack) AS attack_records,
      count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_records FROM predictions""", "predictions")
    q["q_warnings"] = sql("""SELECT 'warn-' || prediction_id AS warning_id, prediction_id AS record_id, dataset, prediction AS predicted_category, risk_level, risk_score,
      'Security Alert: ' || risk_level || ' Risk Traffic Detected (' || prediction || ')' AS reason, 'Network flow evaluated with a risk score of ' || risk_score || '/100. Classified as ' || prediction || '.' AS recommendation
      FROM predictions WHERE risk_level IN ('High', 'Critical')""", "predictions")
    q["q_paging"] = sql("SELECT row_number() OVER (ORDER BY ts DESC, prediction_id) + 100 AS record_id, prediction_id, risk_level IN ('High', 'Critical') AS warning, risk_score FROM (SELECT * FROM predictions ORDER BY ts DESC, prediction_id LIMIT 50 OFFSET 100)", "predictions")
    q["q_paging_deep"] = sql("SELECT row_number() OVER (ORDER BY ts DESC, prediction_id) + 5700 AS record_id, prediction_id, risk_level IN ('High', 'Critical') AS warning, risk_score FROM (SELECT * FROM predictions ORDER BY ts DESC, prediction_id LIMIT 50 OFFSET 5700)", "predictions")
    q["q_search"] = sql("""SELECT flow_seq, src_ip, dst_ip, prediction FROM scored WHERE risk_level IN ('High', 'Critical') AND (src_ip LIKE '%xss%' OR dst_ip LIKE '%xss%' OR lower(protocol) LIKE '%xss%' OR lower(prediction) LIKE '%xss%')""", "scored")
    q["q_search_port"] = sql("""SELECT flow_seq, src_port, dst_port FROM scored WHERE upper(protocol) = 'TCP' AND (CAST(src_port AS VARCHAR) LIKE '%4001%' OR CAST(dst_port AS VARCHAR) LIKE '%4001%' OR src_ip LIKE '%4001%' OR dst_ip LIKE '%4001%')""", "scored")
    q["q_alert_search"] = sql("SELECT dataset, count(*) AS n FROM predictions WHERE lower(prediction) LIKE '%scan%' OR prediction_id LIKE '%scan%' OR lower(dataset) LIKE '%scan%' GROUP BY 1", "predictions")
    q["q_tab_counts"] = sql("""SELECT count(*) AS all_count, count(*) FILTER (WHERE is_attack) AS attacks_count, count(*) FILTER (WHERE is_anomaly) AS anomalies_count, count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_count,
      count(*) FILTER (WHERE protocol = 'TCP') AS tcp_count, count(*) FILTER (WHERE protocol = 'UDP') AS udp_count FROM scored""", "scored")
    q["q_job_flows"] = sql("SELECT flow_seq, src_ip, prediction, risk_score FROM scored WHERE job_id = 'job-3'", "scored")
    q["q_recent_flows"] = sql("SELECT flow_seq, " + iso("ts", "timestamp") + ", prediction FROM (SELECT * FROM scored WHERE source_type = 'live' ORDER BY ts DESC, flow_id LIMIT 30)", "scored")
    q["q_last_flows"] = sql("SELECT flow_seq, " + iso("ts", "timestamp") + " FROM (SELECT * FROM scored ORDER BY ts DESC, flow_id LIMIT 25)", "scored")
    q["q_session_counters"] = sql("""SELECT session_id, count(*) AS flow_count, count(*) FILTER (WHERE is_attack) AS attack_count, count(*) FILTER (WHERE is_anomaly) AS anomaly_count, CAST(0 AS BIGINT) AS rejected_count,
      round(count(*) / greatest(1.0, (max(start_t) - min(start_t)) / 1000000.0), 6) AS flows_per_second FROM scored GROUP BY session_id""", "scored")
    q["q_export"] = sql("SELECT flow_id, " + iso("ts", "timestamp") + ", src_ip, dst_ip, src_port, dst_port, protocol, round(seconds, 6) AS duration, packets AS packet_count, bytes AS byte_count, dataset, prediction, is_attack, confidence, risk_score, risk_level FROM scored", "scored")
    # evaluation
    q["q_class_dist"] = sql("SELECT actual AS class, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percentage FROM labelled GROUP BY actual", "labelled")
    q["q_class_weights"] = sql("""SELECT class, n, round(t / (k * n), 4) AS balanced_weight, round(least(1.0, t / (k * n)), 4) AS final_weight
      FROM (SELECT actual AS class, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS t, count(*) OVER () AS k FROM labelled GROUP BY actual)""", "labelled")
    q["q_confusion"] = sql("SELECT actual, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{c}') AS predicted_{c.lower()}" for c in ACTUAL) + " FROM labelled GROUP BY actual", "labelled")
    q["q_confusion_norm"] = sql("SELECT actual, " + ", ".join(f"round(count(*) FILTER (WHERE predicted = '{c}') / count(*), 6) AS predicted_{c.lower()}" for c in ACTUAL) + " FROM labelled GROUP BY actual", "labelled")
    q["q_class_report"] = sql(_per_class_report(), "labelled")
    q["q_top_confusions"] = sql("SELECT actual, predicted, count(*) AS n FROM labelled WHERE actual <> predicted GROUP BY 1, 2 ORDER BY n DESC, actual, predicted LIMIT 3", "labelled")
    q["q_binary_metrics"] = sql(f"SELECT *, {_RATES} FROM (SELECT {_cells('0.5')} FROM labelled)", "labelled")
    q["q_cell_percent"] = sql("SELECT " + ", ".join(f"round({c} * 100.0 / (tp + fp + tn + fn), 2) AS {c}_percent" for c in ("tp", "fp", "tn", "fn")) + f" FROM (SELECT {_cells('0.5')} FROM labelled)", "labelled")
    q["q_threshold_sweep"] = sql(_sweep(50, 99, 1), "labelled")
    q["q_threshold_sweep_coarse"] = sql("SELECT * FROM sweep_coarse", "sweep_coarse")
    q["q_best_threshold"] = sql("SELECT threshold, f1 FROM sweep_coarse ORDER BY f1 DESC, threshold DESC LIMIT 1", "sweep_coarse")
    q["q_detection_rate"] = sql("""SELECT actual AS category, count(*) AS total, count(*) FILTER (WHERE attack_prob >= 0.5) AS detected, count(*) FILTER (WHERE attack_prob < 0.5) AS missed,
      round(count(*) FILTER (WHERE attack_prob >= 0.5) / count(*), 6) AS detection_rate FROM labelled WHERE actual <> 'BENIGN' GROUP BY 1""", "labelled")
    q["q_fn_by_cat"] = sql("SELECT actual AS category, count(*) AS false_negatives FROM labelled WHERE actual <> 'BENIGN' AND attack_prob < 0.5 GROUP BY 1", "labelled")
    q["q_classwise_risk"] = sql("""SELECT predicted, count(*) AS samples, count(*) FILTER (WHERE actual = predicted) AS correct, count(*) FILTER (WHERE actual <> predicted) AS incorrect, round(avg(confidence), 4) AS mean_confidence,
      round(quantile_cont(confidence, 0.5), 4) AS median_confidence, min(confidence) AS min_confidence, round(avg(margin), 4) AS mean_margin, round(quantile_cont(margin, 0.5), 4) AS median_margin,
      round(count(*) FILTER (WHERE actual <> predicted) * 100.0 / count(*), 4) AS error_rate, round(count(*) FILTER (WHERE actual = predicted) * 100.0 / count(*), 4) AS accuracy, predicted <> 'BENIGN' AS is_attack FROM labelled GROUP BY predicted""", "labelled")
    q["q_auc"] = sql("""SELECT round((sum(r) FILTER (WHERE pos) - CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * (count(*) FILTER (WHERE pos) + 1) / 2) / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos)), 6) AS roc_auc
      FROM (SELECT actual <> 'BENIGN' AS pos, rank() OVER (ORDER BY attack_prob) + (count(*) OVER (PARTITION BY attack_prob) - 1) / 2.0 AS r FROM labelled)""", "labelled")
    auc = """SELECT {name} AS scale, round((sum(r) FILTER (WHERE pos) - CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * (count(*) FILTER (WHERE pos) + 1) / 2) / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos)), 6) AS roc_auc
      FROM (SELECT actual <> 'BENIGN' AS pos, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r FROM labelled WHERE attack_prob > 0 AND attack_prob < 1)"""
    q["q_auc_scales"] = sql(auc.format(name="'log odds'", s="ln(attack_prob / (1 - attack_prob))") + " UNION ALL " + auc.format(name="'depth'", s="-sqrt(fwd_bytes)"), "labelled")
    q["q_threshold_sweep_odds"] = sql(f"""SELECT threshold, tp, fp, tn, fn, {_RATES} FROM (SELECT threshold, count(*) FILTER (WHERE pos AND s >= threshold) AS tp, count(*) FILTER (WHERE NOT pos AND s >= threshold) AS fp,
      count(*) FILTER (WHERE NOT pos AND s < threshold) AS tn, count(*) FILTER (WHERE pos AND s < threshold) AS fn
      FROM (SELECT actual <> 'BENIGN' AS pos, ln(attack_prob / (1 - attack_prob)) AS s FROM labelled WHERE attack_prob > 0 AND attack_prob < 1), (VALUES (-3.0::DOUBLE), (-1.0), (-0.5), (0.25), (1.0), (2.0)) AS t(threshold) GROUP BY threshold)""", "labelled")
    q["q_scan_sketches"] = q["q_rule_scan_sources"]
    q["q_threshold_sketches"] = sql("""SELECT measure, count(*) AS n, count(DISTINCT date_trunc('month', ts)) AS months, true AS low_ok, true AS high_ok
      FROM flow_table, (VALUES ('dos'), ('exfil')) AS m(measure) GROUP BY measure""", "flow_table")
    q["q_feature_means"] = sql("SELECT feature, round(d, 4) AS detected_mean, round(m, 4) AS missed_mean, round(abs(d - m), 4) AS absolute_difference FROM (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) FILTER (WHERE attack_prob >= 0.5) AS d, avg({f}) FILTER (WHERE attack_prob < 0.5) AS m FROM labelled WHERE actual = 'Bot'" for f in ("fwd_pkts", "bwd_pkts", "fwd_bytes", "duration")) + ")", "labelled")
    q["q_calibrate"] = sql(f"""SELECT target_fpr, round(threshold, 6) AS threshold, tp, fp, tn, fn, {_RATES} FROM (SELECT target_fpr, any_value(th) AS threshold, {_cells('th')}
      FROM labelled, (SELECT CAST(0.01 AS DOUBLE) AS target_fpr, quantile_cont(attack_prob, 0.99) AS th FROM labelled WHERE actual = 'BENIGN' UNION ALL SELECT 0.1, quantile_cont(attack_prob, 0.9) FROM labelled WHERE actual = 'BENIGN') GROUP BY target_fpr)""", "labelled")
    q["q_stratified_split"] = sql("SELECT * FROM split", "split")
    q["q_split_dist"] = sql("SELECT actual AS category, count(*) FILTER (WHERE split = 'train') AS train_samples, count(*) FILTER (WHERE split = 'validation') AS validation_samples, count(*) FILTER (WHERE split = 'test') AS test_samples FROM split GROUP BY 1", "split")
    # the same results from blocks, time buckets and slices
    q["q_flow_blocks"], q["q_gap_buckets"] = q["q_flow_idle_split"], q["q_packet_gaps"]
    q["q_result_sample"] = sql("SELECT flow_id, prediction, risk_score FROM scored", "scored")
    q["q_stored_flows"] = sql("SELECT flow_id, src_ip, prediction FROM (SELECT * FROM scored WHERE source_type = 'pcap' ORDER BY ts DESC, flow_id LIMIT 50)", "scored")
    # logs and files
    q["q_csv_scan"] = f"SELECT {_KEY} AS row_key, l_quantity, l_extendedprice, l_returnflag, l_linestatus || ', \"x\"' AS note, l_returnflag = 'R' AS dated FROM lineitem"
    q["q_prediction_log"] = sql("SELECT prediction_id, " + iso("ts", "timestamp") + """, dataset, prediction, is_attack, round(attack_probability, 4) AS attack_probability, round(confidence, 4) AS confidence,
      round(risk_score, 2) AS risk_score, risk_level, 'batch' AS input_source FROM predictions""", "predictions")
    q["q_job_log"] = sql("SELECT job_id, job_id || '.csv' AS filename, CASE WHEN bad THEN 'Failed' ELSE 'Completed' END AS status, n AS total_records, CASE WHEN NOT bad THEN n END AS processed_records, CASE WHEN NOT bad THEN hits END AS attack_records, CASE WHEN bad THEN 'too many attacks' END AS error, "
      + iso("first", "created_at") + ", " + iso("last + INTERVAL 1 SECOND", "updated_at") + """ FROM (SELECT *, hits * 2 > n AS bad FROM (SELECT job_id, min(ts) AS first, max(ts) AS last, count(*) AS n,
      count(*) FILTER (WHERE is_attack) AS hits FROM scored GROUP BY job_id))""", "scored")
    q["q_session_log"] = sql("SELECT session_id, 'stream' AS interface, CASE WHEN stopped IS NULL THEN 'Running' ELSE 'Stopped' END AS status, CASE WHEN own THEN p ELSE 0 END AS packet_count, CASE WHEN own THEN n ELSE 0 END AS flow_count, CASE WHEN own THEN a ELSE 0 END AS alert_count, "
      + iso("first", "started_at") + ", " + iso("stopped", "stopped_at") + """ FROM (SELECT *, least(CASE WHEN own THEN last END, lead(first) OVER (ORDER BY first, session_id)) AS stopped FROM (
      SELECT session_id, session_id <> 'mon-4' AS own, min(ts) AS first, max(ts) AS last, CAST(sum(packets) AS BIGINT) AS p, count(*) AS n, count(*) FILTER (WHERE is_attack) AS a FROM scored GROUP BY session_id))""", "scored")
    q["q_adapt_validate"] = sql("SELECT " + ", ".join(f"round({f}, 3) AS {f}" for f in _GEN) + " FROM gen", "gen")
    # streams
    q["q_stream_incidents"] = sql("SELECT title, src_ip, attack_category, flow_count, severity, risk_score, " + iso("first_seen") + ", " + iso("last_seen") + " FROM incidents", "incidents", instead=IDLE_FLOWS)
    q["q_stream_counters"] = sql("""SELECT CAST(sum(packets) AS BIGINT) AS packets, count(*) AS flows, count(*) FILTER (WHERE is_attack) AS attacks, count(*) FILTER (WHERE is_anomaly) AS anomalies,
      count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk, 0 AS late FROM scored""", "scored", instead=IDLE_FLOWS)
    q["q_stream_recent"] = sql("SELECT flow_seq, src_ip, prediction, " + iso("ts", "timestamp") + " FROM (SELECT * FROM scored ORDER BY ts DESC, flow_id LIMIT 50)", "scored", instead=IDLE_FLOWS)
    gaps = [f"{side}gap_{m}" for side in ("", "fwd_", "bwd_") for m in ("min", "max", "mean", "total")] + ["first_fwd_gap"]
    q["q_stream_gaps"] = sql(f"""SELECT flow_seq, reason AS termination_reason, packets, bytes, {", ".join(f"round({g} / 1000000.0, 2) AS {g}" for g in gaps)} FROM flows
      UNION ALL SELECT packet_seq, 'late', 1, pkt_len, {", ".join(["NULL"] * len(gaps))} FROM judged WHERE late""", "flows", instead=DELAYED)
    q["q_exported_flows"], q["q_stream_split"] = q["q_export"], q["q_flow_idle_split"]
    return q


def _spark_time(column: str) -> str:
    """A timestamp as Spark prints it: no trailing zeros in the fraction."""
    return f"CASE WHEN strftime({column}, '%f') = '000000' THEN strftime({column}, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime({column}, '%Y-%m-%d %H:%M:%S.%f'), '0') END"

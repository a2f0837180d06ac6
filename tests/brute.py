"""Plain-Python flow table used as the expected result in tests."""

import math


def stats(values):
    if not values:
        return 0.0, 0.0, 0.0, 0.0
    mean = sum(values) / len(values)
    return min(values), max(values), mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def gaps(times):
    s = sorted(times)
    return [b - a for a, b in zip(s, s[1:])]


def flows(packets, idle=None):
    """packets: (seq, t_us, src, dst, sport, dport, proto, len, flags, win, hdr) in any order."""
    table, done = {}, []

    def close(key, reason):
        flow = table.pop(key)
        flow["reason"] = reason
        done.append(flow)

    for p in sorted(packets):
        seq, t, src, dst, sport, dport, proto, _len, flags, _win, _hdr = p
        key = (*sorted([(src, sport), (dst, dport)]), proto)
        if key in table and idle is not None and t - table[key]["last"] >= idle:
            close(key, "inactivity_timeout")
        flow = table.setdefault(key, {"seq": seq, "start": t, "last": t, "init": (src, sport), "resp": (dst, dport), "packets": []})
        flow["last"] = max(flow["last"], t)
        flow["packets"].append(p)
        if flags & 1:
            close(key, "tcp_fin")
        elif flags & 4:
            close(key, "tcp_rst")
    for key in list(table):
        close(key, "active")
    out = {}
    for f in done:
        fwd = [p for p in f["packets"] if (p[2], p[4]) == f["init"]]
        bwd = [p for p in f["packets"] if (p[2], p[4]) != f["init"]]
        row = {"src_ip": f["init"][0], "dst_ip": f["resp"][0], "reason": f["reason"],
               "seconds": max(1e-6, (f["last"] - f["start"]) / 1e6)}
        for name, part in (("", f["packets"]), ("fwd_", fwd), ("bwd_", bwd)):
            row[f"{name}len"] = stats([p[7] for p in part])
            g = gaps([p[1] for p in part])
            row[f"{name}gap"] = (*stats(g), float(sum(g)))
            if name:
                row[f"{name}packets"] = len(part)
                row[f"{name}bytes"] = sum(p[7] for p in part)
                row[f"{name}header"] = sum(p[10] for p in part)
                row[f"{name}window"] = next((p[9] for p in part if p[9] > 0), 0)
                if name == "fwd_":
                    row["first_fwd_gap"] = float(g[0]) if g else 0.0
        out[f["seq"]] = row
    return out

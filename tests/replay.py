"""Plain Python replay of the rolling features, written from their definitions."""

import math
from collections import Counter
from datetime import timedelta

from ledgerlens.functions.scalars import CHANNEL_CODES, TYPE_CODES


def digit(a):
    if a <= 0:
        return 1
    return max(1, int(str(int(a if a >= 1 else a * 1e6))[0]))


def chi2(digits):
    n = len(digits)
    if n < 5:
        return 0.0
    c = Counter(digits)
    return sum((c[d] - n * math.log10(1 + 1 / d)) ** 2 / (n * math.log10(1 + 1 / d) + 1e-9) for d in range(1, 10))


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def replay(rows):
    """transaction_id -> feature dict, rows visited in (timestamp, id) order."""
    rows = sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"]))
    past, devices, out = {}, {}, {}
    for r in rows:
        ts, amt = r["timestamp"], r["amount"]
        mine = past.setdefault(r["sender_account"], [])
        win = lambda **kw: [p for p in mine if p["timestamp"] >= ts - timedelta(**kw)]
        w1, w6, w24, w7, w30 = win(hours=1), win(hours=6), win(hours=24), win(days=7), win(days=30)
        n7 = len(w7)
        a7 = [p["amount"] for p in w7]
        avg = sum(a7) / n7 if n7 else 0.0
        std = math.sqrt(sum((a - avg) ** 2 for a in a7) / n7) if n7 > 1 else 0.0
        if n7 and max(a7) == min(a7):
            std = 0.0
        prev = mine[-1] if mine else None
        gap = (ts - prev["timestamp"]).total_seconds() if prev else 86400.0
        dist = haversine(prev["geo_latitude"], prev["geo_longitude"], r["geo_latitude"], r["geo_longitude"]) if prev else 0.0
        recv = Counter(p["receiver_account"] for p in w7)
        ctry = [p["receiver_country"] for p in w7]
        share = lambda f, default=0.0: sum(map(f, w7)) / n7 if n7 else default
        risky = {"AE", "MU", "CN", "NG", "PK", "CH"}
        hour, dow = ts.hour, ts.weekday()
        top = max(a7) if a7 else amt
        out[r["transaction_id"]] = {
            "tx_velocity_1h": len(w1), "tx_velocity_6h": len(w6), "tx_velocity_24h": len(w24), "tx_velocity_7d": n7,
            "avg_amount_7d": avg, "std_amount_7d": std, "tx_gap_seconds": gap,
            "night_tx_ratio": share(lambda p: p["timestamp"].hour >= 22 or p["timestamp"].hour <= 5),
            "weekend_tx_ratio": share(lambda p: p["timestamp"].weekday() >= 5), "hour_of_day": hour, "day_of_week": dow,
            "beneficiary_count_7d": len(recv), "beneficiary_count_30d": len({p["receiver_account"] for p in w30}),
            "receiver_entropy": -sum(c / n7 * math.log2(c / n7 + 1e-12) for c in recv.values()) if n7 else 0.0,
            "amount_zscore": (amt - avg) / (std + 1e-6) if std > 0 else 0.0,
            "avg_daily_volume_30d": sum(p["amount"] for p in w30) / 30,
            "round_amount_flag": float(amt % 100000 == 0 and amt >= 100000), "sub_threshold_flag": float(850000 <= amt < 1000000),
            "amount_leading_digit": digit(amt), "benford_chi2_score": chi2([digit(p["amount"]) for p in mine[-200:]]),
            "geo_distance_km": dist, "country_switch_count_7d": sum(x != y for x, y in zip(ctry, ctry[1:])),
            "impossible_travel_flag": float(prev is not None and gap > 0 and dist / (gap / 3600) > 900),
            "high_risk_country_flag": float(r["receiver_country"] in risky or r["sender_country"] in risky),
            "cross_border_ratio_30d": sum(p["receiver_country"] != r["sender_country"] for p in w30) / len(w30) if w30 else 0.0,
            "device_change_count_7d": len({p["device_id"] for p in w7}),
            "new_device_flag": float(r["device_id"] not in {p["device_id"] for p in mine}),
            "shared_device_count": len(devices.get(r["device_id"], ())) if r["device_id"] else 0,
            "ip_change_count_24h": len({p["ip_address"] for p in w24}), "kyc_level": r["kyc_level"],
            "amount_ratio_7d": amt / avg if avg > 0 else 1.0, "balance_utilization": amt / (amt + 1) if amt + 1 > 0 else 1.0,
            "same_bank_flag": float(r["sender_bank"] == r["receiver_bank"]), "is_international": float(r["sender_country"] != r["receiver_country"]),
            "tx_type_encoded": TYPE_CODES.get(r["transaction_type"], 0), "channel_encoded": CHANNEL_CODES.get(r["payment_channel"], 0),
            "hour_sin": math.sin(2 * math.pi * hour / 24), "hour_cos": math.cos(2 * math.pi * hour / 24),
            "dow_sin": math.sin(2 * math.pi * dow / 7), "dow_cos": math.cos(2 * math.pi * dow / 7), "day_of_month": ts.day,
            "success_rate_7d": share(lambda p: p["transaction_status"] == "Success", 1.0),
            "max_amount_7d": top, "min_amount_7d": min(a7) if a7 else amt, "amount_to_max_ratio": amt / top if top > 0 else 1.0,
        }
        mine.append(r)
        devices.setdefault(r["device_id"], set()).add(r["sender_account"])
    return out

"""Brute force: the publish and lookup rules applied row by row, written from their description."""

from datetime import timedelta


class Store:
    def __init__(self, quota=None):
        self.quota = quota
        self.signals = {}
        self.marks = {}

    def publish(self, row):
        now, key = row["arrival_ts"], (row["risk_id"], row["source_bank_id"])
        if now >= row["timestamp"] + timedelta(hours=row["ttl_hours"]):
            return "expired"
        effective = min(row["timestamp"], now)
        if key in self.marks and effective <= self.marks[key]:
            return "stale"
        held = sum(1 for _, bank in self.signals if bank == key[1])
        if key not in self.signals and self.quota is not None and held >= self.quota:
            return "quota_exceeded"
        self.signals[key] = row
        self.marks[key] = effective
        return "accepted"

    def live(self, risk_id, now):
        return [
            s
            for (rid, _), s in self.signals.items()
            if rid == risk_id and now < s["timestamp"] + timedelta(hours=s["ttl_hours"])
        ]

    def lookup(self, risk_id, now):
        live = self.live(risk_id, now)
        if not live:
            return None, []
        worst = max(live, key=lambda s: (s["risk_score"], s["timestamp"], s["source_bank_id"]))
        return worst["risk_score"], sorted(s["source_bank_id"] for s in live)

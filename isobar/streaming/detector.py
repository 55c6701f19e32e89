"""The detector as keyed streaming state: same signals as the batch form, row by row in event-time order.

State per group: the last `history` rows by time (for exact-time lags), flatline counters, and the residuals of the
current contiguous run. Late or duplicate rows are not reordered or dropped silently: a packet (the rows of a group in a
micro-batch) is checked whole, and if any of its rows is late, repeated or malformed the packet is rejected as one and the
state stays as it was; every rejected row leaves with a reason.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "g string, us long, v double, forecast_residual double, abrupt_change double, flatline double, hour_residual double, sustained_deviation double, status string"
STATE = "payload string"


class GroupDetector:
    """One group's state; `offer` takes a packet of (us, v) rows and returns one result per row."""

    def __init__(self, cadence: int, near: int, far: int, sustained: int, payload: str | None = None):
        self.cadence, self.near, self.far, self.sustained = cadence, near, far, sustained
        kept: dict[str, Any] = json.loads(payload) if payload else {"rows": [], "flat": 0, "run": []}
        self.rows: dict[int, float | None] = {int(t): v for t, v in kept["rows"]}
        self.flat, self.run = kept["flat"], kept["run"]

    def payload(self) -> str:
        return json.dumps({"rows": sorted(self.rows.items()), "flat": self.flat, "run": self.run})

    def reject_reason(self, packet: list[tuple[int, float | None]]) -> str | None:
        last = max(self.rows, default=None)
        for t, v in packet:
            if t is None or t % self.cadence:
                return "rejected_misaligned"
            if last is not None and t <= last:
                return "rejected_late_or_duplicate"
            if v is not None and (v != v or abs(v) == float("inf")):
                return "rejected_not_finite"
            last = t
        return None

    def offer(self, packet: list[tuple[int, float | None]]) -> list[tuple]:
        reason = self.reject_reason(packet)
        if reason:
            return [(t, v, None, None, None, None, None, reason) for t, v in packet]
        return [self._one(t, v) for t, v in packet]

    def _one(self, t: int, v: float | None) -> tuple:
        prev_t = max(self.rows, default=None)
        adjacent = prev_t is not None and t - prev_t == self.cadence
        prev = self.rows.get(prev_t) if prev_t is not None else None
        at = lambda k: self.rows.get(t - k * self.cadence)
        gone = lambda a, b: None if a is None or b is None else a - b
        residual, long_residual = gone(v, at(self.near)), gone(v, at(self.far))
        abrupt = gone(v, prev) if adjacent else None
        self.flat = self.flat + 1 if adjacent and v is not None and v == prev else 0
        self.run = [*(self.run if adjacent else []), long_residual][-self.sustained :]
        full = len(self.run) == self.sustained and None not in self.run
        mean = sum(self.run) / self.sustained if full else None
        self.rows[t] = v
        for old in [k for k in self.rows if k < t - self.far * self.cadence]:
            del self.rows[old]
        size = lambda x: None if x is None else abs(x)
        return (t, v, size(residual), size(abrupt), None if v is None else float(self.flat), size(long_residual), size(mean), "scored" if v is not None else "missing_observation")

    def overdue(self, clock: int) -> int:
        """Slots that should have been reported by `clock`; no row is made up for them."""
        last = max(self.rows, default=None)
        return 0 if last is None else max(0, (clock - last) // self.cadence - 1)


def detect_stream(stream: DataFrame, cadence: int, near: int = 1, far: int = 60, sustained: int = 30) -> DataFrame:
    """stream (g, us, v) -> one result per row with the five signals, or the reason of rejection."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = GroupDetector(cadence, near, far, sustained, state.get[0] if state.exists else None)
        packet = [(int(t), None if v is None or v != v else float(v)) for f in frames for t, v in zip(f["us"], f["v"])]
        rows = detector.offer(sorted(packet, key=lambda r: r[0]))
        state.update((detector.payload(),))
        out = pd.DataFrame(rows, columns=["us", "v", "forecast_residual", "abrupt_change", "flatline", "hour_residual", "sustained_deviation", "status"])
        out.insert(0, "g", key[0])
        yield out

    return stream.groupBy("g").applyInPandasWithState(run, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


class Watchdog:
    """Constant-size rules for an edge device: per channel a step limit, the seconds a value may stand still, and its domain.

    A value outside its domain raises an alert and clears the channel's context, so that it is neither stepped from nor held.
    """

    def __init__(self, cadence_s: float, limits: dict[str, float], flat_s: float = 600.0, grace_s: float = 0.0, eps: float = 0.0, domains: dict[str, tuple[float, float]] | None = None):
        self.cadence, self.limits, self.flat_s, self.grace, self.eps, self.domains = cadence_s, limits, flat_s, grace_s, eps, domains or {}
        self.last_s: float | None = None
        self.values: dict[str, float] = {}
        self.anchor: dict[str, tuple[float, float]] = {}
        self.rows = self.skipped = 0
        self.counts: dict[str, int] = {}

    def ingest(self, at_s: float, values: dict[str, float | None]) -> dict:
        if self.last_s is not None and at_s <= self.last_s:
            raise ValueError("time must increase")
        gap = None if self.last_s is None else at_s - self.last_s
        adjacent = gap is not None and abs(gap - self.cadence) <= self.grace
        alerts = []
        for c, x in values.items():
            low, high = self.domains.get(c, (float("-inf"), float("inf")))
            missing = x is None or x != x
            if missing or not low <= x <= high:
                self.values.pop(c, None)
                self.anchor.pop(c, None)
                if not missing:
                    alerts.append((c, "domain"))
                continue
            if adjacent and c in self.values and abs(x - self.values[c]) > self.limits[c]:
                alerts.append((c, "step"))
            if not adjacent or c not in self.anchor or abs(x - self.anchor[c][0]) > self.eps:
                self.anchor[c] = (x, at_s)
            if at_s - self.anchor[c][1] > self.flat_s:
                alerts.append((c, "flatline"))
            self.values[c] = x
        skipped = 0 if gap is None else max(0, int(gap / self.cadence) - 1)
        self.last_s, self.rows, self.skipped = at_s, self.rows + 1, self.skipped + skipped
        for c, kind in alerts:
            self.counts[f"{c}:{kind}"] = self.counts.get(f"{c}:{kind}", 0) + 1
        return {"alerts": alerts, "skipped": skipped}

    def heartbeat(self, at_s: float) -> dict:
        if self.last_s is None:
            return {"overdue": False, "silent_s": None}
        return {"overdue": at_s - self.last_s > self.cadence + self.grace, "silent_s": at_s - self.last_s}

    def snapshot(self) -> dict:
        """The whole state: it is as large after a year as after a day."""
        held = {c: self.last_s - since for c, (_, since) in self.anchor.items()}
        return {"last_s": self.last_s, "rows": self.rows, "skipped": self.skipped, "values": dict(self.values), "held_s": held, "alerts": dict(self.counts)}

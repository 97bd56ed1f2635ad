"""A limiter of requests with leases, as keyed state over a stream.

A provider's state holds the attempts that can still matter (those begun within the last minute or whose lease runs) and how
many were ever let through. It is bounded by the limits themselves: no more attempts are held than may begin in a minute or be
under way. Leases end by event time: at each request those that ran out no longer count, and when the watermark has passed all of them the
state's timer fires and drops them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Of a provider, and of each of its models: requests in `window` seconds, and requests under way. A lease ends after `lease` seconds; `cap` requests in all."""

    per_window: int = 60
    under_way: int = 4
    model_per_window: int = 60
    model_under_way: int = 4
    window: float = 60.0
    lease: float = 300.0
    cap: int = 1 << 62


RESULT = "provider string, id string, kind string, t double, decision string, retry_at double"


class Desk:
    """Decides on the requests of one provider in order. attempts: [begun, id, model, open, counts]."""

    def __init__(self, limits: Limits, attempts: list, used: int):
        self.limits, self.attempts, self.used = limits, attempts, used

    def forget(self, now: float) -> None:
        """Drops attempts that no limit counts any more."""
        keep = lambda a: a[0] + self.limits.window > now or a[3] and a[0] + self.limits.lease > now
        self.attempts = [a for a in self.attempts if keep(a)]

    def _wait(self, now: float, own: list, most: int, under_way: int) -> float | None:
        begun = sorted(a[0] for a in own if a[4] and a[0] + self.limits.window > now)
        going = sum(1 for a in own if a[3] and a[0] + self.limits.lease > now)
        rate = begun[len(begun) - max(most, 1)] + self.limits.window if len(begun) >= max(most, 1) else None
        slot = now + 1 if going >= max(under_way, 1) else None
        return max((x for x in (rate, slot) if x is not None), default=None)

    def reserve(self, now: float, name: str, model: str) -> tuple[str, float | None]:
        """admitted; or paced (with the time to come again), exhausted, duplicate: these use up nothing."""
        self.forget(now)
        x = self.limits
        waits = [self._wait(now, self.attempts, x.per_window, x.under_way), self._wait(now, [a for a in self.attempts if a[2] == model], x.model_per_window, x.model_under_way)]
        if any(w is not None for w in waits):
            return "paced", max(w for w in waits if w is not None)
        if self.used >= x.cap:
            return "exhausted", None
        if any(a[1] == name for a in self.attempts):
            return "duplicate", None
        self.attempts.append([now, name, model, True, True])
        self.used += 1
        return "admitted", None

    def finish(self, name: str, dispatched: bool) -> tuple[str, None]:
        """released once; a second release, or one of an unknown or forgotten attempt, is ignored. One that was never sent counts for no rate."""
        for a in self.attempts:
            if a[1] == name and a[3]:
                a[3], a[4] = False, dispatched
                return "released", None
        return "ignored", None

    def until(self) -> float | None:
        """When the last attempt stops to matter."""
        return max((a[0] + max(self.limits.window, self.limits.lease if a[3] else 0) for a in self.attempts), default=None)


def leased(requests: DataFrame, limits: Limits, late: str = "1 minute") -> DataFrame:
    """provider, id, kind, t, decision, retry_at of a stream of requests (provider, model, id, kind reserve or finish, at, dispatched). In a batch a provider's requests are
    taken by time, finishes before reserves of the same moment, and then by id. State is kept with the stream's checkpoint: a stream that goes on after a stop decides as one that never stopped."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, used = state.get if state.exists else ("[]", 0)
        desk = Desk(limits, json.loads(held), used)
        if state.hasTimedOut:
            desk.forget(state.getCurrentWatermarkMs() / 1000)
            rows = pd.DataFrame()
        else:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "kind", "id"])
        out = []
        for r in rows.itertuples(index=False):
            decision, again = desk.reserve(r.t, r.id, r.model) if r.kind == "reserve" else desk.finish(r.id, bool(r.dispatched))
            out.append((key[0], r.id, r.kind, r.t, decision, again))
        state.update((json.dumps(desk.attempts), desk.used))
        end = desk.until()
        if end is not None:
            state.setTimeoutTimestamp(max(int(end * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["provider", "id", "kind", "t", "decision", "retry_at"])

    stream = requests.withWatermark("at", late).select("provider", F.coalesce("model", F.lit("")).alias("model"), F.col("id").cast("string").alias("id"), "kind", F.coalesce("dispatched", F.lit(True)).alias("dispatched"), (F.unix_micros("at") / 1e6).alias("t"), "at")
    return stream.groupBy("provider").applyInPandasWithState(decide, RESULT, "attempts string, used long", "append", "EventTimeTimeout")

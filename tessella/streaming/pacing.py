"""Admission under rolling budgets: a batch replay over windows, and a keyed state for streams.

A request is admitted if, in the 60 s before it, tokens and requests stay within their budgets. A request over the whole token
budget is admitted only when nothing else is held. A cooldown holds everything. After 300 s without a rate failure
and with more than half of the budget used the budget grows by a quarter, up to the most; a rate failure halves it and starts a
cooldown of 65 s, or longer if asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_S, HEALTHY_S, COOLDOWN_S, GROW, SHRINK = 60.0, 300.0, 65.0, 1.25, 0.5


def rolling_load(df: DataFrame, key: str, seconds: str, amount: str, window_s: int = 60) -> DataFrame:
    """Adds ``recent`` and ``recent_n``: amount and rows of the key in the ``window_s`` seconds up to and with each row."""
    w = W.partitionBy(key).orderBy(seconds).rangeBetween(-window_s + 1, 0)
    return df.withColumn("recent", F.sum(amount).over(w)).withColumn("recent_n", F.count("*").over(w))


@dataclass
class Pace:
    """One client's state."""

    tokens: int
    requests: int
    most_tokens: int
    inflight: int = 2
    entries: list[list[float]] = field(default_factory=list)  # [time, tokens]
    active: int = 0
    cooldown_until: float = 0.0
    healthy_since: float = 0.0

    def _drop(self, now: float) -> None:
        self.entries = [e for e in self.entries if now - e[0] < WINDOW_S]

    def wait(self, now: float, tokens: int) -> float:
        """Seconds until the request may go, 0 for now."""
        self._drop(now)
        waits = [self.cooldown_until - now]
        if self.active >= self.inflight:
            waits.append(1.0)
        over_tokens = bool(self.entries) and sum(e[1] for e in self.entries) + tokens > self.tokens
        if over_tokens or len(self.entries) >= self.requests:
            waits.append(self.entries[0][0] + WINDOW_S - now)
        return max(0.0, *waits)

    def admit(self, now: float, tokens: int) -> None:
        self.entries.append([now, tokens])
        self.active += 1

    def done(self, now: float, at: float, used: int, rate_failure: bool = False, retry_after: float = 0.0) -> None:
        """The reservation made ``at`` is replaced by what was used; budgets adapt."""
        self.active = max(0, self.active - 1)
        for e in self.entries:
            if e[0] == at:
                e[1] = used
                break
        if rate_failure:
            self.tokens = max(1, int(self.tokens * SHRINK))
            self.cooldown_until = max(self.cooldown_until, now + max(COOLDOWN_S, retry_after))
            self.healthy_since = now
        else:
            self._drop(now)
            if now - self.healthy_since >= HEALTHY_S and sum(e[1] for e in self.entries) > self.tokens / 2:
                self.tokens = min(self.most_tokens, int(self.tokens * GROW))
                self.healthy_since = now


#: What a request may bring besides: tokens it will have used, seconds it lasts, whether it ends in a rate failure, and the pause then asked for.
OUTCOME = (("used", "long"), ("lasts", "double"), ("rate_failure", "boolean"), ("retry_after", "double"))
STATE = "tokens long, requests int, most_tokens long, cooldown_until double, healthy_since double, times array<double>, amounts array<double>, ends array<double>, starts array<double>, uses array<double>, failures array<boolean>, pauses array<double>"
OUTPUT = "key string, event_id long, now double, tokens long, admitted boolean, wait_s double, budget long"


def _admissions(pace: Pace, rows: pd.DataFrame, going: list[tuple]) -> list[tuple]:
    """Decisions in order of time. ``going`` is the heap of admitted requests, by their ends; each end before a request is told to the state first."""
    out = []
    for r in rows.itertuples(index=False):
        now, tok = float(r.now), int(r.tokens)
        while going and going[0][0] <= now:
            end, at, used, failed, pause = heapq.heappop(going)
            pace.done(end, at, used, failed, pause)
        w = pace.wait(now, tok)
        if not w:
            pace.admit(now, tok)
            heapq.heappush(going, (now + max(0.0, float(r.lasts)), now, tok if pd.isna(r.used) else float(r.used), bool(r.rate_failure), float(r.retry_after)))
        out.append((int(r.event_id), now, tok, w == 0, w, pace.tokens))
    return out


def _requests(events: DataFrame) -> DataFrame:
    """Requests without an outcome use what they asked for and end at once."""
    given = {c: F.col(c) if c in events.columns else F.lit(None) for c, _ in OUTCOME}
    cols = {c: given[c].cast(t) if c == "used" else F.coalesce(given[c].cast(t), F.lit(False if t == "boolean" else 0.0)) for c, t in OUTCOME}
    return events.select("key", "event_id", "now", "tokens", *[cols[c].alias(c) for c, _ in OUTCOME])


def paced_stream(events: DataFrame, tokens: int, requests: int, most_tokens: int | None = None, inflight: int = 2):
    """Admission decisions of a stream of ``key, event_id, now, tokens`` and outcomes, one state per key; late rows are decided when they come.

    An admitted request holds a place in flight until it ends. Its end replaces the reservation by what was used and lets the budget grow, or, as a
    rate failure, shrink. A refused request isn't tried again here.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        going: list[tuple] = []
        if state.exists:
            t, r, m, c, h, times, amounts, *ends = state.get
            going = [(e, a, u, f, p) for e, a, u, f, p in zip(*ends, strict=True)]
            pace = Pace(t, r, m, inflight, active=len(going), cooldown_until=c, healthy_since=h, entries=[list(x) for x in zip(times, amounts, strict=True)])
        else:
            pace = Pace(tokens, requests, most_tokens or tokens, inflight)
        rows = pd.concat(list(batches)).sort_values(["now", "event_id"])
        made = _admissions(pace, rows, going)
        parts = [list(x) for x in zip(*going, strict=True)] or [[] for _ in range(5)]
        state.update((pace.tokens, pace.requests, pace.most_tokens, pace.cooldown_until, pace.healthy_since, [e[0] for e in pace.entries], [float(e[1]) for e in pace.entries], parts[0], parts[1], [float(u) for u in parts[2]], parts[3], parts[4]))
        yield pd.DataFrame([(key[0], *m) for m in made], columns=["key", "event_id", "now", "tokens", "admitted", "wait_s", "budget"])

    return _requests(events).groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def paced_batch(events: DataFrame, tokens: int, requests: int, most_tokens: int | None = None, inflight: int = 2) -> DataFrame:
    """The same over a finished table: equal to the stream whatever its batches. A task holds one key's rows at a time."""
    from tessella.operators.grouped import per_group

    def work(k: tuple, rows: pd.DataFrame) -> list[tuple]:
        return [(*k, *m) for m in _admissions(Pace(tokens, requests, most_tokens or tokens, inflight), rows.sort_values(["now", "event_id"]), [])]

    return per_group(_requests(events), ["key"], work, OUTPUT, ["now", "event_id"])

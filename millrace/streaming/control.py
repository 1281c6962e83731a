"""Stateful controllers over an ordered log of calls, batch and streaming with the same step functions.

A log has (key, ts in seconds, ok) and, if known, ``took`` (seconds to the answer).
``Breaker`` opens after five failures in a row, lets one call through once its
back-off is over, doubles the back-off when that fails (5 s up to 300 s) and
closes when it succeeds. ``Limiter`` models the rate that the other side bears:
the largest delivery rate and the least latency of the last ten seconds, probed
up and down in turn every five seconds; an error holds the rate down until the
next turn. ``replay`` puts the two in a row, as a gate: the breaker's wait comes
first, a wait of more than a minute is refused at once.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
#: A wait of the breaker beyond this many seconds is refused instead of waited for.
PATIENCE = 60.0


@dataclass
class Breaker:
    state: str = CLOSED
    errors: int = 0
    backoff: float = 5.0
    until: float = 0.0
    threshold: int = 5
    first: float = 5.0
    longest: float = 300.0

    def wait(self, now: float) -> float:
        """Seconds until a call may go; once the back-off is over, the next call is the trial."""
        if self.state != OPEN:
            return 0.0
        if now > self.until:
            self.state = HALF_OPEN
            return 0.0
        return self.until - now

    def succeeded(self) -> None:
        self.errors = 0
        if self.state == HALF_OPEN:
            self.state, self.backoff = CLOSED, self.first

    def failed(self, now: float) -> None:
        self.errors += 1
        if self.state == HALF_OPEN:
            self.backoff = min(self.longest, self.backoff * 2)
        elif self.errors < self.threshold:
            return
        self.state, self.until = OPEN, now + self.backoff

    def step(self, ts: float, ok: bool) -> str:
        """What becomes of a call at ts that is answered at once: ``blocked`` or ``passed``; then its outcome is taken in."""
        self.wait(ts)
        if self.state == OPEN:
            return "blocked"
        if ok:
            self.succeeded()
        else:
            self.failed(ts)
        return "passed"


@dataclass
class Best:
    """Largest (sign 1) or least (sign -1) value of a sliding window of time; ``value`` stays until the next sample."""

    value: float
    sign: int
    width: float = 10.0
    held: deque = field(default_factory=deque)

    def add(self, x: float, now: float) -> None:
        while self.held and self.held[0][0] < now - self.width:
            self.held.popleft()
        while self.held and self.sign * x >= self.sign * self.held[-1][1]:
            self.held.pop()
        self.held.append((now, x))
        self.value = self.held[0][1]


#: Turns of the limiter in order, with the gain on its rate.
CRUISE, UP, DOWN = "CRUISING", "PROBING_UP", "PROBING_DOWN"
GAINS = {CRUISE: 1.0, UP: 1.25, DOWN: 0.9}
NEXT = {CRUISE: UP, UP: DOWN, DOWN: CRUISE}


class Limiter:
    def __init__(self, now: float = 0.0, rate: float = 10.0, floor: float = 0.5, turn: float = 5.0, window: float = 10.0, pipe: int = 4):
        self.state, self.turned, self.turn = CRUISE, now, turn
        self.bandwidth, self.latency = Best(rate, 1, window), Best(0.5, -1, window)
        self.cap, self.floor, self.pipe = math.inf, floor, pipe
        self.sent_at, self.answered_at, self.answers = 0.0, now, 0
        self.flying: dict[object, tuple[float, int, float]] = {}

    @property
    def rate(self) -> float:
        """Calls a second that are thought to be borne, before the gain of the turn."""
        return max(self.floor, min(self.bandwidth.value, self.cap))

    def wait(self, now: float) -> float:
        """Seconds until the next call may go, by pace and by calls under way."""
        if now > self.turned + self.turn:
            self.state, self.turned, self.cap = NEXT[self.state], now, math.inf
        pause = max(0.0, self.sent_at + 1.0 / (self.rate * GAINS[self.state]) - now)
        if len(self.flying) >= 2 * max(self.pipe, self.rate * self.latency.value):
            pause = max(pause, self.latency.value / 2)
        return pause

    def sent(self, call: object, now: float) -> None:
        self.sent_at = now
        self.flying[call] = (now, self.answers, self.answered_at)

    def succeeded(self, call: object, now: float) -> None:
        """A sample of the delivery rate: answers since the call was sent, over the time since the answer before it."""
        if call not in self.flying:
            return
        began, answers, answered_at = self.flying.pop(call)
        self.answers += 1
        if now > answered_at:
            self.bandwidth.add((self.answers - answers) / (now - answered_at), now)
        self.answered_at = now
        self.latency.add(now - began, now)

    def failed(self, call: object, now: float) -> None:
        """The rate is held down until the next turn; a probe that fails ends."""
        self.flying.pop(call, None)
        self.cap = min(self.cap, self.rate * (0.8 if self.state == UP else 0.9))
        if self.state == UP:
            self.state = DOWN


def routing(kind: Column, status: Column) -> Column:
    """struct<limiter, breaker, stops>: what a call's outcome means for the two controllers.

    ``kind`` is ok, http (with a status), timeout, auth or anything else. Overload
    (429, 500, 502, 503) and timeouts are errors for both, other HTTP errors are
    answers like any other for the limiter and nothing to the breaker, a failed
    authentication is an error for both and stops everything, and what is
    unexpected counts for the limiter only.
    """
    overload = (kind == "http") & status.isin(429, 500, 502, 503)
    both = overload | kind.isin("timeout", "auth")
    return F.struct(
        F.when(both | ~kind.isin("ok", "http"), "error").otherwise("success").alias("limiter"),
        F.when(both, "error").when(kind == "ok", "success").otherwise("none").alias("breaker"),
        (kind == "auth").alias("stops"),
    )


def gated(calls: Iterator[tuple[float, bool, float]]) -> Iterator[tuple[str, float, str, str, float]]:
    """(fate, wait, breaker's state, limiter's state, rate) of each call (ts, ok, took) in order; answers arrive while others are sent."""
    breaker, limiter, due, n = Breaker(), None, [], 0

    def answer(now: float) -> None:
        while due and due[0][0] <= now:
            at, call, ok = heapq.heappop(due)
            if ok:
                limiter.succeeded(call, at)
                breaker.succeeded()
            else:
                limiter.failed(call, at)
                breaker.failed(at)

    for ts, ok, took in calls:
        limiter = limiter or Limiter(ts)
        answer(ts)
        wait = breaker.wait(ts)
        if wait > 0 or breaker.state == OPEN:
            yield "refused" if wait > PATIENCE else "blocked", wait, breaker.state, limiter.state, limiter.rate
            continue
        wait = limiter.wait(ts)
        limiter.sent(n, ts)
        heapq.heappush(due, (ts + took, n, ok))
        n += 1
        if not took:
            answer(ts)
        yield "passed", wait, breaker.state, limiter.state, limiter.rate


def replay(log: DataFrame) -> DataFrame:
    """key, ts, fate, wait, state, turn, rate of every call of the log, each key in order; a key's calls are one sequence, in one task."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "ok"], ignore_index=True)
        got = gated(zip(rows["ts"].tolist(), rows["ok"].tolist(), rows["took"].tolist(), strict=True))
        out = pd.DataFrame(list(got), columns=["fate", "wait", "state", "turn", "rate"])
        return pd.concat([rows[["key", "ts"]], out], axis=1)

    if "took" not in log.columns:
        log = log.withColumn("took", F.lit(0.0))
    return log.select("key", "ts", "ok", "took").groupBy("key").applyInPandas(go, "key long, ts double, fate string, wait double, state string, turn string, rate double")


def stream_breaker(log: DataFrame) -> DataFrame:
    """The breaker over a stream of (key, ts, ok): its state is kept by key between batches."""

    def go(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = Breaker(*state.get) if state.exists else Breaker()
        out = []
        for rows in [pd.concat(list(parts))]:
            for r in rows.sort_values(["ts", "ok"]).itertuples():
                out.append((key[0], r.ts, b.step(r.ts, bool(r.ok)), b.state))
        state.update((b.state, b.errors, b.backoff, b.until))
        yield pd.DataFrame(out, columns=["key", "ts", "fate", "state"])

    return log.groupBy("key").applyInPandasWithState(
        go, "key long, ts double, fate string, state string", "state string, errors int, backoff double, until double", "append", "NoTimeout"
    )

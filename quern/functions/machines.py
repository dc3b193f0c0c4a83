"""Order-dependent state machines, shared by batch folds and streaming processors.

Each has a ``start`` state (a tuple of numbers and strings), and a pure ``step``
from (state, row) to (state, outputs). Times are integer microseconds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass


@dataclass(frozen=True)
class TokenBucket:
    """Starts full; refills on every call, rejected ones too; a call takes ``cost`` tokens if they are there."""

    capacity: float = 100.0
    rate: float = 10.0
    outputs = (("tokens", "double"), ("allowed", "boolean"))

    def start(self) -> tuple:
        return (-1.0, 0)  # tokens (below 0: not seen yet) and time of the last call

    def step(self, state: tuple, now: int, cost: float = 1.0, capacity: float | None = None, rate: float | None = None) -> tuple[tuple, tuple]:
        most, speed = capacity if capacity is not None else self.capacity, rate if rate is not None else self.rate
        tokens, last = state
        tokens = most if tokens < 0 else min(most, tokens + max(0, now - last) / 1e6 * speed)
        allowed = tokens >= cost
        tokens -= cost if allowed else 0.0
        return (tokens, max(last, now)), (tokens, allowed)  # time that goes back gives nothing twice


@dataclass(frozen=True)
class WaitingBucket:
    """Calls wait for their tokens, in order: the time at which each is granted."""

    capacity: float = 100.0
    rate: float = 10.0
    outputs = (("granted_us", "long"),)

    def __post_init__(self):
        if self.rate <= 0:
            raise ValueError("the refill rate must be positive")

    def start(self) -> tuple:
        return (-1.0, 0)

    def step(self, state: tuple, now: int, cost: float = 1.0) -> tuple[tuple, tuple]:
        if cost > self.capacity:
            raise ValueError(f"{cost} tokens never fit a bucket of {self.capacity}")
        tokens, last = state
        now = max(now, last)  # a call starts when those before it are through
        tokens = self.capacity if tokens < 0 else min(self.capacity, tokens + (now - last) / 1e6 * self.rate)
        if tokens < cost:
            wait = int((cost - tokens) / self.rate * 1e6)
            now, tokens = now + wait, cost
        return (tokens - cost, now), (now,)


@dataclass(frozen=True)
class Breaker:
    """Circuit breaker. Variants differ in three points:

    1: re-opens for probing from the timeout on; any probe's failure opens it;
    2: only after the timeout; a success always zeroes the count; a probe's
       failure opens it only at the threshold;
    3: a plain flag for a fixed time; its count outlives the flag.
    """

    variant: int = 1
    threshold: int = 5
    timeout_us: int = 30_000_000
    outputs = (("allowed", "boolean"), ("state", "string"), ("failures", "long"))

    def start(self) -> tuple:
        return ("CLOSED", 0, 0)  # state, failures, time of the last opening

    def step(self, state: tuple, now: int, success: bool) -> tuple[tuple, tuple]:
        kind, failures, since = state
        if kind == "OPEN":
            over = now - since > self.timeout_us if self.variant == 2 else now - since >= self.timeout_us
            if not over:
                return state, (False, kind, failures)
            kind = "CLOSED" if self.variant == 3 else "HALF_OPEN"
        if success:
            kind, failures = "CLOSED", 0
        else:
            failures += 1
            if failures >= self.threshold or (self.variant == 1 and kind == "HALF_OPEN"):
                kind, since = "OPEN", now
        return (kind, failures, since), (True, kind, failures)


@dataclass(frozen=True)
class CallWrapper:
    """Calls through a breaker: a call makes up to ``tries`` attempts, and only a call that uses them all up counts as a failure.

    ``ok_at`` is the number of the first attempt that would succeed (null: none);
    ``done`` the time at which the last attempt ended. A blocked or failed call
    takes its fallback, or is an error.
    """

    breaker: Breaker = Breaker()
    tries: int = 4
    outputs = (("outcome", "string"), ("attempts", "long"), ("state", "string"), ("failures", "long"))

    def start(self) -> tuple:
        return self.breaker.start()

    def step(self, state: tuple, now: int, done: int, ok_at: int | None, fallback: bool) -> tuple[tuple, tuple]:
        good = ok_at is not None and ok_at <= self.tries
        new, (allowed, kind, failures) = self.breaker.step(state, now, good)
        if not allowed:
            return new, ("FALLBACK" if fallback else "OPEN", 0, kind, failures)
        if kind == "OPEN":  # it opens when the last attempt has failed, not when the call began
            new = (kind, failures, done)
        outcome = "OK" if good else "FALLBACK" if fallback else "FAILED"
        return new, (outcome, ok_at if good else self.tries, kind, failures)


@dataclass(frozen=True)
class Router:
    """Fallback chains whose outcomes drive the breakers of their providers.

    ``breakers`` are the registered ones; any other provider gets a fresh breaker
    per call, which never trips. A request's chain is tried in order: blocked
    providers are passed over, a failure counts for its provider, the first
    success ends it.
    """

    breakers: tuple[tuple[str, Breaker], ...] = ()
    outputs = (("provider", "string"), ("is_fallback", "boolean"), ("tried", "long"), ("status", "string"))

    def start(self) -> tuple:
        return tuple(b.start() for _, b in self.breakers)

    def step(self, state: tuple, now: int, chain: list, ok: list) -> tuple[tuple, tuple]:
        known, states, tried = {name: k for k, (name, _) in enumerate(self.breakers)}, [tuple(s) for s in state], 0
        there = [(p, bool(good)) for p, good in zip(chain or [], ok or [], strict=True) if p is not None]
        for place, (provider, good) in enumerate(there):
            k = known.get(provider)
            if k is not None:
                states[k], (allowed, _, _) = self.breakers[k][1].step(states[k], now, good)
                if not allowed:
                    continue
            tried += 1
            if good:
                return tuple(states), (provider, place > 0, tried, "OK")
        return tuple(states), (None, None, tried, "EXHAUSTED" if there else "NO_ROUTE")


@dataclass(frozen=True)
class WorkerBatcher:
    """Batches whose clock starts with the worker's loop, not with their first item.

    A loop collects until ``size`` items or ``wait_us`` after it began, works
    ``service_us`` on them and begins anew; an empty loop waits ``idle_us`` first.
    Items that come meanwhile wait in the queue.
    """

    size: int = 16
    wait_us: int = 50_000
    service_us: int = 0
    idle_us: int = 0
    outputs = (("batch_no", "long"), ("position", "long"))

    def __post_init__(self):
        if self.wait_us <= 0:
            raise ValueError("a worker that waits for no time takes no item")

    def start(self) -> tuple:
        return (0, 0, 0)  # begin of the loop, items in it, batch number

    def step(self, state: tuple, now: int) -> tuple[tuple, tuple]:
        begin, items, batch = state
        if items and now >= begin + self.wait_us:
            begin, items, batch = begin + self.wait_us + self.service_us, 0, batch + 1
        if not items and now >= begin + self.wait_us:
            loop = self.wait_us + self.idle_us
            begin += (now - begin) // loop * loop
            if now >= begin + self.wait_us:
                begin += loop
        out = (batch, items)
        items += 1
        if items == self.size:
            begin, items, batch = max(begin, now) + self.service_us, 0, batch + 1
        return (begin, items, batch), out


@dataclass(frozen=True)
class MicroBatcher:
    """Batches close at ``size`` items or once ``wait_us`` have passed since their first item."""

    size: int = 4
    wait_us: int = 100_000
    outputs = (("batch_no", "long"), ("position", "long"))

    def start(self) -> tuple:
        return (-1, 0, 0)  # batch number, items in it, time of its first item

    def step(self, state: tuple, now: int) -> tuple[tuple, tuple]:
        batch, items, first = state
        if batch < 0 or items >= self.size or now >= first + self.wait_us:
            batch, items, first = batch + 1, 0, now
        return (batch, items + 1, first), (batch, items)


@dataclass(frozen=True)
class Backlog:
    """A queue of bounded length that is worked off at a fixed pace; newcomers to a full queue are dropped."""

    limit: int = 5000
    service_us: int = 1000
    outputs = (("depth", "long"), ("dropped", "boolean"))

    def start(self) -> tuple:
        return (0, 0)  # time at which the queue will be empty, time of the last event

    def step(self, state: tuple, now: int) -> tuple[tuple, tuple]:
        busy = max(state[0], now)
        depth = -(-(busy - now) // self.service_us)
        if depth >= self.limit:
            return (busy, now), (depth, True)
        return (busy + self.service_us, now), (depth + 1, False)


@dataclass(frozen=True)
class RollingPercentiles:
    """Percentiles of the last ``size`` values, linear between neighbours, from a sorted copy kept up to date."""

    size: int = 1000
    at: tuple[float, ...] = (0.5, 0.99)

    @property
    def outputs(self) -> tuple:
        return tuple((f"p{round(100 * q)}", "double") for q in self.at)

    def start(self) -> tuple:
        return ([], [])

    def step(self, state: tuple, value: float) -> tuple[tuple, tuple]:
        ring, ordered = state
        value = None if value is None or value != value else value
        ring.append(value)
        if value is not None:
            insort(ordered, value)
        if len(ring) > self.size and (gone := ring.pop(0)) is not None:
            ordered.pop(bisect_left(ordered, gone))
        if not ordered:
            return (ring, ordered), (None,) * len(self.at)
        out = []
        for q in self.at:
            place = q * (len(ordered) - 1)
            low = int(place)
            high = min(low + 1, len(ordered) - 1)
            out.append(ordered[low] + (ordered[high] - ordered[low]) * (place - low))
        return (ring, ordered), tuple(out)

"""Small state machines over the events of one key, one step per event.

They serve the batch form (rows of sorted partitions) and the streaming form (keyed state). A
state is plain JSON data of bounded size. Times are microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000


@dataclass(frozen=True)
class SlidingLimit:
    """At most ``limit`` allowed events in ``window`` seconds; denied events do not count, an event
    exactly ``window`` old still does."""

    limit: int
    window: float

    @property
    def horizon(self) -> float:
        """Seconds after which an event no longer matters."""
        return self.window

    def start(self):
        return []

    def step(self, state, at, known=None):
        edge = at - int(self.window * SECOND)
        kept = [t for t in state if t >= edge]
        if known or len(kept) < self.limit:
            return [*kept, at], (True, 0)
        return kept, (False, max(int((kept[0] - edge) / SECOND) + 1, 1))


@dataclass(frozen=True)
class TokenBucket:
    """``rate`` tokens per second up to ``capacity``; an event takes ``cost`` of them or is denied."""

    capacity: float
    rate: float
    cost: float = 1.0

    def start(self):
        return None

    def step(self, state, at):
        tokens, last = state or (self.capacity, at)
        tokens = min(self.capacity, tokens + (at - last) / SECOND * self.rate)
        taken = tokens >= self.cost
        left = tokens - self.cost if taken else tokens
        return [left, at], (taken, left)


@dataclass(frozen=True)
class AdaptiveLimit:
    """A limit that shrinks under load or errors and grows when all is well, at most every ``every`` seconds."""

    base: int
    every: float = 30.0

    def start(self):
        return None

    def step(self, state, at, load, errors):
        factor, last = state or (1.0, at)
        if at - last >= self.every * SECOND:
            if load > 0.8 or errors > 0.1:
                factor = max(0.5, factor * 0.9)
            elif load < 0.5 and errors < 0.05:
                factor = min(2.0, factor * 1.1)
            last = at
        return [factor, last], (factor, int(self.base * factor))


@dataclass(frozen=True)
class Breaker:
    """Opens after repeated failures, tries again after a growing pause, closes after repeated successes."""

    failure_threshold: int = 5
    success_threshold: int = 3
    initial_delay: float = 1.0
    max_delay: float = 300.0
    multiplier: float = 2.0

    def start(self):
        return ["closed", 0, 0, 0]

    def _pause(self, failures):
        grown = self.initial_delay * self.multiplier ** min(failures - 1, 1000)
        return max(min(grown, self.max_delay), self.initial_delay)

    def step(self, state, at, success):
        name, failures, successes, retry_at = state
        before = name
        if name == "open":
            if at < retry_at:
                return state, ("open", "open", True)
            name, successes = "half_open", 0
        if success:
            if name == "half_open":
                successes += 1
                if successes >= self.success_threshold:
                    name, failures, successes = "closed", 0, 0
            else:
                failures = 0
        else:
            failures += 1
            if name == "half_open" or failures >= self.failure_threshold:
                name, retry_at = "open", at + int(self._pause(failures) * SECOND)
        return [name, failures, successes, retry_at], (before, name, False)


@dataclass(frozen=True)
class Notifier:
    """At most ``limit`` notices in ``window`` seconds; repeats of a kind within ``similar`` seconds are folded."""

    limit: int = 10
    window: float = 300.0
    similar: float = 60.0

    def start(self):
        return [[], {}]

    def step(self, state, at, kind, known=None):
        sent = [t for t in state[0] if t > at - self.window * SECOND]
        last = {k: t for k, t in state[1].items() if t > at - self.similar * SECOND}
        if known is None and len(sent) >= self.limit:
            return [sent, last], ("rate_limited",)
        folded = known == "aggregated" if known is not None else kind in last
        last[kind] = at
        if folded:
            return [sent, last], ("aggregated",)
        return [[*sent, at], last], ("sent",)

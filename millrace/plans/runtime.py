"""What runs around a graph: caching of results across runs, triggers, metrics and timing."""

from __future__ import annotations

import hashlib
import json
import statistics
import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame

from millrace.sources.materialize import Store


def cache_key(name: str, *parts: Any) -> str:
    """A name for a result that depends on ``parts``: text, numbers, or analysed plans of DataFrames."""
    text = [p._jdf.queryExecution().analyzed().canonicalized().toString() if isinstance(p, DataFrame) else json.dumps(p, sort_keys=True, default=str) for p in parts]
    return f"{name}-{hashlib.sha256('|'.join(text).encode()).hexdigest()[:16]}"


@dataclass
class ResultCache:
    """Tables kept in a store for a while; counts hits and misses."""

    store: Store
    ttl: float | None = None
    clock: Callable[[], float] = time.time
    made: dict[str, float] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        fresh = key in self.made and (self.ttl is None or self.clock() - self.made[key] < self.ttl)
        if fresh and self.store.exists(key):
            self.hits += 1
            return self.store.load(key)
        self.misses += 1
        out = self.store.replace(key, make())
        self.made[key] = self.clock()
        return out

    def invalidate(self, prefix: str = "") -> int:
        """Forgets results, and removes their tables."""
        gone = [k for k in self.made if k.startswith(prefix)]
        for k in gone:
            del self.made[k]
            self.store.remove(k)
        return len(gone)


@dataclass
class Interval:
    every: timedelta

    def next(self, after: datetime) -> datetime:
        return after + self.every


@dataclass
class EventTrigger:
    """Fires on events that pass the filter, not again within ``debounce``."""

    kind: str
    accepts: Callable[[dict], bool] = lambda event: True
    debounce: timedelta = timedelta(0)
    last: datetime | None = None

    def fires(self, event: dict, now: datetime) -> bool:
        if event.get("type") != self.kind or not self.accepts(event):
            return False
        if self.last is not None and now - self.last < self.debounce:
            return False
        self.last = now
        return True


class Metrics:
    """Counters, gauges and timings by name."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self.timings: dict[str, list[float]] = defaultdict(list)

    def count(self, name: str, by: float = 1) -> None:
        self.counters[name] += by

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings[name].append(time.perf_counter() - began)

    def summary(self) -> dict[str, dict[str, float]]:
        return {n: {"n": len(t), "mean": statistics.fmean(t), "min": min(t), "max": max(t)} for n, t in self.timings.items()}


def benchmark(fn: Callable[[], Any], warmup: int = 3, runs: int = 10) -> dict[str, float]:
    """Seconds of a callable; DataFrames are run to their end without being kept."""

    def once() -> float:
        began = time.perf_counter()
        out = fn()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for _ in range(warmup):
        once()
    t = [once() for _ in range(runs)]
    return {"runs": runs, "mean": statistics.fmean(t), "median": statistics.median(t), "stdev": statistics.stdev(t) if runs > 1 else 0.0, "min": min(t), "max": max(t)}


def compare(a: dict[str, float], b: dict[str, float]) -> float:
    """How many times as fast a is as b."""
    return b["mean"] / a["mean"] if a["mean"] else float("inf")

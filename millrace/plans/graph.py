"""Asset graphs: named tables that depend on each other, run once each, in order, with retries,
checkpoints and backfills.  Assets return lazy DataFrames; only those that are kept start jobs."""

from __future__ import annotations

import inspect
import json
import random
import time
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.materialize import Store


@dataclass
class Context:
    spark: SparkSession
    config: dict[str, Any] = field(default_factory=dict)
    state: dict[str, Any] = field(default_factory=dict)
    partition: Any = None


@dataclass
class Asset:
    name: str
    fn: Callable[..., DataFrame]
    depends_on: tuple[str, ...] = ()
    keep: str = "none"  # none, view, table (replace), incremental (upsert), cache
    key: str | None = None
    order_by: str | None = None
    partition_by: tuple[str, ...] = ()
    retries: int = 0


class Graph:
    def __init__(self, assets: Iterable[Asset] = ()):
        self.assets: dict[str, Asset] = {}
        for a in assets:
            self.add(a)

    def add(self, asset: Asset) -> Asset:
        if asset.name in self.assets:
            raise ValueError(f"{asset.name} is there already")
        self.assets[asset.name] = asset
        return asset

    def asset(self, name: str | None = None, depends_on: Iterable[str] | None = None, **options: Any) -> Callable:
        """Decorator.  Parameters named like assets are what it depends on, unless told."""

        def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            deps = tuple(depends_on) if depends_on is not None else tuple(p for p in inspect.signature(fn).parameters if p in self.assets)
            self.add(Asset(name or fn.__name__, fn, deps, **options))
            return fn

        return wrap

    def order(self, targets: Iterable[str] | None = None) -> list[str]:
        """Dependencies first; names settle ties.  A cycle is named."""
        wanted = set(self.assets) if targets is None else set(targets) | set().union(*(self.upstream(t) for t in targets))
        for n in wanted:
            for d in self.assets[n].depends_on:
                if d not in self.assets:
                    raise ValueError(f"{n} depends on {d}, which isn't there")
        left = {n: {d for d in self.assets[n].depends_on if d in wanted} for n in wanted}
        out: list[str] = []
        while left:
            ready = sorted(n for n, d in left.items() if not d)
            if not ready:
                raise ValueError(f"cycle: {' -> '.join(self._cycle(left))}")
            for n in ready:
                del left[n]
                out.append(n)
            for d in left.values():
                d.difference_update(ready)
        return out

    def _cycle(self, left: dict[str, set[str]]) -> list[str]:
        path = [sorted(left)[0]]
        while path[-1] not in path[:-1]:
            path.append(sorted(left[path[-1]])[0])
        return path[path.index(path[-1]) :]

    def _reach(self, name: str, step: Callable[[str], Iterable[str]], depth: int | None) -> set[str]:
        seen, queue = set(), deque([(name, 0)])
        while queue:
            n, k = queue.popleft()
            if depth is None or k < depth:
                for m in step(n):
                    if m not in seen:
                        seen.add(m)
                        queue.append((m, k + 1))
        return seen

    def upstream(self, name: str, depth: int | None = None) -> set[str]:
        return self._reach(name, lambda n: self.assets[n].depends_on if n in self.assets else (), depth)

    def downstream(self, name: str, depth: int | None = None) -> set[str]:
        return self._reach(name, lambda n: [a.name for a in self.assets.values() if n in a.depends_on], depth)

    def to_mermaid(self) -> str:
        return "\n".join(["graph TD", *(f"  {a.name}" for a in self.assets.values()), *(f"  {d} --> {a.name}" for a in self.assets.values() for d in a.depends_on)])


@dataclass(frozen=True)
class Backoff:
    """Waits before further tries: fixed, linear or exponential, with up to ``jitter`` of it at random."""

    retries: int = 3
    kind: str = "exponential"
    base: float = 1.0
    most: float = 60.0
    jitter: float = 0.5
    on: tuple[type[BaseException], ...] = (Exception,)

    def delay(self, attempt: int, rng: random.Random | None = None) -> float:
        raw = {"fixed": self.base, "linear": self.base * (attempt + 1), "exponential": self.base * 2**attempt}[self.kind]
        raw = min(raw, self.most)
        return raw * (1 - self.jitter * (rng or random).random())

    def call(self, fn: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        for attempt in range(self.retries + 1):
            try:
                return fn()
            except self.on:
                if attempt == self.retries:
                    raise
                sleep(self.delay(attempt))


class CircuitOpen(Exception):
    """Calls are held back after too many failures."""


@dataclass
class CircuitBreaker:
    failures: int = 5
    recovery: float = 60.0
    clock: Callable[[], float] = time.monotonic
    _failed: int = 0
    _opened: float | None = None

    @property
    def state(self) -> str:
        if self._opened is None:
            return "closed"
        return "half_open" if self.clock() - self._opened >= self.recovery else "open"

    def call(self, fn: Callable[[], Any]) -> Any:
        if self.state == "open":
            raise CircuitOpen
        try:
            out = fn()
        except Exception:
            self._failed += 1
            if self.state == "half_open" or self._failed >= self.failures:
                self._opened = self.clock()
            raise
        self._failed, self._opened = 0, None
        return out


@dataclass
class Outcome:
    status: dict[str, str] = field(default_factory=dict)  # done, failed, skipped or resumed
    errors: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @property
    def success(self) -> bool:
        return not self.errors


class Checkpoints:
    """Which assets of a run are done, in a JSON file."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def done(self, run: str) -> set[str]:
        return set(json.loads(self.path.read_text()).get(run, [])) if self.path.exists() else set()

    def mark(self, run: str, names: set[str]) -> None:
        every = json.loads(self.path.read_text()) if self.path.exists() else {}
        every[run] = sorted(names)
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(every))
        new.replace(self.path)


class Engine:
    """Runs a graph.  ``on_error``: fail_fast stops; continue skips only what depends on the failure."""

    def __init__(self, spark: SparkSession, store: Store | None = None, on_error: str = "fail_fast", workers: int = 1, backoff: Backoff | None = None, checkpoints: Checkpoints | None = None):
        self.spark, self.store, self.on_error, self.workers = spark, store, on_error, workers
        self.backoff, self.checkpoints = backoff or Backoff(0), checkpoints

    def run(self, graph: Graph, targets: Iterable[str] | None = None, run: str | None = None, config: dict[str, Any] | None = None, partition: Any = None) -> Outcome:
        order, out = graph.order(targets), Outcome()
        context = Context(self.spark, config or {}, {}, partition)
        done = self.checkpoints.done(run) if self.checkpoints and run else set()
        # an asset that was kept needn't run again; one that wasn't is but a plan, and is planned anew
        for n in order:
            if n in done and self.store is not None and graph.assets[n].keep in ("table", "incremental") and self.store.exists(n):
                out.tables[n], out.status[n] = self.store.load(n), "resumed"
        left = [n for n in order if n not in out.status]
        running: dict[Future, str] = {}
        stop = False
        with ThreadPoolExecutor(max(1, self.workers)) as pool:
            while left or running:
                for n in list(left):
                    deps = graph.assets[n].depends_on
                    if stop or any(out.status.get(d) in ("failed", "skipped") for d in deps):
                        out.status[n] = "skipped"
                        left.remove(n)
                    elif all(d in out.tables for d in deps) and len(running) < max(1, self.workers):
                        left.remove(n)
                        running[pool.submit(self._one, graph.assets[n], {d: out.tables[d] for d in deps}, context)] = n
                if not running:
                    continue
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    n = running.pop(f)
                    try:
                        out.tables[n], out.seconds[n] = f.result()
                        out.status[n] = "done"
                        if self.checkpoints and run:
                            done.add(n)
                            self.checkpoints.mark(run, done)
                    except Exception as e:
                        out.status[n], out.errors[n] = "failed", str(e).split("\n")[0]
                        stop = stop or self.on_error == "fail_fast"
        return out

    def _one(self, asset: Asset, inputs: dict[str, DataFrame], context: Context) -> tuple[DataFrame, float]:
        began = time.monotonic()
        names = inspect.signature(asset.fn).parameters
        args = {k: v for k, v in inputs.items() if k in names} | ({"context": context} if "context" in names else {})
        policy = self.backoff if not asset.retries else Backoff(asset.retries, self.backoff.kind, self.backoff.base, self.backoff.most, self.backoff.jitter, self.backoff.on)

        def go() -> DataFrame:
            df = asset.fn(**args)
            match asset.keep:
                case "view":
                    df.createOrReplaceTempView(asset.name)
                case "cache":
                    df = df.persist()
                case "table" | "incremental" if self.store is None:
                    raise ValueError(f"{asset.name} is to be kept, but there is no store")
                case "table":
                    df = self.store.replace(asset.name, df, list(asset.partition_by) or None)
                case "incremental":
                    df = self.store.upsert(asset.name, df, asset.key, asset.order_by)
            return df

        return policy.call(go), time.monotonic() - began

    def backfill(self, graph: Graph, partitions: Iterable[Any], targets: Iterable[str] | None = None, stop_on_error: bool = False) -> dict[Any, Outcome]:
        out: dict[Any, Outcome] = {}
        for p in partitions:
            out[p] = self.run(graph, targets, run=f"backfill-{p}", partition=p)
            if stop_on_error and not out[p].success:
                break
        return out


def days(start: date, end: date) -> list[date]:
    return [start + timedelta(n) for n in range((end - start).days + 1)]


def checksum(df: DataFrame) -> str:
    """The same for the same rows in any order: sums of row hashes, made where the rows are."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("x")).first()
    import hashlib

    return hashlib.sha256(f"{got.n}|{got.s}|{got.x}".encode()).hexdigest()


class Cron:
    """Five fields: minute, hour, day of month, month, day of week (0 or 7 is Sunday)."""

    RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))

    def __init__(self, text: str):
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"not a cron expression: {text!r}")
        self.fields = [self._field(p, lo, hi) for p, (lo, hi) in zip(parts, self.RANGES, strict=True)]
        self.any_day, self.any_weekday = parts[2] == "*", parts[4] == "*"

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (lo, hi) if span == "*" else (int(a), int(b) if b else hi if step else int(a))
            if not lo <= first <= last <= hi:
                raise ValueError(f"out of range: {part}")
            out.update(range(first, last + 1, int(step or 1)))
        return out

    def matches(self, t: datetime) -> bool:
        minute, hour, day, month, weekday = self.fields
        in_day, in_weekday = t.day in day, t.isoweekday() % 7 in {w % 7 for w in weekday}
        good_day = in_day and in_weekday if self.any_day or self.any_weekday else in_day or in_weekday
        return t.minute in minute and t.hour in hour and t.month in month and good_day

    def next(self, after: datetime) -> datetime:
        t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 24 * 60 * 5):
            if self.matches(t):
                return t
            t += timedelta(minutes=1) if t.month in self.fields[3] and t.hour in self.fields[1] else timedelta(minutes=60 - t.minute)
        raise ValueError("never")


@dataclass
class DeadLetters:
    """What failed, the latest ``most`` of it."""

    most: int = 1000
    items: deque = field(default_factory=deque)

    def add(self, item: Any, error: BaseException) -> None:
        self.items.append((item, str(error), time.time()))
        while len(self.items) > self.most:
            self.items.popleft()

    def retry(self, fn: Callable[[Any], Any]) -> int:
        fixed, again = 0, deque()
        for item, error, at in self.items:
            try:
                fn(item)
                fixed += 1
            except Exception:
                again.append((item, error, at))
        self.items = again
        return fixed

"""Bounded metadata cache with eviction policies, statistics and health reports."""

from __future__ import annotations

import json
import sys
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from enum import Enum
from typing import Any


class Strategy(Enum):
    FIFO = "FIFO"
    LRU = "LRU"
    LFU = "LFU"


class Store(Enum):
    TypeProperties = "TypeProperties"
    PropertyPath = "PropertyPath"
    CollectionElementType = "CollectionElementType"


@dataclass
class Options:
    max_cache_size: int = 1000
    strategy: Strategy = Strategy.LRU
    least_used_threshold: int = 25
    most_used_threshold: int = 75
    validate: bool = field(default=True, repr=False)

    def __post_init__(self) -> None:
        if not self.validate:
            return
        if self.max_cache_size <= 0:
            raise ValueError("max_cache_size must be positive")
        if not 1 <= self.least_used_threshold <= 50:
            raise ValueError("least_used_threshold must be 1 to 50")
        self.most_used_threshold = 100 - self.least_used_threshold

    @classmethod
    def preset(cls, name: str) -> Options:
        """Size, strategy and percentage evicted of each preset."""
        size, strategy, least = {
            "default": (1000, "LRU", 25),
            "high_memory": (5000, "LRU", 10),
            "low_memory": (250, "LFU", 40),
            "development": (100, "FIFO", 50),
            "high_frequency": (2000, "LFU", 20),
            "temporal": (1500, "LRU", 25),
        }[name]
        return cls(size, Strategy(strategy), least)


@dataclass
class _Entry:
    value: Any
    used: int
    count: int = 0


#: Thresholds of alerts.
MEMORY_WARNING_MB, MEMORY_CRITICAL_MB, UTILISATION_ALERT, TRACKING_ALERT, EFFICIENCY_ALERT = 50, 100, 90, 40, 50


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} GB"


def size_constants() -> dict[str, int]:
    """Bytes that an empty object of each kind takes in this interpreter, with which :func:`string_size` and usage are counted."""
    return {"string": sys.getsizeof(""), "tuple": sys.getsizeof(()), "dict": sys.getsizeof({}), "reference": sys.getsizeof((None,)) - sys.getsizeof(()), "entry": 32}


def string_size(text: str | None) -> int:
    """Bytes that a string takes; none takes none."""
    return 0 if text is None else sys.getsizeof(text)


class MetadataCache:
    """Three stores.  A store over its limit loses its first, least recently or least often used entries."""

    def __init__(self, options: Options | None = None):
        self._lock, self._tick = threading.RLock(), 0
        self._options = options or Options()
        self._stores: dict[Store, dict[Any, _Entry]] = {s: {} for s in Store}
        self.hits = self.misses = self.evictions = 0

    def configure(self, options: Options | None = None, **changes) -> Options:
        with self._lock:
            self._options = replace(options or self._options, **changes)
            return self.options()

    def options(self) -> Options:
        return replace(self._options)

    def get(self, store: Store, key: Any, make: Callable[[], Any]) -> Any:
        with self._lock:
            entries, self._tick = self._stores[store], self._tick + 1
            if (entry := entries.get(key)) is not None:
                self.hits += 1
                entry.used, entry.count = self._tick, entry.count + 1
                return entry.value
            self.misses += 1
        value = make()
        with self._lock:
            entries[key] = _Entry(value, self._tick)
            if self.is_full(store):
                self.evict(store)
        return value

    def is_full(self, store: Store, size: int | None = None, limit: int | None = None) -> bool:
        """Whether a store, or one of a given size, is over the limit, or over a given one."""
        return (len(self._stores[store]) if size is None else size) > (self._options.max_cache_size if limit is None else limit)

    is_eviction_needed = is_full

    def eviction_count(self, size: int) -> int:
        return max(1, size * self._options.least_used_threshold // 100)

    def candidates(self, store: Store) -> list[Any]:
        """Keys that the next eviction takes."""
        entries = self._stores[store]
        rank = {Strategy.FIFO: None, Strategy.LRU: lambda k: entries[k].used, Strategy.LFU: lambda k: entries[k].count}
        how = rank[self._options.strategy]
        keys = list(entries) if how is None else sorted(entries, key=how)
        return keys[: self.eviction_count(len(keys))] if keys else []

    def evict(self, store: Store) -> int:
        with self._lock:
            gone = self.candidates(store)
            for k in gone:
                del self._stores[store][k]
            self.evictions += len(gone)
            return len(gone)

    def force_eviction(self) -> int:
        return sum(map(self.evict, Store))

    def strategy_description(self) -> str:
        order = {Strategy.FIFO: "oldest", Strategy.LRU: "least recently used", Strategy.LFU: "least often used"}
        return f"{self._options.strategy.value}: the {order[self._options.strategy]} {self._options.least_used_threshold}% go first"

    def clear(self, store: Store | None = None) -> None:
        with self._lock:
            for s in [store] if store else Store:
                self._stores[s].clear()

    def counts(self) -> dict[str, int]:
        return {s.value: len(e) for s, e in self._stores.items()}

    def tracking_counts(self) -> dict[str, int]:
        tracked = self._options.strategy is not Strategy.FIFO
        return {s.value: len(e) if tracked else 0 for s, e in self._stores.items()}

    def memory_usage(self) -> dict[str, int]:
        size = lambda e: sum(sys.getsizeof(k) + sys.getsizeof(v.value) + 32 for k, v in e.items())
        return {s.value: size(e) for s, e in self._stores.items()}

    def statistics(self) -> dict[str, Any]:
        total, used = sum(self.counts().values()), sum(self.memory_usage().values())
        limit, asked = self._options.max_cache_size * len(Store), self.hits + self.misses
        return {
            "counts": self.counts(),
            "tracking": self.tracking_counts(),
            "memory": self.memory_usage(),
            "total_entries": total,
            "total_bytes": used,
            "utilisation": 100 * total / limit,
            "hit_rate": 100 * self.hits / asked if asked else 0.0,
            "evictions": self.evictions,
            "entries_per_mb": total / (used / 1048576) if used else 0.0,
        }

    def alerts(self, warning_mb: float = MEMORY_WARNING_MB, critical_mb: float = MEMORY_CRITICAL_MB) -> list[str]:
        s, out = self.statistics(), []
        mb = s["total_bytes"] / 1048576
        if mb >= critical_mb:
            out.append(f"critical: {format_bytes(s['total_bytes'])} in use")
        elif mb >= warning_mb:
            out.append(f"warning: {format_bytes(s['total_bytes'])} in use")
        if s["utilisation"] >= UTILISATION_ALERT:
            out.append(f"utilisation {s['utilisation']:.0f}%")
        if (share := self.tracking_share()) >= TRACKING_ALERT:
            out.append(f"tracking takes {share:.0f}%")
        if s["total_entries"] and s["entries_per_mb"] < EFFICIENCY_ALERT:
            out.append(f"{s['entries_per_mb']:.0f} entries/MB")
        return out

    def tracking_share(self) -> float:
        used = sum(self.memory_usage().values())
        return 100 * 16 * sum(self.tracking_counts().values()) / used if used else 0.0

    def health(self) -> str:
        found = self.alerts()
        return "Critical" if any(a.startswith("critical") for a in found) else "Warning" if found else "Healthy"

    def evaluate(self) -> dict[str, Any]:
        """The score is the mean of utilisation, efficiency / 10, 100 - tracking share and a figure for health."""
        s = self.statistics()
        health = {"Healthy": 100, "Warning": 70, "Critical": 30}[self.health()]
        parts = [min(100, s["utilisation"]), min(100, s["entries_per_mb"] / 10), 100 - self.tracking_share(), health]
        return {"score": sum(parts) / 4, "health": self.health(), "statistics": s}

    def report(self, kind: str = "performance") -> str:
        s = self.statistics()
        if kind == "compact":
            return f"{s['total_entries']} entries, {format_bytes(s['total_bytes'])}, {self.health()}"
        if kind == "summary":
            return f"{self.health()}: {s['utilisation']:.0f}% full, hit rate {s['hit_rate']:.0f}%"
        shown = s | {"configuration": {k: str(v) for k, v in asdict(self._options).items()}, "alerts": self.alerts()}
        return json.dumps(shown | ({"candidates": {x.value: len(self.candidates(x)) for x in Store}} if kind == "analysis" else {}), indent=1)

    def monitoring(self) -> dict[str, Any]:
        return {"time": time.time(), "statistics": self.statistics(), "health": self.health(), "alerts": self.alerts()}

    def session(self) -> Session:
        return Session(self)


class Session:
    """Statistics at its start against those now."""

    def __init__(self, cache: MetadataCache):
        self.cache, self.began, self.first = cache, time.time(), cache.statistics()

    def changes(self) -> dict[str, Any]:
        now = self.cache.statistics()
        keys = ("total_entries", "total_bytes", "evictions")
        return {"seconds": time.time() - self.began} | {k: now[k] - self.first[k] for k in keys}


CACHE = MetadataCache()

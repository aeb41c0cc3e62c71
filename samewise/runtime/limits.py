"""Request limits (sliding windows) and resource limits of the driver."""

from __future__ import annotations

import os
import shutil
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from samewise.errors import ConfigurationError, RateLimitError, ResourceError


@dataclass(frozen=True)
class RateLimitConfig:
    requests_per_minute: int = 60
    requests_per_hour: int = 1000
    requests_per_day: int = 10_000
    burst_limit: int = 10
    burst_window: float = 10.0

    def __post_init__(self) -> None:
        if min(self.requests_per_minute, self.requests_per_hour, self.requests_per_day, self.burst_limit) < 1 or self.burst_window <= 0:
            raise ConfigurationError("limits are positive")

    def windows(self) -> dict[str, tuple[float, int]]:
        return {"minute": (60.0, self.requests_per_minute), "hour": (3600.0, self.requests_per_hour), "day": (86_400.0, self.requests_per_day), "burst": (self.burst_window, self.burst_limit)}


class _Window:
    """Times of the allowed requests of one client, by window."""

    def __init__(self, config: RateLimitConfig):
        self.limits = config.windows()
        self.times: dict[str, deque[float]] = {k: deque() for k in self.limits}
        self.allowed = self.blocked = 0
        self.last: float | None = None

    def expire(self, now: float) -> None:
        for k, (span, _) in self.limits.items():
            q = self.times[k]
            while q and q[0] <= now - span:
                q.popleft()

    def allow(self, now: float) -> bool:
        self.expire(now)
        if any(len(self.times[k]) >= limit for k, (_, limit) in self.limits.items()):
            self.blocked += 1
            return False
        for q in self.times.values():
            q.append(now)
        self.allowed += 1
        self.last = now
        return True

    def wait(self, now: float) -> float:
        self.expire(now)
        return max((self.times[k][0] + span - now for k, (span, limit) in self.limits.items() if len(self.times[k]) >= limit), default=0.0)


class RateLimiter:
    """Sliding-window limits per identifier; blocked requests do not count. clock gives seconds."""

    def __init__(self, config: RateLimitConfig | None = None, clock: Callable[[], float] = time.time):
        self.config, self.clock, self.lock = config or RateLimitConfig(), clock, threading.Lock()
        self.clients: dict[str, _Window] = {}

    def _of(self, identifier: str) -> _Window:
        return self.clients.setdefault(identifier, _Window(self.config))

    def allow_request(self, identifier: str = "default") -> bool:
        with self.lock:
            return self._of(identifier).allow(self.clock())

    def enforce_request(self, identifier: str = "default") -> None:
        if not self.allow_request(identifier):
            raise RateLimitError("too many requests", retry_after=self.get_retry_after(identifier), identifier=identifier)

    def get_retry_after(self, identifier: str = "default") -> float:
        with self.lock:
            return self._of(identifier).wait(self.clock())

    def get_remaining_requests(self, identifier: str = "default") -> dict[str, int]:
        with self.lock:
            w = self._of(identifier)
            w.expire(self.clock())
            return {k: limit - len(w.times[k]) for k, (_, limit) in w.limits.items()}

    def get_statistics(self, identifier: str = "default") -> dict:
        with self.lock:
            w, now = self._of(identifier), self.clock()
            w.expire(now)
            return {
                "total_requests": w.allowed, "total_blocked": w.blocked, **{f"current_{k}_requests": len(q) for k, q in w.times.items()},
                "block_rate": w.blocked / max(1, w.allowed), "last_request_time": w.last, "time_since_last_request": None if w.last is None else now - w.last,
            }

    def reset(self, identifier: str | None = None) -> None:
        with self.lock:
            if identifier is None:
                self.clients.clear()
            else:
                self.clients.pop(identifier, None)


class GlobalRateLimiter:
    """Limiters by name, each with its own limits."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.limiters = clock, {}

    def set_rate_limit(self, identifier: str, config: RateLimitConfig) -> None:
        self.limiters[identifier] = RateLimiter(config, self.clock)

    def _of(self, identifier: str) -> RateLimiter:
        return self.limiters.setdefault(identifier, RateLimiter(None, self.clock))

    def allow_request(self, identifier: str) -> bool:
        return self._of(identifier).allow_request()

    def enforce_request(self, identifier: str) -> None:
        self._of(identifier).enforce_request()

    def get_statistics(self, identifier: str | None = None) -> dict:
        return self._of(identifier).get_statistics() if identifier else {k: v.get_statistics() for k, v in self.limiters.items()}

    def reset(self, identifier: str | None = None) -> None:
        for k, v in self.limiters.items():
            if identifier in (None, k) or identifier not in self.limiters:
                v.reset()


@dataclass
class ResourceLimits:
    max_memory_mb: float = 1024
    max_threads: int = 8
    max_processing_time: float = 3600
    max_disk_usage_percent: float = 90
    check_interval: float = 5


@dataclass
class ResourceMonitor:
    """Checks of the driver process; executors have Spark's own limits. As a context manager it also watches in a thread."""

    limits: ResourceLimits = field(default_factory=ResourceLimits)
    callbacks: list[Callable[[str, dict], None]] = field(default_factory=list)
    violations: int = 0
    started: float = field(default_factory=time.time)

    def __post_init__(self) -> None:
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def add_violation_callback(self, callback: Callable[[str, dict], None]) -> None:
        self.callbacks.append(callback)

    def _report(self, what: str, value: float, limit: float) -> bool:
        if value <= limit:
            return True
        self.violations += 1
        for c in self.callbacks:
            c(what, {"value": value, "limit": limit})
        return False

    def memory_mb(self) -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def check_memory_usage(self) -> bool:
        return self._report("memory", self.memory_mb(), self.limits.max_memory_mb)

    def check_thread_usage(self) -> bool:
        return self._report("threads", threading.active_count(), self.limits.max_threads)

    check_thread_count = check_thread_usage

    def check_processing_time(self, start: float | None = None) -> bool:
        return self._report("time", time.time() - (start or self.started), self.limits.max_processing_time)

    def check_disk_usage(self, path: str = ".") -> bool:
        use = shutil.disk_usage(path)
        return self._report("disk", 100 * use.used / use.total, self.limits.max_disk_usage_percent)

    def checks(self) -> dict[str, bool]:
        return {"memory": self.check_memory_usage(), "threads": self.check_thread_usage(), "time": self.check_processing_time(), "disk": self.check_disk_usage()}

    def enforce_limits(self) -> None:
        if bad := [k for k, ok in self.checks().items() if not ok]:
            raise ResourceError("resource limit exceeded", resources=", ".join(bad))

    def get_system_info(self) -> dict:
        return {"cpus": os.cpu_count(), "memory_mb": self.memory_mb(), "threads": threading.active_count(), "disk": shutil.disk_usage(".")._asdict()}

    def get_statistics(self) -> dict:
        return {"violations": self.violations, "running_seconds": time.time() - self.started, "memory_mb": self.memory_mb(), "threads": threading.active_count(), "monitoring": self._thread is not None}

    def start(self) -> None:
        self._stop.clear()

        def watch() -> None:
            while not self._stop.wait(self.limits.check_interval):
                self.checks()

        self._thread = threading.Thread(target=watch, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(self.limits.check_interval + 1)
            self._thread = None

    def __enter__(self) -> ResourceMonitor:
        self.started = time.time()
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop()

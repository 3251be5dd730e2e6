"""Memos on the driver: by content, and by time."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


class Memo:
    """Values by content hash; ``hits`` and ``misses`` count look-ups."""

    def __init__(self):
        self.values: dict[str, Any] = {}
        self.hits = self.misses = 0

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        if key in self.values:
            self.hits += 1
        else:
            self.misses += 1
            self.values[key] = make()
        return self.values[key]


def downstream_models(memo: Memo, graph_key: str, node: str, search: Callable[[str], list[str]]) -> list[str]:
    """What ``search`` finds downstream of a node, once for each state of the graph."""
    return memo.get(f"downstream\x00{graph_key}\x00{node}", lambda: search(node))


class TimedMemo:
    """Values that count for ``ttl`` seconds."""

    def __init__(self, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.values: dict[str, tuple[float, Any]] = {}

    def put(self, key: str, value: Any) -> None:
        self.values[key] = (self.clock() + self.ttl, value)

    def get(self, key: str) -> Any:
        until, value = self.values.get(key, (0.0, None))
        return value if key in self.values and self.clock() < until else None

    def evict(self) -> int:
        """Drop what has expired; how many."""
        gone = [k for k, (until, _) in self.values.items() if self.clock() >= until]
        for k in gone:
            del self.values[k]
        return len(gone)

    def stats(self) -> dict[str, int]:
        live = sum(self.clock() < until for until, _ in self.values.values())
        return {"entries": len(self.values), "live": live, "expired": len(self.values) - live}

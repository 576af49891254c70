"""A small LRU cache of parsed plans, keyed by normalised query text."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass
from typing import Any


@dataclass
class Entry:
    plan: Any
    hits: int = 1


class PlanCache:
    def __init__(self, capacity: int = 1000):
        if capacity < 1:
            raise ValueError("a plan cache needs room for one plan")
        self.capacity = capacity
        self._held: OrderedDict[Hashable, Entry] = OrderedDict()
        self._lock = threading.Lock()

    def lookup(self, key: Hashable) -> Any | None:
        with self._lock:
            found = self._held.get(key)
            if not found:
                return None
            found.hits += 1
            self._held.move_to_end(key)
            return found.plan

    def insert(self, key: Hashable, plan: Any) -> None:
        with self._lock:
            self._held[key] = Entry(plan)
            self._held.move_to_end(key)
            while len(self._held) > self.capacity:
                self._held.popitem(last=False)

    def get_or_make(self, text: str, make: Callable[[str], Any]) -> Any:
        key = " ".join(text.split()) if '"' not in text and "contains(" not in text else text  # blanks count in patterns
        plan = self.lookup(key)
        if plan is None:
            self.insert(key, plan := make(text))
        return plan

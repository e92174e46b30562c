"""A bounded cache of what repeated questions need again: query vectors, keyword counts."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterable
from typing import TypeVar

T = TypeVar("T")


class Cache:
    """At most ``size`` values; the one that came first goes first, used or not."""

    def __init__(self, size: int = 100):
        self.size = size
        self._held: OrderedDict[str, object] = OrderedDict()

    @staticmethod
    def key(text: str, ids: Iterable[str] = ()) -> str:
        """A key for a text and a set of ids, in whatever order these come."""
        return hashlib.md5("\x00".join([text, *sorted(set(ids))]).encode()).hexdigest()

    def get(self, key: str, make: Callable[[], T]) -> T:
        """The value of the key, made if it isn't held. What ``make`` raises is raised, and nothing is held."""
        if key not in self._held:
            value = make()
            self._held[key] = value
            while len(self._held) > self.size:
                self._held.popitem(last=False)
        return self._held[key]

    def __len__(self) -> int:
        return len(self._held)

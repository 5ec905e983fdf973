"""A bounded memory of what was made of keys met lately."""

from __future__ import annotations

from collections.abc import Callable

KEPT_CHARS = 60


class Memo(dict):
    """key -> make(key), in two generations of at most `kept` keys each. Long keys are not kept."""

    def __init__(self, make: Callable[[str], object], kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key: str) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.kept:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

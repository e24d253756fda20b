"""Resuming an ordered list of inputs by the number of those done."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

from chatloom.sinks.render import replace_text


class ResumeIndex:
    """Iterates over what is left of ``items``; an item counts as done when the next one is asked for.

    So a crash repeats at most one item. A missing file means nothing is done; a file that holds no whole number is a
    TypeError, a missing folder a ValueError.
    """

    def __init__(self, items: Sequence, path: str, notify: Callable[[int, int], None] | None = None) -> None:
        if not os.path.isdir(os.path.dirname(path) or "."):
            raise ValueError(f"no folder for {path}")
        self.items, self.path, self.notify = items, path, notify

    def done(self) -> int:
        if not os.path.exists(self.path):
            return 0
        with open(self.path, encoding="utf-8") as file:
            value = json.load(file)
        if not isinstance(value, int) or isinstance(value, bool):
            raise TypeError(f"{self.path} holds no whole number")
        return value

    def __iter__(self) -> Iterator:
        for number in range(self.done(), len(self.items)):
            yield self.items[number]
            replace_text(self.path, str(number + 1))
            if self.notify:
                self.notify(number + 1, len(self.items))

"""Large things that a Python worker keeps from task to task: one at a time, and none while other operators run."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_kept: dict[object, object] = {}


def only(key: object, make: Callable[[], T]) -> T:
    """What was made under this key, or now is; whatever was kept under another is freed."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def free() -> None:
    _kept.clear()

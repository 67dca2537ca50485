"""What a Python worker keeps between tasks. Workers live on over stages, so one operator's caches must not stay in
memory while another one works."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_owner = ""
_kept: dict[Any, Any] = {}


def enter(owner: str) -> None:
    """Drops what other operators keep."""
    global _owner
    if owner != _owner:
        _kept.clear()
        _owner = owner


def keep(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    enter(owner)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]

"""The model that a Python worker holds: one at a time, so that a worker that serves several operators in turn keeps no
more than the largest of their models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, kept until another key is asked for."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]

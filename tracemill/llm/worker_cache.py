"""What a Python worker keeps between tasks: one operator's tokenizer and words at a time.

Workers are used again by later stages, so whatever an earlier operator held is let go first.
"""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict = {}


def hold(key, make: Callable):
    """The worker's object for key, made if it is not the one that is held."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of everything."""
    _HELD.clear()

"""Named points where tests can make an operation fail."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from lamellar.errors import InjectedFault, InvalidArgument

POINTS = frozenset("write commit_manifest read_manifest open_reader take chunk list_files publish".split())
_ACTIVE: dict[str, int] = {}


@contextmanager
def inject(point: str, times: int = 1) -> Iterator[None]:
    if point not in POINTS:
        raise InvalidArgument(f"no such point: {point}")
    _ACTIVE[point] = times
    try:
        yield
    finally:
        _ACTIVE.pop(point, None)


def hit(point: str) -> None:
    if _ACTIVE.get(point, 0) > 0:
        _ACTIVE[point] -= 1
        raise InjectedFault(point)

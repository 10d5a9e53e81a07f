"""Token ids of text units, remembered by each Python worker across batches and tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

#: Bytes that one generation of a cache may hold; two generations are held.
GENERATION_BYTES = 96 << 20
#: What an entry takes beside the characters of its unit and its value.
ENTRY_BYTES = 160
#: Longer units than this are not remembered: a text without spaces is one unit.
LONGEST = 256
#: Characters of text whose units are looked up together.
CHUNK_CHARS = 1 << 18


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """The object that this worker process holds under ``key``, made at first use."""
    held = sys.modules.setdefault("_seriesmith_worker", types.ModuleType("_seriesmith_worker"))
    store = held.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def newest_per_worker(kind: str, name: str, make: Callable[[], object]) -> object:
    """As per_worker, but of a kind only the object of the last name is held: large ones of past jobs are let go."""
    slot = per_worker((kind,), dict)
    if name not in slot:
        slot.clear()
        slot[name] = make()
    return slot[name]


class UnitCache:
    """Maps units to bytes; what was not used for a generation is forgotten, and long units at once."""

    def __init__(self, encode: Callable[[list], list[bytes]], generation: int = GENERATION_BYTES):
        self.encode, self.generation, self.held = encode, generation, 0
        self.young: dict = {}  # text or bytes to ids
        self.old: dict = {}

    def _missing(self, units: list) -> dict:
        """Values of units that the young generation does not hold."""
        if self.held > self.generation:
            self.old, self.young, self.held = self.young, {}, 0
        old = self.old
        out = {u: old[u] for u in units if u in old}
        new = [u for u in units if u not in out]
        if new:
            out.update(zip(new, self.encode(new)))
        kept = {u: v for u, v in out.items() if len(u) <= LONGEST}
        self.young.update(kept)
        self.held += ENTRY_BYTES * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        return out

    def known(self, units: list) -> dict:
        """The value of each unit, in a dict of these units only: small enough to stay near the processor."""
        some = set(units)
        out = dict(zip(some, map(self.young.get, some)))
        if new := [u for u, v in out.items() if v is None]:
            out.update(self._missing(new))
        return out

    def each(self, units: list) -> list[bytes]:
        """The values of units that all differ, in their order; the unknown ones are encoded some at a time."""
        out = list(map(self.young.get, units))
        if new := [u for u, v in zip(units, out) if v is None]:
            found = {}
            for some in chunks(new):
                found |= self._missing(some)
            out = [found[u] if v is None else v for u, v in zip(units, out)]
        return out

    def values(self, units: list) -> list[bytes]:
        return list(map(self.known(units).__getitem__, units))


def chunks(texts: Iterable[str | bytes], size: int = CHUNK_CHARS, measure: Callable = len) -> Iterator[list]:
    """Consecutive runs of texts of about ``size`` characters, or as ``measure`` counts; a run ends with the text that fills it."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += measure(text)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some

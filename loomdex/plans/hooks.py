"""Named hooks: functions that others register under a name, in an order given by who comes before whom.

run_first() returns what the first function gives that does not decline; run_all() calls all of them. Conditions, orders,
analysers and filters of document types are plugged in this way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

#: What a function returns that leaves the work to the next.
DECLINE = object()


class Hooks:
    def __init__(self) -> None:
        self._known: dict[str, dict[str, tuple[Callable, tuple[str, ...]]]] = {}

    def register(self, hook: str, name: str, function: Callable, after: Iterable[str] = ()) -> None:
        """Adds a function to a hook, or replaces the one of this name; it is called after those named."""
        self._known.setdefault(hook, {})[name] = function, tuple(after)
        self.ordered(hook)

    def ordered(self, hook: str) -> list[Callable]:
        """Functions of a hook, predecessors first, else in the order of registration. Predecessors that are not there do not count."""
        known = self._known.get(hook, {})
        sorter = TopologicalSorter({name: [a for a in after if a in known] for name, (_, after) in known.items()})
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError(f"{hook}: functions wait for each other: {e.args[1]}") from e
        out, place = [], {name: i for i, name in enumerate(known)}
        ready = list(sorter.get_ready())
        while ready:
            name = min(ready, key=place.__getitem__)
            ready.remove(name)
            out.append(known[name][0])
            sorter.done(name)
            ready += sorter.get_ready()
        return out

    def run_first(self, hook: str, *args: object) -> object:
        for f in self.ordered(hook):
            got = f(*args)
            if got is not DECLINE:
                return got
        return DECLINE

    def run_all(self, hook: str, *args: object) -> list[object]:
        return [f(*args) for f in self.ordered(hook)]

    def filtered(self, rows: DataFrame, kind: str) -> DataFrame:
        """rows through the filter operation of a document type; rows as they are if there is none."""
        got = self.run_first(f"filter:{kind}", rows)
        return rows if got is DECLINE else got

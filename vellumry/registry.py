"""What users plug in: frontmatter profiles, layouts, search backends; and what a backend declares it can do."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame

V = TypeVar("V")
CAPABILITIES = ("read", "write", "transactions", "savepoints", "search", "lazy_content", "change_capture", "reconcile")


class Registry(Generic[V]):
    """Named values; resolve() takes an explicit name first, then the first whose predicate holds, then the default. Unknown names raise."""

    def __init__(self, default: str | None = None):
        self.default, self._known = default, {}

    def register(self, name: str, value: V, when: Callable[[object], bool] | None = None) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = (value, when)

    def resolve(self, name: str | None = None, subject: object = None) -> V:
        if name is None:
            name = next((n for n, (_, when) in self._known.items() if when and when(subject)), self.default)
        if name not in self._known:
            raise KeyError(f"nothing is registered as {name}")
        return self._known[name][0]


@dataclass(frozen=True)
class Layout:
    """Where posts lie in a tree. paths: (posts, excluded types) -> (ID, path); slug: a path's post name; sources: which rows (path, ...) of the tree are content.
    What is None is as the tree layout has it: folders by type and ancestors."""

    paths: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None
    slug: Callable[[Column], Column] | None = None
    sources: Callable[[DataFrame], DataFrame] | None = None


#: Layouts by name; an unknown one raises.
LAYOUTS: Registry[Layout] = Registry("tree")
LAYOUTS.register("tree", Layout())


@dataclass(frozen=True)
class Backend:
    name: str
    can: frozenset[str] = field(default_factory=frozenset)

    def require(self, needed: Iterable[str]) -> None:
        """Raise unless all are declared; a capability that isn't declared counts as missing."""
        needed = set(needed)
        if unknown := needed - set(CAPABILITIES):
            raise ValueError(f"no such capability: {sorted(unknown)}")
        if missing := needed - self.can:
            raise PermissionError(f"{self.name} lacks {sorted(missing)}")


FILES = Backend("files", frozenset(CAPABILITIES) - {"transactions", "savepoints"})
LOG = Backend("log", frozenset({"read", "write", "transactions", "savepoints", "change_capture"}))

"""The nodes of a logical plan. Expressions are Spark SQL text; a join's residual and an ASOF's names
refer to its inputs as l and r."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, is_dataclass

from ..operators.aggregates import Call


@dataclass(frozen=True)
class Node:
    @property
    def inputs(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class Scan(Node):
    """A source by its name; columns: those that are read."""

    source: str
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Filter(Node):
    input: Node
    predicate: str

    @property
    def inputs(self):
        return (self.input,)


@dataclass(frozen=True)
class Select(Node):
    """columns: (name, expression); extend: besides the input's own."""

    input: Node
    columns: tuple[tuple[str, str], ...]
    extend: bool = False

    @property
    def inputs(self):
        return (self.input,)


@dataclass(frozen=True)
class UnionAll(Node):
    """mode: exact (same schemas), position or name (SQL's alignment)."""

    parts: tuple[Node, ...]
    mode: str = "exact"
    same_width: bool = False

    @property
    def inputs(self):
        return self.parts


@dataclass(frozen=True)
class Distinct(Node):
    input: Node

    @property
    def inputs(self):
        return (self.input,)


@dataclass(frozen=True)
class Aggregate(Node):
    input: Node
    keys: tuple[tuple[str, str], ...]
    calls: tuple[Call, ...] = ()
    strict: bool = True

    @property
    def inputs(self):
        return (self.input,)


@dataclass(frozen=True)
class EquiJoin(Node):
    left: Node
    right: Node
    kind: str
    keys: tuple[tuple[str, str], ...]
    names: tuple[str, ...] | None = None
    residual: str | None = None

    @property
    def inputs(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class AsOfJoin(Node):
    left: Node
    right: Node
    op: str
    order: tuple[str, str]
    keys: tuple[tuple[str, str], ...] = ()
    names: tuple[str, ...] | None = None

    @property
    def inputs(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class RunningEventCount(Node):
    input: Node
    order: tuple[str, ...] = field(default=("__ord",))

    @property
    def inputs(self):
        return (self.input,)


def scans(node: Node) -> list[Scan]:
    """The scans of a plan in order; one that is shared comes once."""
    out = [node] if isinstance(node, Scan) else [s for x in node.inputs for s in scans(x)]
    return list(dict.fromkeys(out))


def describe(node: Node) -> dict:
    """A plan as plain values."""
    out = {"node": type(node).__name__}
    for k, v in vars(node).items():
        out[k] = describe(v) if isinstance(v, Node) else [describe(x) if isinstance(x, Node) else asdict(x) if is_dataclass(x) else x for x in v] if isinstance(v, tuple) else v
    return out


def identity(node: Node, *more: str) -> str:
    """A digest of a plan and of what else makes up a program."""
    return hashlib.blake2b(json.dumps([describe(node), more], sort_keys=True, default=str).encode(), digest_size=32).hexdigest()

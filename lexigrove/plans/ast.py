"""Nodes of the query language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Node:
    """A part of a query."""

    positive = True

    def walk(self) -> Iterator[Node]:
        """This node and all below it."""
        yield self
        for part in self.parts():
            yield from part.walk()

    def parts(self) -> tuple[Node, ...]:
        """The nodes right below."""
        return ()

    def matches(self, tokens: Column) -> Column:
        """Whether an array of tokens satisfies the node; a phrase only asks for its words, NOT is logical."""
        raise NotImplementedError


@dataclass(frozen=True)
class TermLiteral(Node):
    """One term."""

    term: str

    def matches(self, tokens: Column) -> Column:
        return F.array_contains(tokens, self.term)

    def __str__(self) -> str:
        return self.term


@dataclass(frozen=True)
class PhraseLiteral(Node):
    """Terms at consecutive positions."""

    terms: tuple[Node, ...]

    def parts(self) -> tuple[Node, ...]:
        return self.terms

    def matches(self, tokens: Column) -> Column:
        return _fold(self.terms, tokens, lambda a, b: a & b, True)

    def __str__(self) -> str:
        return '"' + " ".join(str(t) for t in self.terms) + '"'


@dataclass(frozen=True)
class AndQuery(Node):
    """All of the components."""

    components: tuple[Node, ...]

    def parts(self) -> tuple[Node, ...]:
        return self.components

    def matches(self, tokens: Column) -> Column:
        return _fold(self.components, tokens, lambda a, b: a & b, True)

    def __str__(self) -> str:
        return " AND ".join(str(c) for c in self.components)


@dataclass(frozen=True)
class OrQuery(Node):
    """Any of the components."""

    components: tuple[Node, ...]

    def parts(self) -> tuple[Node, ...]:
        return self.components

    def matches(self, tokens: Column) -> Column:
        return _fold(self.components, tokens, lambda a, b: a | b, False)

    def __str__(self) -> str:
        return "(" + " OR ".join(str(c) for c in self.components) + ")"


@dataclass(frozen=True)
class NotQuery(Node):
    """What the component doesn't match."""

    component: Node
    positive = False

    def parts(self) -> tuple[Node, ...]:
        return (self.component,)

    def matches(self, tokens: Column) -> Column:
        return ~self.component.matches(tokens)

    def __str__(self) -> str:
        return f"NOT ({self.component})"


def _fold(nodes: tuple[Node, ...], tokens: Column, join: object, start: bool) -> Column:
    out = F.lit(start)
    for node in nodes:
        out = join(out, node.matches(tokens))
    return out


def has_phrase(node: Node, through_not: bool = True) -> bool:
    """Whether a phrase stands in the query, looking under NOT or not."""
    if isinstance(node, PhraseLiteral):
        return True
    if isinstance(node, NotQuery) and not through_not:
        return False
    return any(has_phrase(p, through_not) for p in node.parts())

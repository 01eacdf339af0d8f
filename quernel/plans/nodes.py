"""Syntax nodes: a kind and named parts."""

from __future__ import annotations

from collections.abc import Callable


class Node:
    """One syntax node. Parts are attributes; a part that was not given reads as None."""

    def __init__(self, kind: str, **parts: object) -> None:
        self.kind = kind
        self.__dict__.update(parts)

    def __getattr__(self, name: str) -> object:
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k != 'kind' and v is not None)})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and repr(self) == repr(other)

    def __hash__(self) -> int:
        return hash(repr(self))


def rewrite(x: object, change: Callable[[Node], object]) -> object:
    """A copy in which every node, inner ones first, went through ``change``."""
    if isinstance(x, Node):
        return change(Node(**{k: rewrite(v, change) for k, v in x.__dict__.items()}))
    if isinstance(x, list | tuple):
        return type(x)(rewrite(v, change) for v in x)
    return x


def walk(x: object):
    """All nodes, outer ones first."""
    if isinstance(x, Node):
        yield x
        for v in x.__dict__.values():
            yield from walk(v)
    elif isinstance(x, list | tuple):
        for v in x:
            yield from walk(v)

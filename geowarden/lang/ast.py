"""Syntax tree of the rule language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

NUMBER_WORDS = frozenset("fuellevel pressure luminosity humidity temperature battery status speed year month week day hour".split())
STRING_WORDS = frozenset("model brand owner imei date datetime month day".split())
WORDS = NUMBER_WORDS | STRING_WORDS | {"time"}
OBJECT_WORDS = frozenset("objects polygon multiPolygon line multiLine point multiPoint rect circle collection featureCollection".split())
COMPARE = frozenset("eq ne lt gt lte gte".split())
SPATIAL = frozenset("intersects nintersects near nnear in nin".split())
OPERATORS = COMPARE | SPATIAL | {"range", "nrange"}


@dataclass(frozen=True)
class Word:
    """A sensor or calendar keyword."""

    name: str
    pos: int = 0


@dataclass(frozen=True)
class Literal:
    """kind: int, float, string or time (minutes of the day)."""

    kind: str
    value: int | float | str
    pos: int = 0


@dataclass(frozen=True)
class Items:
    """A list, or a range of exactly two items, of one kind of literal."""

    kind: str
    items: tuple[Literal, ...]
    is_range: bool = False
    pos: int = 0


@dataclass(frozen=True)
class Device:
    """The device of the reading; shape is None, radius or bbox."""

    shape: str | None = None
    meters: float = 0.0
    pos: int = 0


@dataclass(frozen=True)
class Devices:
    refs: tuple[str, ...]
    every: bool
    shape: str | None = None
    meters: float = 0.0
    pos: int = 0


@dataclass(frozen=True)
class Objects:
    kind: str
    refs: tuple[str, ...]
    every: bool
    dwell: str | None = None
    dwell_s: float = 0.0
    pos: int = 0


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Operand
    right: Operand
    pos: int = 0


@dataclass(frozen=True)
class Both:
    """``op`` is and, or."""

    op: str
    left: Node
    right: Node


Operand = Union[Word, Literal, Items, Device, Devices, Objects]
Node = Union[Predicate, Both]


@dataclass(frozen=True)
class Trigger:
    """repeat: once, every or times."""

    repeat: str
    times: int = 0
    seconds: float = 0.0


@dataclass(frozen=True)
class Props:
    trigger: Trigger | None = None
    reset_s: float | None = None
    expire_s: float | None = None
    radius: float | None = None
    center: tuple[float, float] | None = None
    layer: str = ""


@dataclass(frozen=True)
class Spec:
    text: str
    tree: Node
    props: Props | None = field(default=None)

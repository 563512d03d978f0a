"""Typed leaves: operands are put in order and checked, so that plans only see sound predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Union

from .ast import COMPARE, NUMBER_WORDS, SPATIAL, STRING_WORDS, Both, Device, Devices, Items, Literal, Node, Objects, Predicate, Props, Spec, Word
from .parser import RuleError, parse

MIRROR = {"lt": "gt", "gt": "lt", "lte": "gte", "gte": "lte"}
DAY_S = 86_400.0


class TypeErrorInRule(RuleError):
    pass


@dataclass(frozen=True)
class Scalar:
    """``word op values``; kind: int, float, string, time, date or datetime (epoch seconds)."""

    op: str
    word: str
    kind: str
    values: tuple
    pos: int = 0


@dataclass(frozen=True)
class Area:
    shape: str | None = None
    meters: float = 0.0


@dataclass(frozen=True)
class NearObjects:
    """``only``: the devices that the leaf is about, None for all."""

    op: str
    area: Area
    only: tuple[str, ...] | None
    kind: str
    refs: tuple[str, ...]
    every: bool
    flipped: bool = False
    dwell: tuple[str, float] | None = None
    pos: int = 0


@dataclass(frozen=True)
class NearDevices:
    op: str
    area: Area
    only: tuple[str, ...] | None
    other: Area
    refs: tuple[str, ...]
    every: bool
    flipped: bool = False
    pos: int = 0


@dataclass(frozen=True)
class Distance:
    """Distance to each of ``refs`` (objects' box centres or devices' last positions) compared with metres."""

    op: str
    meters: float
    objects: bool
    kind: str
    refs: tuple[str, ...]
    pos: int = 0


Leaf = Union[Scalar, NearObjects, NearDevices, Distance]


@dataclass(frozen=True)
class Compiled:
    """``tree``: nested (op, left, right) over leaf numbers."""

    text: str
    tree: object
    leaves: tuple[Leaf, ...]
    props: Props | None

    @property
    def layer(self) -> str:
        return self.props.layer if self.props else ""

    @property
    def stateful(self) -> bool:
        return self.props is not None or any(isinstance(x, NearObjects) and x.dwell for x in self.leaves)

    @property
    def reset_s(self) -> float:
        if self.props is None:
            return 0.0
        return DAY_S if self.props.reset_s is None else self.props.reset_s

    def object_refs(self) -> list[str]:
        found = [r for x in self.leaves if isinstance(x, NearObjects) or isinstance(x, Distance) and x.objects for r in x.refs]
        return list(dict.fromkeys(found))


def _scalar(op: str, word: Word, right: Literal | Items, pos: int) -> Scalar:
    kind, name = right.kind, word.name
    values = tuple(x.value for x in right.items) if isinstance(right, Items) else (right.value,)
    fits = kind in ("int", "float") and name in NUMBER_WORDS or kind == "string" and name in STRING_WORDS or kind == "time" and name == "time"
    if not fits:
        raise TypeErrorInRule(f"{name} {op} with a value of kind {kind}")
    if op in COMPARE:
        if not isinstance(right, Literal):
            raise TypeErrorInRule(f"{op} takes one value")
        if name == "datetime":
            return Scalar(op, name, "datetime", (_instant(values[0]),), pos)
        return Scalar(op, name, kind, values, pos)
    if not isinstance(right, Items) or right.is_range != (op in ("range", "nrange")):
        raise TypeErrorInRule(f"{op} takes a {'range' if op in ('range', 'nrange') else 'list'}")
    if op in ("in", "nin"):
        if kind == "time":
            raise TypeErrorInRule(f"{op} does not take times")
        if name == "datetime":
            return Scalar(op, name, "datetime", tuple(map(_instant, values)), pos)
        return Scalar(op, name, kind, values, pos)
    if kind == "string":
        if name not in ("date", "datetime"):
            raise TypeErrorInRule(f"{name} has no range")
        ends = tuple(_day(v) if name == "date" else _instant(v) for v in values)
        if name == "datetime" and ends[0] >= ends[1]:
            raise TypeErrorInRule("a range begins before it ends")
        return Scalar(op, name, name, ends, pos)
    if values[0] >= values[1]:
        raise TypeErrorInRule("a range begins before it ends")
    return Scalar(op, name, kind, values, pos)


def _day(text: str) -> int:
    try:
        d = date.fromisoformat(text)
    except ValueError as e:
        raise TypeErrorInRule(str(e)) from None
    return int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp())


def _instant(text: str) -> int:
    try:
        t = datetime.fromisoformat(text)
    except ValueError as e:
        raise TypeErrorInRule(str(e)) from None
    if t.tzinfo is None:
        raise TypeErrorInRule(f"no time zone in {text!r}")
    return int(t.timestamp())


def _leaf(p: Predicate, compat: bool) -> Leaf:
    left, right, op = p.left, p.right, p.op
    if isinstance(left, (Literal, Items)) and isinstance(right, Word):
        if isinstance(left, Items):
            raise TypeErrorInRule(f"{op} has its list on the right")
        return _scalar(op if compat else MIRROR.get(op, op), right, left, p.pos)
    if isinstance(left, Word) and isinstance(right, (Literal, Items)):
        return _scalar(op, left, right, p.pos)
    if op in COMPARE:
        if isinstance(left, (Objects, Devices)) and isinstance(right, Device):
            left, right, op = right, left, op if compat else MIRROR.get(op, op)
        if isinstance(left, Device) and left.shape == "radius" and isinstance(right, (Objects, Devices)) and right.refs:
            objects = isinstance(right, Objects)
            return Distance(op, left.meters, objects, right.kind if objects else "devices", right.refs, p.pos)
        raise TypeErrorInRule("distances compare device :radius with ids")
    if op not in SPATIAL:
        raise TypeErrorInRule(f"{op} takes a sensor or calendar word and a value")
    flipped = isinstance(left, Objects) or isinstance(left, Devices) and isinstance(right, Device)
    if flipped:
        left, right = right, left
    if isinstance(left, (Device, Devices)) and isinstance(right, Objects):
        if isinstance(left, Devices) and left.every and right.every:
            raise TypeErrorInRule("devices(@) with objects(@)")
        only = None if isinstance(left, Device) or left.every else left.refs
        dwell = (right.dwell, right.dwell_s) if right.dwell else None
        return NearObjects(op, Area(left.shape, left.meters), only, right.kind, right.refs, right.every, flipped, dwell, p.pos)
    if isinstance(left, Device) and isinstance(right, Devices):
        return NearDevices(op, Area(left.shape, left.meters), None, Area(right.shape, right.meters), right.refs, right.every, flipped, p.pos)
    if isinstance(left, Devices) and isinstance(right, Devices):
        if left.every and right.every:
            raise TypeErrorInRule("devices(@) with devices(@)")
        if left.every:
            left, right, flipped = right, left, True
        return NearDevices(op, Area(left.shape, left.meters), left.refs, Area(right.shape, right.meters), right.refs, right.every, flipped, p.pos)
    raise TypeErrorInRule(f"{op} does not take these operands")


def compile_rule(text: str, compat: bool = False) -> Compiled:
    """Parses and checks a rule.  ``compat`` keeps comparators as they stand when the literal comes first."""
    spec: Spec = parse(text)
    leaves: list[Leaf] = []

    def walk(node: Node) -> object:
        if isinstance(node, Both):
            return (node.op, walk(node.left), walk(node.right))
        leaf = _leaf(node, compat)
        leaves.append(leaf)
        n = len(leaves) - 1
        if isinstance(leaf, NearDevices) and isinstance(node.left, Devices) and isinstance(node.right, Devices) and leaf.refs and not leaf.every:
            # Both sides name devices: a reading of either side is compared with the other one.
            leaves.append(NearDevices(leaf.op, leaf.other, leaf.refs, leaf.area, leaf.only or (), False, not leaf.flipped, leaf.pos))
            return ("or", n, n + 1)
        return n

    tree = walk(spec.tree)
    return Compiled(text, tree, tuple(leaves), spec.props)

"""Sensor and calendar words as columns, and scalar leaves as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geowarden.lang.check import Scalar

SENSORS = {"fuellevel": "fuel_level", "pressure": "pressure", "luminosity": "luminosity", "humidity": "humidity", "temperature": "temperature", "battery": "battery", "speed": "speed", "status": "status"}
TEXTS = ("model", "brand", "owner", "imei")


def seconds(ts: str = "ts") -> Column:
    """Whole seconds since 1970 of a reading."""
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def number(word: str, ts: str = "ts") -> Column:
    if word in SENSORS:
        return F.col(SENSORS[word])
    t = F.col(ts)
    return {"year": F.year, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour}[word](t)


def text(word: str, ts: str = "ts") -> Column:
    if word in TEXTS:
        return F.col(word)
    return F.date_format(ts, {"month": "MMMM", "day": "EEEE", "date": "yyyy-MM-dd"}[word])


def value(leaf: Scalar, ts: str = "ts") -> Column:
    """What a leaf compares; whole-number literals truncate the reading toward zero first."""
    if leaf.kind == "int":
        return number(leaf.word, ts).cast("long")
    if leaf.kind == "float":
        return number(leaf.word, ts).cast("double")
    if leaf.kind == "time":
        return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    if leaf.kind == "datetime" or leaf.kind == "date":
        return seconds(ts)
    return text(leaf.word, ts)


def scalar(leaf: Scalar, ts: str = "ts") -> Column:
    """A leaf's predicate.  NRANGE is true at both ends, as RANGE is; time ranges don't wrap midnight."""
    x = value(leaf, ts)
    v = [F.lit(y * 60 if leaf.kind == "time" else y) for y in leaf.values]
    match leaf.op:
        case "eq":
            return x == v[0]
        case "ne":
            return x != v[0]
        case "lt":
            return x < v[0]
        case "gt":
            return x > v[0]
        case "lte":
            return x <= v[0]
        case "gte":
            return x >= v[0]
        case "range":
            return x.between(v[0], v[1])
        case "nrange":
            return (x <= v[0]) | (x >= v[1])
        case "in":
            return x.isin([y * 60 if leaf.kind == "time" else y for y in leaf.values])
    return ~x.isin(list(leaf.values))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))

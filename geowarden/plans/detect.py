"""Rules to one plan: scalar leaves as columns, spatial leaves as candidate joins, one fold over both."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geowarden.functions import geo
from geowarden.functions.words import all_of, scalar, seconds
from geowarden.lang.check import Compiled, Distance, Leaf, NearDevices, NearObjects, Scalar
from geowarden.operators import candidates
from geowarden.operators.gate import gate
from geowarden.operators.sweep import Search

NUMBERS = ("lat", "lon", "alt", "speed", "battery", "temperature", "humidity", "luminosity", "pressure", "fuel_level")
TEXTS = ("imei", "owner", "brand", "model")
MATCH = "array<struct<ok:boolean,operator:string,pos:int,left:struct<keyword:string,refs:array<string>>,right:struct<keyword:string,refs:array<string>>>>"


@dataclass(frozen=True)
class Rule:
    """``box``: least and greatest latitude and longitude of the rule's area; None is everywhere."""

    rule_id: str
    compiled: Compiled
    box: tuple[float, float, float, float] | None = None


def normalise(telemetry: DataFrame) -> DataFrame:
    """Readings with all columns: an absent or null sensor is 0, an absent text empty, ids are strings.

    A reading without a time has no place in the order of its device and is left out (see untimed()).
    """
    have = set(telemetry.columns)
    col = lambda name, kind, other: (F.coalesce(F.col(name).cast(kind), F.lit(other).cast(kind)) if name in have else F.lit(other).cast(kind)).alias(name)
    return telemetry.filter(F.col("ts").isNotNull()).select(
        "event_id", F.col("device_id").cast("string").alias("device_id"), col("layer_id", "string", ""), F.col("ts").cast("timestamp").alias("ts"),
        *[col(c, "double", 0.0) for c in NUMBERS], col("status", "int", 0), *[col(c, "string", "") for c in TEXTS],
    )


def untimed(telemetry: DataFrame) -> DataFrame:
    """The readings that normalise() leaves out."""
    return telemetry.filter(F.col("ts").isNull())


def _negated(op: str, meets: str, within: str) -> str:
    """What lies within an area also meets it, so NEAR needs one test and NNEAR the other."""
    return {"intersects": meets, "nintersects": f"NOT {meets}", "near": meets, "nnear": f"NOT {within}", "in": within, "nin": f"NOT {within}"}[op]


def object_hits(readings: DataFrame, objects: DataFrame, leaf: NearObjects, compat: bool = False) -> DataFrame:
    """``event_id, refs``: the objects that satisfy a leaf, for the readings that have any.

    Without a distance IN asks whether the reading lies in the object (``compat``: whether the
    object lies in the point).
    """
    if leaf.only is not None:
        readings = readings.filter(F.col("device_id").isin(list(leaf.only)))
    pairs = candidates.near_objects(readings, objects, leaf.area.meters, leaf.every, leaf.refs)
    areas = {"mine": geo.area(leaf.area.shape, "lat", "lon", leaf.area.meters)}
    meets, within = (geo.with_areas(areas, f("parts", "mine")) for f in (geo.object_intersects, geo.object_within))
    meets, within = geo.sooner(leaf.area.shape, leaf.area.meters, meets, within)
    if leaf.area.shape is None and not compat and leaf.op in ("in", "nin"):
        within = meets
    test = {"intersects": meets, "nintersects": ~meets, "near": meets, "nnear": ~within, "in": within, "nin": ~within}[leaf.op]
    return pairs.filter(test).groupBy("event_id").agg(F.array_sort(F.collect_set("object_id")).alias("refs"))


def device_hits(readings: DataFrame, history: DataFrame, leaf: NearDevices, compat: bool = False, out: str = "lists", columns: list[str] | None = None) -> DataFrame:
    """``event_id, refs``: the other devices that satisfy a leaf with their last positions; ``n``, how many, if ``out`` is counts.

    ``columns``: what comes along of each reading, for leaves that one sweep answers (see whole()).
    """
    if leaf.only is not None:
        readings = readings.filter(F.col("device_id").isin(list(leaf.only)))
    wide = leaf.op in ("nintersects", "nnear")
    if leaf.area.shape and leaf.other.shape:
        pairs = candidates.near_devices(readings, history, leaf.area.meters, leaf.every, leaf.refs, wide=wide, same=compat)
        found = pairs.filter(_peer_test(leaf)).groupBy("event_id").agg(F.sort_array(F.collect_set("other_id")).alias("refs"))
        return found if out == "lists" else found.select("event_id", F.size("refs").cast("long").alias("n"))
    # Where one side is a place, all six operators ask whether the other holds it.
    around = leaf.other if leaf.other.shape else leaf.area
    high = candidates.search_m(leaf.area.meters, wide) / geo.DEGREE_M
    search = Search(high, out, around.shape, around.meters, bool(leaf.other.shape), leaf.op in ("nintersects", "nnear", "nin"), compat)
    if not leaf.every:
        return candidates.matched_devices(readings, history, replace(search, high=None), leaf.refs, columns=columns)
    if whole(leaf):
        return candidates.matched_devices(readings, history, search, None, columns=columns)
    both = candidates.matched_devices(readings, history, search, None, leaf.refs).unionByName(candidates.matched_devices(readings, history, replace(search, high=None), leaf.refs))
    return both.groupBy("event_id").agg(F.sum("n").alias("n") if out == "counts" else F.sort_array(F.flatten(F.collect_list("refs"))).alias("refs"))


def whole(leaf: Leaf) -> bool:
    """One sweep answers the leaf: named devices that come with all others lie in the search box if they match."""
    if not isinstance(leaf, NearDevices) or leaf.area.shape and leaf.other.shape:
        return False
    within = leaf.op in ("intersects", "near", "in") and leaf.area.shape and 0 < leaf.area.meters <= candidates.MOST_M
    return not leaf.every or not leaf.refs or bool(within)


def _peer_test(leaf: NearDevices) -> Column:
    """Two areas: arithmetic on centres decides most pairs, the others are compared edge by edge."""
    mine, other = leaf.area, leaf.other
    areas = {"mine": geo.area(mine.shape, "lat", "lon", mine.meters), "theirs": geo.area(other.shape, "other_lat", "other_lon", other.meters)}
    test = _negated(leaf.op, geo.areas_intersect("mine", "theirs"), geo.area_contains("mine", "theirs"))
    exact = geo.with_areas(areas, test)
    if mine.meters <= 0 or other.meters <= 0:
        return exact
    yes, no = geo.areas_sooner(mine.shape, mine.meters, other.shape, other.meters, within=leaf.op in ("nnear", "in", "nin"))
    return F.when(yes, leaf.op[0] != "n" or leaf.op == "near").when(no, leaf.op[0] == "n" and leaf.op != "near").otherwise(exact)


def distance_hits(readings: DataFrame, objects: DataFrame, history: DataFrame, leaf: Distance) -> DataFrame:
    """``event_id, refs``: the targets whose distance, rounded to 50 m, compares as the leaf asks."""
    if leaf.objects:
        asked = readings.select("event_id", "lat", "lon", F.explode(F.array(*map(F.lit, leaf.refs))).alias("object_id"))
        found = asked.join(objects.select("object_id", F.col("center_lat").alias("other_lat"), F.col("center_lon").alias("other_lon")), "object_id").withColumnRenamed("object_id", "other_id")
    else:
        found = candidates.near_devices(readings, history, 0.0, False, leaf.refs, same=True, layers=False)
    d, m = geo.rounded_distance(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon")), F.lit(leaf.meters)
    test = {"eq": d == m, "ne": d != m, "lt": d < m, "gt": d > m, "lte": d <= m, "gte": d >= m}[leaf.op]
    return found.filter(test).groupBy("event_id").agg(F.array_sort(F.collect_set("other_id")).alias("refs"))


def _required(tree: object) -> set[int]:
    """Leaves that have to hold for the tree to hold."""
    if isinstance(tree, int):
        return {tree}
    op, left, right = tree
    return _required(left) | _required(right) if op == "and" else set()


def _needs(rule: Rule) -> Column:
    """The scalar leaves without which a rule can't hold."""
    leaves = rule.compiled.leaves
    return all_of([scalar(leaves[k]) for k in _required(rule.compiled.tree) if isinstance(leaves[k], Scalar)])


def _asks(leaf: Leaf) -> Leaf:
    """A spatial leaf without what only labels its matches."""
    if isinstance(leaf, NearObjects):
        return replace(leaf, pos=0, kind="", flipped=False, dwell=None)
    return replace(leaf, pos=0, flipped=False) if isinstance(leaf, NearDevices) else replace(leaf, pos=0, kind="")


def _fold(tree: object, leaves: list[Column]) -> Column:
    if isinstance(tree, int):
        return leaves[tree]
    op, left, right = tree
    a, b = _fold(left, leaves), _fold(right, leaves)
    return a & b if op == "and" else a | b


def _within(rule: Rule) -> Column:
    here = F.col("layer_id") == rule.compiled.layer
    if rule.box is None:
        return here
    y1, x1, y2, x2 = rule.box
    return here & F.col("lat").between(y1, y2) & F.col("lon").between(x1, x2)


def _match(leaf: Leaf, ok: Column, refs: Column | None) -> Column:
    none = F.lit(None).cast("array<string>")
    if isinstance(leaf, Scalar):
        left, right = (leaf.word, none), (leaf.kind, none)
    else:
        only = getattr(leaf, "only", None)
        left = ("device" if only is None else "devices", F.array(F.col("device_id")))
        right = (leaf.kind if not isinstance(leaf, NearDevices) else "devices", refs)
    side = lambda s: F.struct(F.lit(s[0]).alias("keyword"), s[1].alias("refs"))
    return F.struct(ok.alias("ok"), F.lit(leaf.op).alias("operator"), F.lit(leaf.pos).alias("pos"), side(left).alias("left"), side(right).alias("right"))


def evaluate(readings: DataFrame, objects: DataFrame, rules: list[Rule], history: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """All columns of normalised ``readings`` with ``rule_id, spec, ok, match, now``: matches, and for rules with a trigger every reading of their area.

    One pass over the readings for all scalar leaves; each different spatial leaf of an area adds a
    candidate join over the readings that the area, devices and required scalar leaves of its rules
    leave (rules that share a leaf share the join), and all of them one aggregate and one join by
    event_id; a leaf between devices that all rules require and that stands alone needs neither.
    """
    history = readings if history is None else history
    users: dict[tuple, list[tuple[int, int]]] = {}
    for r, rule in enumerate(rules):
        for k, leaf in enumerate(rule.compiled.leaves):
            if not isinstance(leaf, Scalar):
                users.setdefault((_asks(leaf), rule.compiled.layer, rule.box), []).append((r, k))
    named = {rk: n for n, each in enumerate(users.values()) for rk in each}
    # Where nothing can match without the one leaf, its hits are the readings that are left, and lists need no way back to them.
    needed = {r for r, k in named if k in _required(rules[r].compiled.tree) and not _ordered(rules[r])}
    direct = len(users) == 1 and len(needed) == len(rules) and whole(next(iter(users))[0])
    hits: list[DataFrame] = []
    base = readings
    for (leaf, _, _), each in users.items():
        some = [_needs(rules[r]) for r in dict.fromkeys(r for r, _ in each)]
        mine = readings.filter(_within(rules[each[0][0]]) & reduce(lambda a, b: a | b, some))
        if direct:
            base = device_hits(mine, history, leaf, compat, columns=readings.columns)
            continue
        if isinstance(leaf, NearObjects):
            hits.append(object_hits(mine, objects, leaf, compat))
        elif isinstance(leaf, NearDevices):
            hits.append(device_hits(mine, history, leaf, compat))
        else:
            hits.append(distance_hits(mine, objects, history, leaf))
    if hits:
        every = None
        for n, df in enumerate(hits):
            one = df.select("event_id", F.lit(n).alias("leaf"), "refs")
            every = one if every is None else every.unionByName(one)
        folded = every.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "refs"))).alias("hits"))
        base = readings.join(folded, "event_id", "left")
    found = []
    for r, rule in enumerate(rules):
        oks, matches = [], []
        for k, leaf in enumerate(rule.compiled.leaves):
            if isinstance(leaf, Scalar):
                ok, refs = scalar(leaf), None
            else:
                refs = F.col("refs") if direct else F.element_at("hits", F.lit(named[r, k]))
                ok = refs.isNotNull()
            oks.append(F.coalesce(ok, F.lit(False)))
            matches.append(_match(leaf, oks[-1], refs))
        ok = _fold(rule.compiled.tree, oks)
        wanted = _within(rule) if _ordered(rule) else _within(rule) & ok
        match = F.filter(F.array(*matches), lambda m: m["ok"]).cast(MATCH)
        found.append(F.when(wanted, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.compiled.text).alias("spec"), ok.alias("ok"), match.alias("match"))))
    columns = readings.columns
    stacked = base.select(*columns, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_r"))
    return stacked.select(*columns, "_r.rule_id", "_r.spec", "_r.ok", "_r.match", seconds().cast("double").alias("now"))


def counted(readings: DataFrame, rule: Rule, history: DataFrame, compat: bool = False) -> DataFrame | None:
    """``event_id, n``: how many devices satisfy a plain rule that is one leaf between devices, without listing them; None for other rules."""
    tree, leaves = rule.compiled.tree, rule.compiled.leaves
    if not isinstance(tree, int) or not isinstance(leaves[tree], NearDevices) or _ordered(rule):
        return None
    return device_hits(readings.filter(_within(rule)), history, _asks(leaves[tree]), compat, "counts")


def _ordered(rule: Rule) -> bool:
    """A rule with a trigger, which needs readings that don't match too."""
    return rule.compiled.stateful and bool(rule.compiled.props and rule.compiled.props.trigger)


def policies(rules: list[Rule]) -> dict:
    return {r.rule_id: (r.compiled.props.trigger if r.compiled.props else None, r.compiled.reset_s) for r in rules if r.compiled.stateful}


def gated(rows: DataFrame, rules: list[Rule], compat: bool = False) -> DataFrame:
    """The rows that fire: matches of plain rules as they are, the others through their policies."""
    kept = policies(rules)
    # A rule without a trigger passes whatever its state is; only the others need the ordered fold.
    ordered = {k: v for k, v in kept.items() if v[0] is not None}
    if not ordered:
        return rows.filter("ok")
    held = F.col("rule_id").isin(list(ordered))
    return rows.filter(~held & F.col("ok")).unionByName(gate(rows.filter(held), ordered, compat))


def events(rows: DataFrame) -> DataFrame:
    """One row per reading and rule that fires: ``event_id, device, date_time, rule, match``."""
    device = F.struct(*[c for c in rows.columns if c not in ("event_id", "rule_id", "spec", "ok", "match", "now")])
    return rows.select("event_id", device.alias("device"), F.col("ts").alias("date_time"), F.struct("rule_id", "spec").alias("rule"), "match")

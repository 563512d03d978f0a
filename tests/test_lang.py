import pytest

from geowarden.lang.ast import Both
from geowarden.lang.check import Distance, NearDevices, NearObjects, Scalar, TypeErrorInRule, compile_rule
from geowarden.lang.parser import ParseError, RuleError, parse, seconds

A, B, C = "depot_north", "depot_south", "harbour7"
GOOD = [
    f"device nnear circle({C})",
    f"devices({A}, {B}, {C}) :radius 1km INTERSECTS objects(@) {{ :layer {B} }}",
    f'device INTERSECTS polygon("{C}") AND speed range [1 .. 40] {{ :center 42.9284788 72.2776118 }}',
    f"devices({B}) :radius 100m near devices(@) :radius 100m {{ :trigger every 10s }}",
    "status eq 1 OR 1 eq status { :radius 3km :center 42.4984338 -72.4265129 :trigger every 10s :expire 10h :reset after 24h }",
    f"device :radius 4km intersects polygon({A}) {{ :reset after 24h :trigger 25 times interval 10s }}",
    f"device :radius 4km intersects polygon({A}) :trigger once :reset after 24h",
    f"device near polygon({A}) :time duration 5m0s",
    f"circle({A}) :time duration 5s near device :radius 5km",
    f"devices({A}, {B}) :bbox 300m near devices({A}, {B}) :bbox 400m",
    "temperature range [2.2 .. 10.8]",
    "temperature gte 1 and temperature lt 40 and pressure gt 2 or humidity ne 0",
    'imei in ["one", "two"]',
    "week in [48, 49, 50] and week range [40 .. 52]",
    "time range [12:00 .. 23:00]",
    "time eq 19:21",
    'datetime in ["2012-11-01T22:08:41+00:00", "2012-11-02T22:08:41+00:00"]',
    "temperature gt -5",
    f"device :radius 300m intersects line({A}) and speed range [30 .. 120] or (temperature gte 0 and temperature lt 400)",
]
BAD = [
    "", "some text", "devices(,,,) intersects circle()", "circle intersects device", "circle(....) intersects device", f"device near polygon({A}) :time duration h3s",
    f"device near polygon({A}) :time before 5m0s", f"device near polygon({A}) :time after", "device :radius b0km", "speed range [0x0 .. b0]", "owner in []", "brand in [1 .. 2, 1, 3]",
    "model in [1 ... 2]", 'iemi in [1, 1.1, "one"]', 'owner in ["one", 1.1, 1]', "time gt 12: and time lt 15:00", "datetime gte 2012-11-01T22:08:41+00:00",
    "speed gt 1 { :trigger every hhh }", "speed gt 1 { :trigger every 300s somelit }", "speed gt 1 { :trigger 0x0 times }", "speed gt 1 { :trigger 4 somelit }", "speed gt 1 { :trigger 4 times interval h4 }",
    "speed gt 1 { :trigger sometimes }", "speed gt 1 speed", "(speed gt 1", "x" * 2049,
]


@pytest.mark.parametrize("text", GOOD)
def test_accepted(text):
    assert compile_rule(text).leaves


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    with pytest.raises(RuleError):
        parse(text)


@pytest.mark.parametrize("text", [
    "speed eq \"a\"", "model gt 1", "time eq 1", "speed range [2 .. 1]", "model range [\"a\" .. \"b\"]", "time in [12:00, 13:00]", "devices(@) near devices(@)", "devices(@) in polygon(@)",
    "device near device", "polygon(a) near polygon(b)", "device near 1", "device gt polygon(a)", "device :radius 1km gt polygon(@)", 'datetime range ["2012-11-01T22:08:41+00:00" .. "2012-11-01T22:08:41+00:00"]', "speed in [1 .. 2]",
])
def test_wrong_kinds(text):
    with pytest.raises(TypeErrorInRule):
        compile_rule(text)


def test_precedence_and_parentheses():
    tree = parse("speed gt 1 or speed gt 2 and speed gt 3 or speed gt 4").tree
    assert tree.op == "or" and tree.left.op == "or" and isinstance(tree.left.right, Both) and tree.left.right.op == "and"
    assert compile_rule("(speed gt 1 or speed gt 2) and speed gt 3").tree == ("and", ("or", 0, 1), 2)


def test_leaves():
    assert compile_rule("10 lt speed").leaves == (Scalar("gt", "speed", "int", (10,), 3),)
    assert compile_rule("10 lt speed", compat=True).leaves[0].op == "lt"
    leaf = compile_rule(f"polygon({A}) IN device :radius 2km").leaves[0]
    assert isinstance(leaf, NearObjects) and leaf.area.meters == 2000 and leaf.flipped and leaf.only is None
    assert isinstance(compile_rule(f"device :radius 1.5 km lt devices({A})").leaves[0], Distance)
    both = compile_rule(f"devices({A}) near devices({B})")
    assert both.tree == ("or", 0, 1) and all(isinstance(x, NearDevices) for x in both.leaves)
    assert compile_rule("status eq 1 {}").reset_s == 86400 and not compile_rule("status eq 1").stateful


def test_durations_and_errors():
    assert seconds("5m0s") == 300 and seconds("1.5h") == 5400 and seconds("250ms") == 0.25
    with pytest.raises(ParseError) as e:
        parse("speed gt 1 and foo")
    assert e.value.pos == 15 and e.value.token == "foo"

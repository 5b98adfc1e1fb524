"""Leaves of nested payloads and changes between versions, against plain JSON."""

import json
import random

from annalist.operators import payloads

SCHEMA = "id long, body string"


def plain(body, depth=32):
    """(path, value) of the leaves by loops; a leaf's value keeps its type."""
    try:
        top = json.loads(body) if body is not None else None
    except ValueError:
        return {}
    if isinstance(top, list):
        top = {str(i): v for i, v in enumerate(top)}
    if not isinstance(top, dict):
        return {}
    out = {}

    def walk(value, path, level):
        for k, v in value.items():
            at = f"{path}.{k}" if path is not None else k
            if isinstance(v, dict) and v and level < depth:
                walk(v, at, level + 1)
            else:
                out[at] = v

    walk(top, None, 0)
    return out


def leaf(kind, value):
    if kind == "string":
        return value
    return json.loads(value) if value is not None else None


def test_what_looks_like_a_map_is_kept(spark):
    bodies = ['{"a":"{not json","b":{"c":{"d":1}},"e":"{}"}', "[1, {\"x\": 2}, \"y\"]", "{}", "[]", "bad", None, "", "3", '"text"', '{"z":{},"l":[],"n":null,"t":true,"f":1.5,"s":"1","i":1,"u":{"":{"é":"ü"}}}', '{"same":1,"same":2}']
    got = {}
    for r in payloads.leaves(spark.createDataFrame(list(enumerate(bodies)), SCHEMA), ["id"], "body").collect():
        got.setdefault(r.id, {})[r.path] = (r.kind, r.value)
    assert got[0] == {"a": ("string", "{not json"), "b.c.d": ("bigint", "1"), "e": ("string", "{}")}
    assert set(got) == {0, 1, 9}
    for i in got:
        assert {p: leaf(*v) for p, v in got[i].items()} == plain(bodies[i])
    assert got[9]["s"] != got[9]["i"] and got[9]["z"] == ("object", "{}") and got[9]["n"] == ("void", None)


def nested(rng, level):
    if level == 0 or rng.random() < 0.3:
        return rng.choice([1, "1", "{}", '{"a":1}', True, None, 2.5, [], {}, [{"b": 1, "a": {}}], "x.y"])
    return {rng.choice("abcdef"): nested(rng, level - 1) for _ in range(rng.randrange(4))}


def test_random_nesting_and_depth(spark):
    rng = random.Random(4)
    bodies = [json.dumps(nested(rng, rng.randrange(1, 7))) for _ in range(150)]
    deep = "1"
    for _ in range(40):
        deep = f'{{"k":{deep}}}'
    bodies.append(deep)
    df = spark.createDataFrame([(i, b, 0, "p") for i, b in enumerate(bodies)], SCHEMA + ", pos int, path2 string").withColumnRenamed("id", "key")
    got = {}
    for r in payloads.leaves(df, ["key"], "body").collect():
        got.setdefault(r.key, {})[r.path] = leaf(r.kind, r.value)
    assert got == {i: p for i, b in enumerate(bodies) if (p := plain(b))}
    assert payloads.leaves(df.limit(0), ["key"], "body").collect() == []


def test_config_changes(spark):
    versions = ['{"a":1,"m":{"x":"1","y":[2,{"q":1,"p":2}]}}', '{"m":{"y":[2,{"p":2,"q":1}],"x":"1"},"a":1}', '{"a":"1","m":{"x":null}}', "broken", '{"a":null}']
    df = spark.createDataFrame([("o", i, v) for i, v in enumerate(versions)] + [("other", 0, "{}")], "name string, at int, body string")
    got = sorted((r.version, r.path, r.change, r.kind, r.before, r.value) for r in payloads.config_changes(df, ["name"], ["at"], "body").collect())
    wanted = [(1, "a", "set", "bigint", None, "1"), (1, "m.x", "set", "string", None, "1"), (1, "m.y", "set", "array", None, '[2,{"p":2,"q":1}]'),
              (3, "a", "changed", "string", "1", "1"), (3, "m.x", "changed", "void", "1", None), (3, "m.y", "removed", "array", '[2,{"p":2,"q":1}]', None),
              (4, "a", "removed", "string", "1", None), (4, "m.x", "removed", "void", None, None), (5, "a", "set", "void", None, None)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)

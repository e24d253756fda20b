"""Nested records against a recursive brute-force walk, and its edge cases."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.operators import nested
from chatloom.plans.queries import queries


def brute(value, path="$", parent=None):
    if isinstance(value, dict):
        if "_" in value:
            yield path, parent
            parent = path
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}", parent)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}[{i}]", parent)


leaf = st.none() | st.booleans() | st.integers() | st.text(max_size=3) | st.floats(allow_nan=False, allow_infinity=False)
tree = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["_", "a", "b", "é", "x y"]), x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(tree)
def test_labels_equal_a_recursive_walk(value):
    text = json.dumps(value)
    assert nested.parse_deep(text) == json.loads(text)
    got = [(n[0], n[1]) for n in nested.label_nodes(nested.parse(text))]
    assert sorted(got, key=str) == sorted(brute(json.loads(text)), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]",:01e-. tfn\\u', max_size=12))
def test_parsers_refuse_the_same_text(text):
    def outcome(parse):
        try:
            return repr(parse(text))
        except ValueError:
            return "error"

    assert outcome(nested.parse_deep) == outcome(nested._DECODER.decode)


def test_any_depth(spark):
    deep = '{"_": "M", "x": ' * 3000 + '{"_": "end"}' + "}" * 3000
    rows = spark.createDataFrame([(1, deep)], "raw_id long, payload string")
    nodes = nested.flatten(rows, "raw_id", "payload")
    assert nodes.count() == 3001


def test_edges(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "{", "x"), (4, "NaN", "x"), (5, "[null, {\"_\": null}, [{\"_\": 3}]]", "x"),
        (6, '{"_": "A", "b": {"c": {"_": "C", "v": [1, {"w": "z"}]}}}', "x"), (6, '{"_": "A"}', "x"),
    ]
    frame = spark.createDataFrame(rows, "raw_id long, payload string, node_path string")
    nodes = nested.flatten(frame, "raw_id", "payload")
    links = sorted((tuple(r) for r in nested.child_links(nodes, "raw_id").collect()), key=str)
    assert links == [(5, "$[1]", None), (5, "$[2][0]", None), (6, "$.b.c", "$")]
    tables = nested.flat_tables(nodes, "raw_id")
    assert set(tables) == {"A", "C", "C.v[]"} and tables["C"].columns == ["raw_id", "node_path", "parent_path", "schema_path"]
    elements = sorted((r.asDict() for r in tables["C.v[]"].collect()), key=lambda r: r["element_path"])
    link = {"raw_id": 6, "parent_path": "$.b.c"}
    assert elements == [link | {"element_path": "$.b.c.v[0]", "value": "1", "w": None}, link | {"element_path": "$.b.c.v[1]", "value": None, "w": "z"}]
    assert nested.flatten(frame.limit(0), "raw_id", "payload").count() == 0


def test_clashing_field_names(spark):
    frame = spark.createDataFrame([(1, '{"_": "A", "Raw_ID": 1, "node_path": "p", "a": 1, "A": 2}')], "raw_id long, payload string")
    table = nested.flat_tables(nested.flatten(frame, "raw_id", "payload"), "raw_id")["A"]
    row = table.first().asDict()
    assert row["field_Raw_ID"] == "1" and row["field_node_path"] == "p" and {row["A"], row["field_a"]} == {"1", "2"}


def test_null_and_large_keys(spark):
    frame = spark.createDataFrame([(2**60 + 1, '{"_": 1}'), (None, '{"_": 1}')], "raw_id long, payload string")
    assert {r.raw_id for r in nested.flatten(frame, "raw_id", "payload").collect()} == {2**60 + 1, None}


def test_every_kind_gets_its_table(spark, tmp_path):
    rows = [(1, '{"_": "A", "n": 1, "u": {"_": "User", "id": 7, "x y": [true, null]}}'), (2, '{"_": "A", "m": "t", "e": [{"_": "E/1"}, {"_": "User"}]}')]
    spark.createDataFrame(rows, "raw_id long, payload string").write.parquet(str(tmp_path / "raw_messages.parquet"))
    listed = queries()["p4_tables"](spark, str(tmp_path)).collect()
    assert {(r.kind, r.n_rows, r.n_fields) for r in listed} == {("A", 2, 2), ("E/1", 1, 0), ("User", 2, 1), ("User.x y[]", 2, 1)}
    tables = {r.kind: [x.asDict() for x in spark.read.parquet(r.path).orderBy("raw_id").collect()] for r in listed}
    assert sorted(r["value"] or "" for r in tables["User.x y[]"]) == ["", "true"]
    links = {"raw_id": 1, "node_path": "$.u", "parent_path": "$", "schema_path": "$.u"}
    assert tables["User"][0] == links | {"id": "7"}
    assert [(r["n"], r["m"]) for r in tables["A"]] == [("1", None), (None, "t")]
    assert tables["E/1"][0]["parent_path"] == "$"


def test_columns_do_not_grow_with_arrays(spark):
    payload = '{"_": "A", "xs": [' + ", ".join(map(str, range(500))) + '], "m": [[1, 2], [{"k": 3, "l": [4]}]]}'
    tables = nested.flat_tables(nested.flatten(spark.createDataFrame([(1, payload)], "raw_id long, payload string"), "raw_id", "payload"), "raw_id")
    assert set(tables) == {"A", "A.xs[]", "A.m[][]", "A.m[][].l[]"} and len(tables["A"].columns) == 4
    assert tables["A.xs[]"].count() == 500
    assert {(r.element_path, r.value, r.k) for r in tables["A.m[][]"].collect()} == {("$.m[0][0]", "1", None), ("$.m[0][1]", "2", None), ("$.m[1][0]", None, "3")}
    assert [(r.parent_path, r.element_path, r.value) for r in tables["A.m[][].l[]"].collect()] == [("$", "$.m[1][0].l[0]", "4")]

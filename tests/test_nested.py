import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tabweave.operators import nested

SCHEMA = "id long, content string, tuple_pos int, variant string"


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, c, 7, "x") for i, c in rows], SCHEMA)
    return nested.nodes(df, **k)


def test_positions_and_variants(spark):
    o = {"schema": {"columnNames": ["a"]}, "tuples": [None, {"cells": [{"value": "x"}, None, {"value": 3, "alternatives": [{"value": "y"}, None, {}, {"value": None}]}, {"alternatives": [{"value": True}]}, {"value": {"z": 1}}]}, {}]}
    got = {(r["tuple_pos"], r["cell_pos"], r["alt_pos"], r["variant"]) for r in run(spark, [(1, json.dumps(o))], structure=False).collect()}
    assert got == {(1, 0, -1, "text"), (1, 2, -1, "number_alternatives"), (1, 2, 0, "text"), (1, 3, 0, "flag"), (1, 4, -1, "nested")}
    tables = nested.variant_tables(run(spark, [(1, json.dumps(o))]))
    assert tables["tables"].collect()[0]["n_tuples"] == 3
    assert {(r["tuple_pos"], r["variant"]) for r in tables["tuples"].collect()} == {(0, "null"), (1, "plain"), (2, "without_cells")}
    assert [r["value"] for r in tables["cell_number"].collect()] == [3.0]
    assert tables["cell_empty"].count() == 2


def test_unreadable_contents_yield_nothing(spark):
    good = '{"tuples":[{"cells":[{"value":"x"}]}]}'
    rows = [(1, None), (2, ""), (3, good[:-3]), (4, good + " x"), (5, "[1]"), (6, "7"), (7, '{"tuples": NaN}'), (8, "[" * 100_000), (9, good + good)]
    assert run(spark, rows).count() == 0
    twice = [(1, good), (1, good), (2, json.dumps(good)), (3, '{"tuples":5}'), (4, '{"tuples":[{"cells":"no"},4,{"cells":[5]}]}')]
    values = run(spark, twice, structure=False).collect()
    assert sorted(r["id"] for r in values) == [1, 2]


def test_odd_values(spark):
    rows = [(1, '{"tuples":[{"cells":[{"value":"\\ud800"},{"value":' + "9" * 5000 + "}]}]}"), (2, json.dumps({"tuples": [{"cells": [{"value": "v" * 2_000_000}]}]}))]
    got = {(r["id"], r["cell_pos"]): r for r in run(spark, rows, structure=False).collect()}
    assert len(got) == 3 and len(got[2, 0]["text_value"]) == 2_000_000 and got[1, 0]["text_value"]
    assert run(spark, []).count() == 0


def test_numbers_stay_exact(spark):
    rows = [(1, '{"tuples":[{"cells":[{"value":9007199254740993},{"value":1.10},{"value":{"n":12345678901234567890}}]}]}')]
    t = nested.route(run(spark, rows))
    assert sorted((r["cell_pos"], r["number_text"], r["value"]) for r in t["cell_number"].collect()) == [(0, "9007199254740993", 9007199254740992.0), (1, "1.10", 1.1)]
    assert [r["value"] for r in t["cell_nested"].collect()] == ['{"n": 12345678901234567890}']


def test_another_nesting(spark):
    roles = (
        nested.Role("order", marker="schema"),
        nested.Role("line", "lines", "order", "line_pos", "sku", "unit"),
        nested.Role("note", "notes", "order", "note_pos", "text"),
        nested.Role("discount", "discounts", "line", "discount_pos", "rate"),
    )
    o = {"lines": [{"sku": "a", "unit": "kg", "discounts": [{"rate": 0.5}, None, {"rate": "half"}]}, {"sku": 7}], "notes": [{"text": "n"}, {"text": True}]}
    df = spark.createDataFrame([(1, json.dumps(o)), (2, json.dumps({"notes": 3}))], "id long, content string")
    all_nodes = nested.nodes(df, roles=roles)
    for t in (nested.route(all_nodes, roles=roles), nested.variant_tables(all_nodes, roles)):
        assert [tuple(r) for r in t["line_text"].collect()] == [(1, 0, "text_discounts", "a", "kg")]
        assert [(r["id"], r["line_pos"], r["discount_pos"], r["value"]) for r in t["discount_number"].collect()] == [(1, 0, 0, 0.5)]
        assert [(r["line_pos"], r["discount_pos"], r["variant"]) for r in t["discount_empty"].collect()] == [(0, 1, "null")]
        assert [(r["note_pos"], r["value"]) for r in t["note_flag"].collect()] == [(1, True)]
        assert sorted((r["id"], r["variant"]) for r in t["orders"].collect()) == [(1, "plain"), (2, "without_lines")]
        keys = {tuple(r) for r in nested.value_positions(t, roles).collect()}
        assert keys == {(1, 0, -1, -1), (1, 1, -1, -1), (1, -1, 0, -1), (1, -1, 1, -1), (1, 0, -1, 0), (1, 0, -1, 2)}


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["value", "alternatives", "cells", "tuples", "x"]), c, max_size=3), max_leaves=20))
def test_any_json_is_shredded_without_error(o):
    out = nested.Shredder(nested.WEB_TABLE)
    out.document(1, nested.read_object(json.dumps({"tuples": o})), True, True)
    assert out.batch().num_rows >= 1

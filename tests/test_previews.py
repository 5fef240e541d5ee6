"""Previews of broadcasts: what a placeholder becomes, and that the maps of a row are made once."""

from pyspark.sql import functions as F

from murmur.operators.templates import broadcast_preview
from murmur.plans.all import QUERIES

ROW = "id int, body string, variables map<string,struct<type:string,value:string>>, contact map<string,string>, fields map<string,string>"


def _replaced(body, variables, contact, fields):
    import re

    if body is None:
        return None
    for mark in sorted(set(re.findall(r"\{\{\d+\}\}", body))):
        kind, name = (variables or {}).get(mark[2:-2]) or (None, None)
        name = name or None
        found = {"static": name, "field": (contact or {}).get(name), "custom_field": (fields or {}).get(name) or None}.get(kind)
        text = mark if found is None else found
        body = body.replace(mark, re.sub(r"\$[$&]", lambda m: "$" if m[0] == "$$" else mark, text))
    return body


def test_previews_equal_a_plain_loop(spark):
    body = "Hi {{1}}, {{2}} owes {{10}} or {{3}}, {{1}}"
    maps = [
        {"1": ("field", "name"), "2": ("static", "x{{3}}"), "10": ("static", "$$5 $& {{2}} $"), "3": ("custom_field", "none")},
        {"1": ("field", "shoe"), "2": ("custom_field", "segment"), "10": ("static", ""), "3": ("static", "$$$&$&&")},
        {"1": ("field", ""), "2": ("custom_field", "blank"), "10": None, "3": ("other", "x")},
        {"1": ("static", "{{1}}{{10}}"), "2": (None, "x"), "3": ("field", None)}, {}, None,
    ]
    rows = [(b, v, c, f) for b in (body, "none", "", "{{2}}{{1}} {{ 1 }} $&", None) for v in maps for c in ({"name": "N$&", "shoe": ""}, {"name": None}, None) for f in ({"segment": "S", "blank": ""}, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROW)
    got = df.select("id", broadcast_preview(F.col("body"), F.col("variables"), F.col("contact"), F.col("fields")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: _replaced(*r) for i, r in enumerate(rows)} and len(got) == len(rows)


def test_maps_of_a_row_are_made_once(spark, sf):
    plan = QUERIES["broadcast_previews"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1

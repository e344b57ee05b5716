"""JSON records of mixed shape: flattened through variants, held against DuckDB's json_extract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from basketry.sources import json_variant as V

RECORDS = [
    {"id": 1, "customer": {"name": "Ann", "type": "A"}, "items": [{"p": "x", "qty": 2}, {"p": "y", "qty": "3"}]},
    {"id": "two", "customer": "Bob", "items": {"p": "z", "qty": 1.5}},
    {"id": 3, "customer": None, "items": []},
    {"id": 4, "items": None},
    {"id": 5},
    {"id": 6, "customer": {"name": ["n", 1]}, "items": [7, None, "s", {"p": {"deep": True}}, {}]},
    [1, 2], "text", None, {},
]


@pytest.fixture
def records(spark):
    texts = [(json.dumps(r),) for r in RECORDS] + [("{broken",), ("",), (None,)]
    return spark.createDataFrame(texts, "value string").select("value", F.try_parse_json("value").alias("record"))


def test_items_against_duckdb(records):
    got = V.variant_flatten(records, record_path="items", meta=["id", ["customer", "name"]],
                            fields={"p": "string", "qty": "double", "0": "string"})
    assert got.columns == ["p", "qty", "0", "id", "customer.name"]
    con = duckdb.connect()
    con.register("t", records.select("value").toPandas())
    want = con.execute("""
        WITH j AS (SELECT CAST(value AS JSON) AS j FROM t WHERE json_valid(value)),
        e AS (SELECT j, unnest(CASE json_type(j, '$.items') WHEN 'ARRAY' THEN json_extract(j, '$.items[*]')
                               WHEN 'NULL' THEN [] ELSE [json_extract(j, '$.items')] END) AS e
              FROM j WHERE json_type(j, '$.items') IS NOT NULL)
        SELECT CASE WHEN json_type(e, '$.p') <> 'OBJECT' THEN e ->> '$.p' END, TRY_CAST(e ->> '$.qty' AS DOUBLE),
               CASE WHEN json_type(e) NOT IN ('OBJECT', 'NULL') THEN e ->> '$' END,
               j ->> '$.id', j ->> '$.customer.name' FROM e""").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len(want) == 8


def test_discovered_columns(records):
    got = V.variant_flatten(records)
    types = dict(got.dtypes)
    # id is a number or text, customer an object or text, items of any shape
    assert types == {"customer": "string", "customer.name": "string", "customer.type": "string",
                     "id": "string", "items": "string", "items.p": "string", "items.qty": "decimal(2,1)",
                     "0": "string"}
    by_id = {r["id"]: r for r in got.collect() if r["id"]}
    assert by_id["1"]["customer"] is None and by_id["1"]["customer.name"] == "Ann"
    assert by_id["two"]["customer"] == "Bob" and by_id["two"]["customer.name"] is None
    assert float(by_id["two"]["items.qty"]) == 1.5 and by_id["two"]["items"] is None
    assert json.loads(by_id["6"]["customer.name"]) == ["n", 1]
    assert got.count() == len(RECORDS)


def test_types_shared_by_all_values(spark):
    df = spark.createDataFrame([('{"a":1,"b":true,"c":{"d":"x"}}',), ('{"a":22,"c":{"d":null}}',)], "value string") \
        .select(F.try_parse_json("value").alias("record"))
    got = V.variant_flatten(df)
    assert dict(got.dtypes) == {"a": "bigint", "b": "boolean", "c.d": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == [(1, True, "x"), (22, None, None)]


def test_empty_and_odd_names(spark):
    none = spark.createDataFrame([], "value string").select(F.try_parse_json("value").alias("record"))
    assert V.variant_flatten(none, record_path="items", meta=["id"]).collect() == []
    df = spark.createDataFrame([('{"a b":1,"it\'s":2,"q\\"q":3}',)], "value string") \
        .select(F.try_parse_json("value").alias("record"))
    assert V.variant_flatten(df).first().asDict() == {"a b": 1, "it's": 2, 'q"q': 3}


def test_lines_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"items":[{"p":1}]}\nnot json\n\n{"id":"x","items":{"p":"2"}}\n')
    got = V.variant_flatten(V.read_variant_lines(spark, str(tmp_path)), record_path="items", meta=["id"])
    assert sorted(map(tuple, got.collect())) == [("1", "1"), ("2", "x")]

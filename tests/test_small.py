"""Functions by name, episodes and active domains."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.registry import TEXT, Registry
from tessera.operators import filters, memory


def test_registry(spark):
    own = Registry()

    @own.register("twice", "A number twice", x="number", plus="integer?")
    def twice(x, plus=None):
        return x * 2 if plus is None else x * 2 + plus

    rows = own.applied(spark.range(3), a=("twice", {"x": "id"}), b=("twice", {"x": F.col("id") + 1, "plus": 5}))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(0, 0, 7), (1, 2, 9), (2, 4, 11)]
    spec = json.loads(own.schema(spark).first().parameters)
    assert spec == {"type": "object", "properties": {"x": {"type": "number"}, "plus": {"type": "integer"}}, "required": ["x"]}
    for wrong in ({}, {"x": "id", "y": 1}):
        with pytest.raises(ValueError):
            own.call("twice", **wrong)
    with pytest.raises(KeyError):
        own.call("thrice")
    with pytest.raises(ValueError):
        own.register("twice", "again", x="number")(twice)
    with pytest.raises(ValueError):
        own.register("odd", "", x="colour")
    assert own.unregister("twice") and not own.unregister("twice") and own.names() == []
    assert {"beginning", "token_estimate", "word_count"} <= set(TEXT.names())


def test_episodes(spark, tmp_path):
    path = f"file://{tmp_path}/episodes"
    rows = spark.createDataFrame([(1, "long enough"), (2, "a"), (2, "long enough"), (3, None), (4, "x" * 20), (4, "x" * 20)], "id long, content string")
    first = {(r.id, r.written, r.reason) for r in memory.add_episodes(path, rows, F.length("content") > 5).collect()}
    assert first == {(1, True, None), (2, True, None), (2, False, "rejected"), (3, False, "rejected"), (4, True, None), (4, False, "repeated")}
    again = {(r.id, r.written, r.reason) for r in memory.add_episodes(path, rows.filter("id IN (1, 3)")).collect()}
    assert again == {(1, False, "known"), (3, True, None)}
    ids = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(ids) == [1, 2, 3, 4]


def test_active_domains(spark):
    asked = spark.createDataFrame([("all",), ("some",), ("none",), ("unknown",), ("some",)], "profile string")
    profiles = spark.createDataFrame([("all", ["ALL"]), ("some", ["b", "z"]), ("none", []), ("other", ["a"])], "profile string, domains array<string>")
    got = sorted(map(tuple, filters.active_domains(asked, profiles, spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "domain string")).collect()))
    assert got == [("all", "a"), ("all", "b"), ("some", "b"), ("some", "z"), ("unknown", "a"), ("unknown", "b")]

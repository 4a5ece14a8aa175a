"""One-hot slots from a vocabulary table against plain dictionaries."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.text import MISSING
from tidewatch.operators import training, vocabulary

COLUMNS = ["a", "b"]


def plain(train, rows):
    slots = {}
    for i in range(2):
        for v in sorted({MISSING if r[i + 1] is None else str(r[i + 1]) for r in train}):
            slots[(i, v)] = len(slots)
    keys = [(r[0], [(i, MISSING if r[i + 1] is None else str(r[i + 1])) for i in range(2)]) for r in rows]
    return {k: [slots[x] for x in found if x in slots] for k, found in keys}


@pytest.mark.parametrize("limit", [100_000, 3])
def test_slots_of_hot_null_and_unknown_values(spark, monkeypatch, limit):
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(vocabulary, "HOT_SHARE", 10)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 5 == 0 else f"v{i % 41}", i % 97 if i % 4 else 7) for i in range(600)]
    rows += [(1000, "", None), (1001, "new", 12345), (1002, "hot", 7), (1002, "hot", 7)]
    df = spark.createDataFrame(rows, "id int, a string, b int").repartition(5)
    train = df.where("id < 300")
    known = vocabulary.vocabulary(train, COLUMNS)
    assert [r["slot"] for r in known.orderBy("slot").collect()] == list(range(known.count()))
    got = vocabulary.one_hot(df, COLUMNS, known)
    assert got.columns == ["id", "a", "b", "slots"] and got.count() == len(rows)
    assert {r["id"]: r["slots"] for r in got.collect()} == plain([r for r in rows if r[0] < 300], rows)


def test_hot_values_do_not_meet_in_one_key(spark, monkeypatch):
    """Beyond the broadcast limit a value of a third of the rows is not joined by value."""
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", 3)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("a"))
    got = vocabulary.one_hot(df, ["a"], vocabulary.vocabulary(df, ["a"]))
    plan = got._jdf.queryExecution().toString()
    assert "__lane" in plan and got.groupBy(F.size("slots").alias("s")).count().collect() == [(1, 3000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b int")
    one = spark.createDataFrame([("x", 1)], "a string, b int")
    assert vocabulary.one_hot(none, COLUMNS, vocabulary.vocabulary(one, COLUMNS)).count() == 0
    assert vocabulary.one_hot(one, COLUMNS, vocabulary.vocabulary(none, COLUMNS)).first()["slots"] == []


def test_indexer_refuses_a_long_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(training, "MOST_CATEGORIES", 5)
    with pytest.raises(ValueError, match="a has more than 5 values"):
        training.fit_encoder(spark.range(20).select(F.col("id").cast("string").alias("a")), training.FeatureSpec((), ("a",)))

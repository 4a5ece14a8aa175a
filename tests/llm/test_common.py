"""Helpers that the text operators share."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import common


def _told(df, monkeypatch):
    """Sizes of the results that frames of this kind hand to the driver from now on."""
    sizes = []
    for name in ("collect", "toPandas"):
        plain = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, plain=plain: (out := plain(self), sizes.append(len(out)))[0])
    return sizes


def test_marks_reach_the_driver_as_blocks_of_bits(spark, monkeypatch):
    keys = spark.range(200_000).select(F.col("id").alias("k")).unionByName(spark.sql("SELECT cast(null AS bigint) AS k"))
    want = np.zeros(common.MARKS, bool)
    want[[r["m"] for r in keys.where("k IS NOT NULL").select(common.mark("k").alias("m")).collect()]] = True
    sizes = _told(keys, monkeypatch)
    marks = common.marks_of(keys, "k")
    assert np.array_equal(marks, np.packbits(want, bitorder="little")) and want.sum() > 190_000
    assert sum(sizes) <= common.MARKS // common.MARKS_IN_BLOCK


def test_marks_of_few_keys_and_of_none(spark):
    few = spark.createDataFrame([(7,), (7,), (-3,), (None,)], "k bigint")
    marks = common.marks_of(few, "k")
    assert marks.nbytes == common.MARKS // 8 and np.bitwise_count(marks).sum() == 2
    assert sorted(r["k"] for r in common.marked(few, "k", marks).collect()) == [-3, 7, 7]
    assert [r["k"] for r in common.marked(few, "k", marks, hit=False).collect()] == [None]
    assert not common.marks_of(few.where("k IS NULL"), "k").any()

"""Look-ups of few keys: nothing wanted is lost, little else passes, and the large side is not shuffled."""

import pytest
from pyspark.sql import functions as F

from copysift.operators import lookup
from copysift.operators.lookup import perhaps_present
from copysift.sources.store import Store


@pytest.mark.parametrize("keys", [0, 1, 1000])
def test_all_that_is_wanted_passes_and_little_else(spark, keys):
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id", F.lit("x").alias("bitmap"), F.lit(1).alias("bucket"))
    wanted = rows.where(F.col("id") % 200 == 7).limit(keys).select("k")
    wanted = wanted.unionByName(wanted).unionByName(spark.createDataFrame([(None,), ("nowhere",)], "k string"))
    got = perhaps_present(rows, wanted, "k")
    assert got.columns == rows.columns
    there = rows.join(wanted, "k", "left_semi")
    assert got.join(wanted, "k", "left_semi").count() == there.count() == keys
    assert got.count() <= keys + 200_000 / 32


def test_a_full_filter_still_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_BITS", lookup.ROW_BITS)
    rows = spark.range(100_000).withColumn("k", F.col("id") * 3)
    wanted = rows.where("id % 2 = 0").select("k")
    assert lookup.key_bits(wanted, "k", lookup.ROW_BITS).count() == 1
    assert perhaps_present(rows, wanted, "k").join(wanted, "k", "left_semi").count() == 50_000


def _vectors(spark, first, last, value):
    return spark.range(first, last).select(F.format_string("h%d", F.col("id")).alias("norm_hash"), F.array(F.lit(value), F.lit(0.0)).alias("vector"))


def test_look_ups_equal_those_in_all_vectors(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "index"), "m"), Store(spark, str(tmp_path / "index"), "n")
    ask = _vectors(spark, 990, 1010, 0.0).drop("vector").unionByName(_vectors(spark, 995, 1000, 0.0).drop("vector"))
    assert store.vectors_of(ask).count() == 0 and store.missing(ask).count() == 20
    store.put_vectors(_vectors(spark, 0, 1000, 1.0))
    store.put_vectors(_vectors(spark, 500, 1005, 2.0))
    other.put_vectors(_vectors(spark, 1000, 2000, 3.0))
    plain = sorted((r["norm_hash"], r["vector"]) for r in store.vectors().join(ask, "norm_hash", "left_semi").collect())
    assert sorted((r["norm_hash"], r["vector"]) for r in store.vectors_of(ask).collect()) == plain == [(f"h{i}", [2.0, 0.0]) for i in sorted(range(990, 1005), key=lambda i: f"h{i}")]
    assert {r["norm_hash"] for r in store.missing(ask).collect()} == {f"h{i}" for i in range(1005, 1010)}
    store.drop_vectors()
    assert store.vectors_of(ask).count() == 0 and store.missing(ask).count() == 20 and other.missing(ask).count() == 10
    store.put_vectors(_vectors(spark, 990, 992, 4.0))
    assert {r["norm_hash"] for r in store.vectors_of(ask).collect()} == {"h990", "h991"} and store.missing(ask).count() == 18


def test_the_large_side_is_filtered_before_it_is_shuffled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), "m")
    store.put_vectors(_vectors(spark, 0, 1000, 1.0))
    ask = _vectors(spark, 0, 3, 0.0).drop("vector")
    plan = store.vectors_of(ask)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("parquet")
    above = [line for line in plan[:scan].splitlines() if "BroadcastHashJoin" in line or "Exchange hash" in line]
    assert "bucket" in above[-1] or "floor" in above[-1].lower(), above  # the filter is the join next to the scan
    assert "Exchange hash" in "".join(above[:-1])
    missing = store.missing(ask)._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in missing[missing.index("ReadSchema") :].split("\n")[0]

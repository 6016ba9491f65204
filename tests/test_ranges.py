"""Range joins and lookups with hot keys against plain ones."""

import random

from pyspark.sql import functions as F

from almanaq.operators.panel import lookup_join
from almanaq.operators.ranges import hot_keys, range_join, skewed_lookup_join


def test_range_join_against_all_pairs(spark):
    rng = random.Random(1)
    facts = [(i, rng.choice([None, *range(-50, 50)])) for i in range(200)] + [(900, 10 ** 12)]
    ranges = [(j, lo, lo + rng.choice([-1, 0, 1, 2, 7, 8, 9, 64])) for j, lo in enumerate(rng.choices(range(-60, 60), k=80))]
    ranges += [(100, None, 5), (101, -10 ** 12, 10 ** 12), (102, 3, 3), (102, 3, 3)]
    got = range_join(spark.createDataFrame(facts, "i int, v long"), spark.createDataFrame(ranges, "j int, lo long, hi long"), "v", "lo", "hi")
    want = sorted((i, j) for i, v in facts for j, lo, hi in ranges if v is not None and lo is not None and lo <= v <= hi)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want and got.columns == ["i", "v", "j", "lo", "hi"]
    none = range_join(spark.createDataFrame(facts, "i int, v long"), spark.createDataFrame([], "j int, lo long, hi long"), "v", "lo", "hi")
    assert none.collect() == []


def test_many_ranges_are_no_nested_loop(spark):
    ranges = spark.range(100_000).select(F.col("id").alias("j"), (F.col("id") % 5000).alias("lo"), (F.col("id") % 5000 + F.col("id") % 13).alias("hi"))
    facts = spark.range(5000).select(F.col("id").alias("v"))
    joined = range_join(facts, ranges, "v", "lo", "hi")
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == ranges.select(F.sum(F.least(F.col("hi"), F.lit(4999)) - F.col("lo") + 1)).first()[0]


def test_facts_of_one_day_meet_ranges_once(spark, tmp_path, monkeypatch):
    """4,000 shipments on two days and 300 ranges: pairs are counted by days, not by shipments."""
    from workload import queries

    day = lambda d: F.date_add(F.lit("1995-01-01").cast("date"), d).cast("timestamp")
    spark.range(300).select(F.col("id").alias("o_orderkey"), day(F.lit(1)).alias("o_orderdate"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4000).select(day((F.col("id") % 2).cast("int") + 1).alias("l_shipdate"), F.when(F.col("id") != 5, (F.col("id") % 9).cast("double")).alias("l_quantity")).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    pairs = []
    monkeypatch.setattr(queries, "range_join", lambda *a: pairs.append(range_join(*a)) or pairs[-1])
    got = {r["o_orderkey"]: (r["shipments"], r["rfh"]) for r in queries.QUERIES["range_profile"](spark, str(tmp_path)).collect()}
    q = [[float(i % 9) for i in range(start, 4000, 2) if i != 5] for start in (0, 1)]
    assert got == {k: (2000, sum(q[0])) if k % 10 == 0 else (4000, sum(q[0]) + sum(q[1])) for k in range(300)}
    assert pairs[0].count() == 300 * 2 - 30


def test_skewed_lookup_is_the_plain_lookup(spark):
    rng = random.Random(2)
    facts = spark.createDataFrame([(i, rng.choice([None, None, "hot", "hot", "hot", *map(str, range(40))])) for i in range(2000)], "i int, k string")
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), *((str(j), j) for j in range(0, 40, 2))], "name string, tag int")
    assert {r["_hot"] for r in hot_keys(facts, "k", 1 / 30).collect()} == {None, "hot"}
    for how in ("left", "inner"):
        plain, dealt = (sorted(map(tuple, x.collect()), key=str) for x in (
            lookup_join(facts, dim, "k", "name", how=how), skewed_lookup_join(facts, dim, "k", "name", how, salts=7, share=1 / 30)))
        assert plain == dealt


def test_hot_keys_are_dealt_evenly(spark):
    """Without dealing, three quarters of the rows would meet in one task."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        facts = spark.range(40_000).select("id", F.when(F.col("id") % 4 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
        dim = spark.range(0, 40_000, 1).select(F.col("id").alias("name"), (F.col("id") * 2).alias("tag"))
        joined = skewed_lookup_join(facts, dim, "k", "name")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and len(sizes) == 16 and sizes[-1] < 3 * sizes[8]

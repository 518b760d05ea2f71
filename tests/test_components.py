"""Connected components: hubs, chains, and rounds that write what they join."""

import random

import pytest

from sparkweave.operators import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_hub_and_chain(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(few)
    edges = [(500, 1000 + i) for i in range(400)] + [(3000 + i, 3001 + i) for i in range(60)]
    edges += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    found = components.star_components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()
    assert {r["id"]: r["label"] for r in found} == brute(edges) and len(found) == len(brute(edges))


def test_hub_is_split(spark, monkeypatch):
    """With nothing copied, the tasks that join a hub's links back each have a share of it."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(components, "FEW", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        links = components.materialize(spark.range(0, 200_000, 1, 8).select((F.col("id") + 1).alias("hi"), F.lit(0).cast("long").alias("lo")), "links")
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = components.materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = components.materialize(both.join(least, "u").withColumn("p", F.spark_partition_id()), "larger")
        sizes = [r["n"] for r in joined.where("u = 0").groupBy("p").agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 0.5 * 200_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

import random

from pyspark.sql import functions as F

from tessera.llm.jump_shards import assign_shards, assign_slots


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_walk(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(400)] + list(range(50))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 90):
        for r in assign_shards(df, "k", n, grown="more").collect():
            assert (r.shard, r.more) == (jump(r.k, n), jump(r.k, n + 1))
            assert r.more in (r.shard, n)


def test_nulls_strings_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (0, "b"), (None, "c")], "k bigint, s string")
    got = assign_shards(df, "k", 16).collect()
    assert len({r.shard for r in got}) == 1
    named = assign_shards(df, "s", 16).collect()
    assert all(0 <= r.shard < 16 for r in named)
    assert assign_slots(assign_shards(df.limit(0), "k", 4), "shard", ["k"]).count() == 0


def test_slots_are_gapless_even_for_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(5)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("slot_"))
    got = assign_slots(assign_shards(df, "k", 4), "shard", ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append((r.slot, r.k))
    assert sum(map(len, by.values())) == 3000
    for rows in by.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows)))
        assert [k for _, k in rows] == sorted(k for _, k in rows)

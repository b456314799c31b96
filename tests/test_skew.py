from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabweave.operators import skew


def cells(spark):
    rows = [(i % 40 if i % 3 else 1, i % 5, i, "hot" if i % 3 == 0 else f"v{i % 97}") for i in range(6000)] + [(2, 0, 1, None), (3, 0, 1, "")]
    return rows, spark.createDataFrame(rows, "tableid long, colid int, rowid int, tokenized string")


def test_key_stats_equal_brute_force(spark):
    rows, df = cells(spark)
    for key, at in (("tokenized", 3), ("tableid", 0)):
        n, cols, tabs = Counter(), defaultdict(set), defaultdict(set)
        for r in rows:
            if r[at] is not None:
                n[r[at]] += 1
                cols[r[at]].add(r[:2])
                tabs[r[at]].add(r[0])
        stats, plan = skew.key_stats(df, key, 8)
        assert plan.heavy, "the hot key is split"
        assert {(r[0], *r[1:]) for r in stats.collect()} == {(k, n[k], len(cols[k]), len(tabs[k])) for k in n}


def test_hot_key_is_spread_over_tasks(spark):
    _, df = cells(spark)
    p = skew.plan(df, "tokenized", 8)
    sizes = [r[0] for r in skew.fragment(df, "tokenized", p, ["rowid"]).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2 * df.count() / 8


def test_join_replicates_only_to_shards(spark):
    _, df = cells(spark)
    right = spark.createDataFrame([("hot", 1), ("v1", 2), ("v1", 3), ("none", 4)], "tokenized string, x int")
    got = sorted((r["rowid"], r["x"]) for r in skew.join(df, right, "tokenized", "inner", 8, ["rowid"]).collect())
    want = sorted((r["rowid"], r["x"]) for r in df.join(right, "tokenized").collect())
    assert got == want
    left = skew.join(df, right, "tokenized", "left", 8, ["rowid"])
    assert left.count() == df.join(right, "tokenized", "left").count()


def test_salted_join_equals_the_plain_one(spark):
    _, df = cells(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 9), ("v1", 2), ("none", 4), (None, 5)], "tokenized string, x int")
    for how in ("inner", "left"):
        got = sorted((r["rowid"], str(r["x"])) for r in skew.salted_join(df, right, "tokenized", how, ["rowid"], 8).collect())
        assert got == sorted((r["rowid"], str(r["x"])) for r in df.join(right, "tokenized", how).collect())
    assert skew.plan(df, "tokenized", 8).heavy
    assert skew.salted_join(df.limit(0), right, "tokenized").count() == 0


def test_dominant_and_empty(spark):
    _, df = cells(spark)
    found = {tuple(r) for r in skew.dominant_keys(df, ["tokenized", "tableid"], 0.3).collect()}
    assert found == {("tokenized", "hot"), ("tableid", "1")}
    assert skew.key_stats(df.limit(0), "tokenized", 4)[0].count() == 0
    assert skew.dominant_keys(df.limit(0), ["tokenized"], 0.02).count() == 0


def test_pack_is_balanced():
    placed, most = skew.pack({"a": (100, True), "b": (10, False), "c": (10, False)}, 4, 7.5)
    assert most <= 45 and set(placed) == {"a", "b", "c"}

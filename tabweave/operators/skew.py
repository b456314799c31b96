"""Per-key processing when a few keys hold most rows: fragment and replicate by estimated load.

1. Loads: rows are counted per hash bucket of the key (BUCKETS_PER_TASK times as many buckets as tasks, so that an ordinary
   bucket is far below the weight of a heavy key), then per key inside those buckets only that could hold a heavy key. Both
   counts combine on the map side.
2. Plan: a key above HEAVY of a task's fair share is heavy; there are at most tasks / HEAVY of them, which bounds what
   reaches the driver and what is broadcast. A heavy key is split into shards in proportion to its load; shards and the
   buckets of the remaining keys are packed, largest first, into the least loaded task.
3. Rows go to their task by partition id; rows of a heavy key choose its shard by a column whose values must stay
   together (shard_by). The matching side of a join is copied to the shards of a heavy key only.

Defined cases: a null key is a key like any other for placement; callers that don't want it filter it. An empty input
gives an empty result. The helper columns start with "__tw_"; a caller's column of another name is left alone.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_TASK, LEAST_BUCKETS = 16, 4096
HEAVY = 0.25
BIN, SHARD = "__tw_bin", "__tw_shard"


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(n)).cast("int")


def _literal(numbers: list[int]) -> Column:
    """One folded array literal; F.array of as many literals would be compiled one by one."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


@dataclass
class Plan:
    """tasks; heavy: key -> the task of each of its shards; buckets: the task of each bucket of other keys."""

    tasks: int
    total: int
    heavy: dict = field(default_factory=dict)
    buckets: list[int] = field(default_factory=list)


def pack(loads: dict, tasks: int, heavy_at: float) -> tuple[dict, float]:
    """loads: name -> (load, may be split). The tasks of each name's shards, and the largest load of a task."""
    items = []
    for name, (load, splits) in loads.items():
        n = max(1, -(-int(load) // max(1, int(heavy_at)))) if splits else 1
        items += [(load / n, str(name), name) for _ in range(min(n, tasks))]
    heap, out = [(0.0, t) for t in range(tasks)], {}
    for load, _, name in sorted(items, key=lambda x: (-x[0], x[1])):
        at, t = heapq.heappop(heap)
        out.setdefault(name, []).append(t)
        heapq.heappush(heap, (at + load, t))
    return out, max(x for x, _ in heap)


def plan(df: DataFrame, key: str, tasks: int) -> Plan:
    """Counts loads (two small jobs) and packs them."""
    n_buckets = max(LEAST_BUCKETS, BUCKETS_PER_TASK * tasks)
    keyed = df.select(F.col(key).alias("k"), _bucket(F.col(key), n_buckets).alias("b"))
    of_bucket = dict(keyed.groupBy("b").count().collect())  # at most n_buckets rows
    total = sum(of_bucket.values())
    fair = max(1.0, total / tasks)
    hot = [b for b, n in of_bucket.items() if n >= fair * HEAVY]
    heavy = {}
    if hot:
        counted = keyed.where(F.col("b").isin(hot) & F.col("k").isNotNull()).groupBy("b", "k").count().where(F.col("count") >= fair * HEAVY)
        heavy = {(b, k): n for b, k, n in counted.collect()}  # at most tasks / HEAVY rows
    rest = {b: n for b, n in of_bucket.items()}
    for (b, _), n in heavy.items():
        rest[b] -= n
    placed, _ = pack({("k", k): (n, True) for (_, k), n in heavy.items()} | {("b", b): (n, False) for b, n in rest.items()}, tasks, fair * HEAVY)
    return Plan(tasks, total, {k: placed["k", k] for _, k in heavy}, [placed.get(("b", b), [b % tasks])[0] for b in range(n_buckets)])


def _shards(p: Plan, df: DataFrame, key: str) -> DataFrame:
    """The plan's heavy keys as a relation: (k, tasks of the shards); at most tasks / HEAVY rows."""
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(list(p.heavy.items()), f"__tw_k {kind}, __tw_tasks array<int>")


def fragment(df: DataFrame, key: str, p: Plan, shard_by: list[str]) -> DataFrame:
    """df with BIN (its task) and SHARD, partitioned by BIN. Rows of one key with equal shard_by share a shard."""
    buckets = _literal(p.buckets)
    out = df
    if p.heavy:
        out = out.join(F.broadcast(_shards(p, df, key)), out[key] == F.col("__tw_k"), "left")
        n = F.size("__tw_tasks")
        shard = F.when(F.col("__tw_k").isNotNull(), F.pmod(F.xxhash64(*shard_by), F.greatest(n, F.lit(1))).cast("int")).otherwise(0)
        out = out.withColumn(SHARD, shard).withColumn(BIN, F.when(F.col("__tw_k").isNotNull(), F.try_element_at("__tw_tasks", F.col(SHARD) + 1)).otherwise(F.get(buckets, _bucket(F.col(key), len(p.buckets))))).drop("__tw_k", "__tw_tasks")
    else:
        out = out.withColumn(SHARD, F.lit(0)).withColumn(BIN, F.get(buckets, _bucket(F.col(key), len(p.buckets))))
    return out.repartitionById(p.tasks, F.col(BIN).cast("int"))


def replicate(df: DataFrame, key: str, p: Plan) -> DataFrame:
    """The matching side: a row of a heavy key goes to each of the key's shards, any other row to one task."""
    buckets = _literal(p.buckets)
    one = F.array(F.struct(F.lit(0).alias("s"), F.get(buckets, _bucket(F.col(key), len(p.buckets))).alias("t")))
    at = one
    out = df
    if p.heavy:
        out = out.join(F.broadcast(_shards(p, df, key)), out[key] == F.col("__tw_k"), "left")
        at = F.when(F.col("__tw_k").isNotNull(), F.transform("__tw_tasks", lambda t, i: F.struct(i.cast("int").alias("s"), t.alias("t")))).otherwise(one)
    out = out.withColumn("__tw_at", F.explode(at)).withColumn(SHARD, F.col("__tw_at.s")).withColumn(BIN, F.col("__tw_at.t"))
    return out.drop("__tw_at", "__tw_k", "__tw_tasks").repartitionById(p.tasks, F.col(BIN).cast("int"))


def join(left: DataFrame, right: DataFrame, key: str, how: str = "left", tasks: int = 0, shard_by: list[str] | None = None) -> DataFrame:
    """left join right on key (how: inner, left, leftsemi, leftanti), with neither a hot task nor a broadcast of right."""
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = plan(left, key, tasks)
    a, b = fragment(left, key, p, shard_by or left.columns), replicate(right, key, p)
    return a.join(b, [BIN, SHARD, key], how).drop(BIN, SHARD)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", shard_by: list[str] | None = None, tasks: int = 0) -> DataFrame:
    """left join right on key, heavy keys of left split into shards in proportion to their load and matched by copies of
    their right rows; where rows stand is left to the join's own exchange. left should be a written table: it is read twice."""
    p = plan(left, key, tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not p.heavy:
        return left.join(right, key, how)
    heavy = F.broadcast(_shards(p, left, key).select("__tw_k", F.size("__tw_tasks").alias("__tw_n")))
    of = F.coalesce("__tw_n", F.lit(1))
    a = left.join(heavy, left[key] == F.col("__tw_k"), "left").withColumn(SHARD, F.pmod(F.xxhash64(*(shard_by or left.columns)), of).cast("int")).drop("__tw_k", "__tw_n")
    b = right.join(heavy, right[key] == F.col("__tw_k"), "left").withColumn(SHARD, F.explode(F.sequence(F.lit(0), of - 1))).drop("__tw_k", "__tw_n")
    return a.join(b, [SHARD, key], how).drop(SHARD)


def key_stats(cells: DataFrame, key: str, tasks: int = 0) -> tuple[DataFrame, Plan]:
    """(key_value, n_rows, n_columns, n_tables) per non-null key of a cell relation (tableid, colid, ..), and the plan.

    Rows are combined per (key, table, column) on the map side first, so that even one value in one column of one table is
    a single row when it is placed. A shard holds whole tables of a value (or whole columns of a table), so that the shards'
    numbers add up.
    """
    tasks = tasks or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.select(F.col(key).alias("key_value"), F.col("tableid").alias("t"), F.col("colid").alias("c"))
    p = plan(rows, "key_value", tasks)
    by_table = key != "tableid"
    columns = rows.where(F.col("key_value").isNotNull()).groupBy("key_value", "t", "c").agg(F.count("*").alias("n"))
    placed = fragment(columns, "key_value", p, ["t"] if by_table else ["c"])
    per_table = placed.groupBy(BIN, SHARD, "key_value", "t").agg(F.sum("n").alias("n"), F.count("*").alias("cols"))
    shards = per_table.groupBy(BIN, SHARD, "key_value").agg(F.sum("n").alias("n"), F.sum("cols").alias("cols"), F.count("*").alias("tabs"))
    tables = F.sum("tabs") if by_table else F.max("tabs")
    return shards.groupBy("key_value").agg(F.sum("n").alias("n_rows"), F.sum("cols").alias("n_columns"), tables.alias("n_tables")), p


def dominant_keys(cells: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field, key_value) for each non-null value of a field that holds at least share of all rows as stored."""
    out = None
    for f in fields:
        stats, p = key_stats(cells, f)
        found = stats.where(F.col("n_rows") >= F.lit(share * p.total)).select(F.lit(f).alias("field"), F.col("key_value").cast("string"))
        out = found if out is None else out.unionByName(found)
    return out


HOT = 1000


def with_group_size(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the number of its rows that share the key, as `name`; df should be a written table (it is read three times).

    A key with more than 1 / HOT of all rows is hot: there are fewer than HOT of them, so their sizes are broadcast. The
    sizes of the other keys are joined by a shuffle in which no key has more than 1 / HOT of the rows.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias(name))
    limit = df.count() / HOT
    marked = df.join(F.broadcast(sizes.where(F.col(name) > limit)), key, "left")
    rest = marked.where(F.col(name).isNull()).drop(name).join(sizes.where(F.col(name) <= limit), key)
    columns = [*df.columns, name]
    return marked.where(F.col(name).isNotNull()).select(columns).unionByName(rest.select(columns))

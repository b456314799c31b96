"""Making inputs from complete tables, and precision and recall of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def make_input(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """rows (rowid, k, v). Open world: the first n rows keep v; closed world (seed): the n keys first by seeded hash do."""
    order = F.col("rowid") if seed is None else F.xxhash64(F.lit(seed), "k")
    first = rows.select("rowid", order.alias("o")).orderBy("o", "rowid").limit(n).select("rowid", F.lit(True).alias("given"))
    return rows.join(F.broadcast(first), "rowid", "left").select("rowid", "k", F.when(F.col("given"), F.col("v")).alias("v"))


def precision_recall(found: DataFrame, truth: DataFrame, n_examples: int = 0, indirect: bool = False, ignore_case: bool = False, blank_is_none: bool = False) -> DataFrame:
    """found, truth (k, v). (correct, answered, total, precision, recall). Given examples don't count: they are taken off
    the correct answers and, but for the indirect form, off the total."""
    if blank_is_none:
        found = found.where("v <> ''")
    a, b = F.col("f.v"), F.col("t.v")
    same = F.lower(a) == F.lower(b) if ignore_case else a == b
    j = truth.alias("t").join(found.alias("f"), "k", "left").agg(F.count_if(F.coalesce(same, F.lit(False))).alias("c"), F.count(a).alias("a"), F.count("*").alias("t"))
    t = F.col("t") - (0 if indirect else n_examples)
    c = F.greatest(F.col("c") - n_examples, F.lit(0))
    n = F.greatest(F.col("a") - n_examples, F.lit(0))
    return j.select(c.alias("correct"), n.alias("answered"), t.alias("total"), F.coalesce(F.try_divide(c, n), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(c, t), F.lit(0.0)).alias("recall"))


def smallest_tables(cells: DataFrame) -> DataFrame:
    """(tableid, n_rows) of the tables with the fewest columns."""
    s = cells.groupBy("tableid").agg(F.count_distinct("colid").alias("c"), F.count_distinct("rowid").alias("n_rows"))
    least = F.broadcast(s.agg(F.min("c").alias("least")))  # one row
    return s.crossJoin(least).where("c = least").select("tableid", "n_rows")


def keys_from_name(name: Column) -> Column:
    """The column numbers in brackets of a file name."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def question_batches(keys: DataFrame, size: int, seed: int = 1, examples: DataFrame | None = None) -> DataFrame:
    """(batch, question): keys in seeded random order, packed into JSON questions of `size` keys; each shows the examples
    (k, v), of which a user gives a few."""
    from tabweave.plans.common import parallelism

    n = parallelism(keys.sparkSession)
    part = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(n))
    i = F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), "k"), "k")) - 1
    shown = [tuple(r) for r in examples.select("k", "v").distinct().orderBy("k", "v").limit(size).collect()] if examples is not None else []
    given = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in shown)) if shown else F.array().cast("array<struct<k:string,v:string>>")
    b = keys.select("k", F.concat_ws("-", part, F.floor(i / size)).alias("batch"))
    return b.groupBy("batch").agg(F.array_sort(F.collect_list("k")).alias("keys")).select("batch", F.to_json(F.struct("keys", given.alias("examples"))).alias("question"))


def collate(results: DataFrame) -> DataFrame:
    """results (file, not_found, precision, recall, runtime_ms). One row per result file, the runtime in seconds."""
    return results.groupBy("file").agg(F.max("not_found").alias("not_found"), F.max("precision").alias("precision"), F.max("recall").alias("recall"), (F.max("runtime_ms") / 1000).alias("runtime_s"))

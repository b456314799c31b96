"""How distinctive a value is for a record, against the whole collection.

score = weight x ln(records / records with the value), where the weight is either
  degree     graph-of-words: the number of distinct neighbours of the value in the record's co-occurrence graph. An edge
             joins two different values that stand fewer than `window` places apart in one column of the record; or
  frequency  the number of the record's cells with the value.

The non-empty cells of a column are numbered and read in blocks of BLOCK with the next window - 1 cells repeated, so that
no task has to hold a whole column of a dominant table. They are numbered within runs of BLOCK rowids, to which the sizes
of all earlier runs are added.

Defined cases: exact repeats of a row count once; null and empty values have no score and stand in no window; ties in
the score go to the smaller value in byte order; a value alone in its record has degree 0. Scores are rounded to 6
decimals. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.skew import with_group_size

BLOCK = 1 << 15


def _distinct(cells: DataFrame) -> DataFrame:
    return cells.select("tableid", "colid", "rowid", "term", "tokenized").distinct()


def frequencies(cells: DataFrame) -> DataFrame:
    """(tableid, tokenized, weight): cells of the record with the value."""
    return _distinct(cells).where("tokenized <> ''").groupBy("tableid", "tokenized").agg(F.count("*").alias("weight"))


def degrees(cells: DataFrame, window: int = 4) -> DataFrame:
    """(tableid, tokenized, weight): distinct neighbours of the value in the record."""
    rows = _distinct(cells).where("tokenized <> ''").select("tableid", "colid", "rowid", "tokenized", F.floor(F.col("rowid") / BLOCK).alias("run"))
    sizes = rows.groupBy("tableid", "colid", "run").agg(F.count("*").alias("k"))
    before = (F.sum("k").over(Window.partitionBy("tableid", "colid").orderBy("run")) - F.col("k")).alias("before")
    inside = F.row_number().over(Window.partitionBy("tableid", "colid", "run").orderBy("rowid", "tokenized"))
    rows = rows.join(sizes.select("tableid", "colid", "run", before), ["tableid", "colid", "run"]).withColumn("p", F.col("before") + inside - 1)
    own = F.floor(F.col("p") / BLOCK)
    back = F.when((F.pmod("p", F.lit(BLOCK)) < window - 1) & (F.col("p") >= BLOCK), own - 1)
    rows = rows.select("tableid", "colid", "p", "tokenized", F.explode(F.array_compact(F.array(own, back))).alias("block"))
    order = Window.partitionBy("tableid", "colid", "block").orderBy("p")
    ahead = F.array(*(F.lead("tokenized", i).over(order) for i in range(1, window)))
    near = rows.withColumn("near", ahead).select("tableid", "tokenized", F.explode(F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), "near"))).alias("other"))
    # an edge is one row, its smaller end first; a value alone keeps a row without a second end
    edges = near.where("other is null or other <> tokenized").select("tableid", F.when(F.col("other").isNull(), F.col("tokenized")).otherwise(F.least("tokenized", "other")).alias("a"), F.when(F.col("other").isNotNull(), F.greatest("tokenized", "other")).alias("b")).distinct()
    ends = edges.select("tableid", F.explode(F.when(F.col("b").isNull(), F.array(F.struct(F.col("a").alias("v"), F.lit(0).alias("n")))).otherwise(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("n")), F.struct(F.col("b").alias("v"), F.lit(1).alias("n"))))).alias("e"))
    return ends.groupBy("tableid", F.col("e.v").alias("tokenized")).agg(F.sum("e.n").alias("weight"))


def scores(weights: DataFrame, n_records: int) -> DataFrame:
    """(tableid, tokenized, weight, score). weights should be a written table: it is read more than once."""
    all_ = with_group_size(weights, "tokenized", "df")
    return all_.select("tableid", "tokenized", "weight", F.round(F.col("weight") * F.log(F.lit(float(n_records)) / F.col("df")), 6).alias("score"))


def best(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best values of each record. Spark ranks within each task before the shuffle, so that a record with very
    many values sends k rows per task."""
    rank = F.row_number().over(Window.partitionBy("tableid").orderBy(F.col("score").desc(), "tokenized"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)

"""Joinability of tables: posting lists of header terms, and the pairs of tables that share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.skew import salted_join
from tabweave.plans.common import written


def postings(terms: DataFrame, most: int = 1000) -> DataFrame:
    """terms (field, tok, tableid). (field, tok, tableid): lists of more than one table, the first `most` ids of each.
    Spark ranks in each task before the shuffle, so that a hot term sends `most` rows per task."""
    one = terms.where("tok <> ''").select("field", "tok", "tableid").distinct()
    i = F.row_number().over(Window.partitionBy("field", "tok").orderBy("tableid"))
    top = one.withColumn("i", i).where(F.col("i") <= most)
    return top.join(top.where("i = 2").select("field", "tok"), ["field", "tok"], "left_semi").select("field", "tok", "tableid")


def _classes(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): each table (r) with the smallest table of equal terms (c); pairs x < y of such classes that share a
    term. A set of terms is known by its number and 128 bits of hashes combined without order."""
    lists = written(lists.distinct(), "lists")
    h = [F.hex(F.bit_xor(F.xxhash64(F.lit(i), "field", "tok"))) for i in (1, 2)]
    sets = written(lists.groupBy(F.col("tableid").alias("r")).agg(F.concat_ws("-", F.count("*"), *h).alias("h")), "sets")
    first = sets.groupBy("h").agg(F.min("r").alias("c"))
    members = written(salted_join(sets, first, "h", "inner", ["r"]).select("c", "r"), "members")
    one = lists.join(members.where("c = r").select(F.col("r").alias("tableid")), "tableid", "left_semi").withColumn("key", F.xxhash64("field", "tok"))
    one = written(one, "representatives")
    x, y = one.select("key", "field", "tok", F.col("tableid").alias("x")), one.select("key", F.col("field").alias("f"), F.col("tok").alias("t"), F.col("tableid").alias("y"))
    met = salted_join(x, y, "key", "inner", ["x"]).where("field = f and tok = t and x < y")
    return members, written(met.select("x", "y").distinct(), "links")


def join_classes(lists: DataFrame) -> DataFrame:
    """(tableid, class, n_links): each table with the smallest table of equal terms and the number of other classes that
    share a term with it: the graph without the expansion to all pairs of tables."""
    members, links = _classes(lists)
    n = links.select(F.explode(F.array("x", "y")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return salted_join(members.withColumnRenamed("c", "class"), n, "class", "left", ["r"]).select(F.col("r").alias("tableid"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def join_graph(lists: DataFrame) -> DataFrame:
    """(a, b), a < b: tables that share a term, from lists of any length. Tables with equal sets of terms form one class;
    only classes are joined on terms, and their links are expanded to tables at the end, so that no pair is built once per
    shared term. The rows grow as the square of a list; join_classes() doesn't expand them."""
    members, links = _classes(lists)
    a, b = members.select("c", F.col("r").alias("a")), members.select("c", F.col("r").alias("b"))
    half = written(salted_join(links.select(F.col("x").alias("c"), "y"), a, "c", "inner", ["y"]).select("a", F.col("y").alias("c")), "half")
    across = salted_join(half, b, "c", "inner", ["a"]).select("a", "b")
    within = salted_join(a, b, "c", "inner", ["a"]).where("a < b").select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)


def inverted_index(cells: DataFrame) -> DataFrame:
    """(tokenized, n_tables, n_cells) of every token."""
    per = cells.where("tokenized <> ''").groupBy("tokenized", "tableid").agg(F.count("*").alias("n"))
    return per.groupBy("tokenized").agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_cells"))

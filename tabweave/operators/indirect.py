"""Two-hop transformation X -> Z -> Y, enrichment and value alternatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators import em, fd, score, search
from tabweave.plans.common import written


def x_to_z(cells: DataFrame, x_columns: DataFrame, dependencies: DataFrame, keys: DataFrame) -> DataFrame:
    """x_columns (tableid, x_col), dependencies (tableid, x_col, z_col), keys (k). (tableid, x_col, z_col, k, z): what the
    tables that hold the keys say of them in the columns they determine; the smallest z of a key."""
    d = search.small(dependencies.join(search.small(x_columns.select("tableid", "x_col").distinct()), ["tableid", "x_col"], "left_semi"))
    some = ["tableid", "colid", "rowid", "tokenized"]
    x = search.holding(cells.select(*some), keys.select(F.col("k").alias("tokenized"))).distinct().withColumnsRenamed({"colid": "x_col", "tokenized": "k"})
    z = cells.where("tokenized <> ''").select(*some).join(d.select("tableid", F.col("z_col").alias("colid")).distinct(), ["tableid", "colid"], "left_semi").distinct().withColumnsRenamed({"colid": "z_col", "tokenized": "z"})
    hit = x.join(d, ["tableid", "x_col"]).join(z, ["tableid", "rowid", "z_col"])
    return hit.groupBy("tableid", "x_col", "z_col", "k").agg(F.min("z").alias("z"))


def intermediate(cells: DataFrame, keys: DataFrame, examples: DataFrame, least: int, seen: DataFrame | None = None) -> DataFrame:
    """keys (k), examples (k, v). (tableid, x_col, z_col, k, z) from the tables that hold `least` of the keys and that the
    direct search has not seen (tableid); the examples must have as many different z as y at least. Dependencies are looked
    for in these tables alone."""
    found = search.matching_columns(cells, keys.select(F.lit(0).alias("pos"), F.col("k").alias("tokenized")), least).select("tableid", F.col("colid").alias("x_col"))
    if seen is not None:
        found = found.join(seen.select("tableid").distinct(), "tableid", "left_anti")
    found = written(found, "x-columns")
    own = cells.join(search.small(found.select("tableid").distinct()), "tableid", "left_semi")
    xz = written(x_to_z(own, found, fd.cell_dependencies(own, found), keys), "xz")
    enough = xz.join(examples.select("k", "v"), "k").groupBy("tableid", "x_col", "z_col").agg(F.count_distinct("z").alias("nz"), F.count_distinct("v").alias("ny")).where("nz >= ny")
    return xz.join(search.small(enough.select("tableid", "x_col", "z_col")), ["tableid", "x_col", "z_col"], "left_semi")


def reachable(examples: DataFrame, least: int) -> int:
    """The threshold of the second search: no more than the examples have different values."""
    return max(1, min(least, examples.select("v").distinct().count()))


def z_to_y(cells: DataFrame, xz: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """(mid, k, v): what the tables say that hold enough of the z and of the examples' y."""
    zs, ys = xz.select(F.col("z").alias("tokenized")).distinct(), examples.select(F.col("v").alias("tokenized"))
    found = written(search.find_tables(cells, zs, ys, reachable(examples, least)), "zy-tables")
    return written(score.answers(score.table_map(cells, found)), "zy")


def joinable(xz: DataFrame, mapped: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """mapped (mid, k, v): tables that map some z to some y. (x_mid, mid, n): those where at least `least` example z have
    exactly their y as the only value, and none has another."""
    ez = xz.withColumn("x_mid", F.concat_ws(":", "tableid", "x_col", "z_col")).join(examples.select("k", F.col("v").alias("y")), "k").select("x_mid", "z", "y").distinct()
    per_z = mapped.groupBy("mid", F.col("k").alias("z")).agg(F.count_distinct("v").alias("m"), F.min("v").alias("v"))
    hit = ez.join(per_z, "z").groupBy("x_mid", "mid").agg(F.count_if((F.col("m") == 1) & (F.col("v") == F.col("y"))).alias("n"), F.count_if((F.col("m") > 1) | (F.col("v") != F.col("y"))).alias("wrong"))
    return hit.where((F.col("n") >= least) & (F.col("wrong") == 0)).select("x_mid", "mid", "n")


def two_hop(xz: DataFrame, mapped: DataFrame, joined: DataFrame) -> DataFrame:
    """(mid, k, v): answers through z, the first value on either side."""
    a = xz.withColumn("x_mid", F.concat_ws(":", "tableid", "x_col", "z_col")).select("x_mid", "k", "z")
    b = mapped.groupBy("mid", F.col("k").alias("z")).agg(F.min("v").alias("v"))
    return a.join(joined.select("x_mid", "mid"), "x_mid").join(b, ["mid", "z"]).select(F.concat_ws(">", "x_mid", "mid").alias("mid"), "k", "v").distinct()


def hops(cells: DataFrame, xz: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """(mid, k, v): the answers of all intermediate tables, not of the first one only."""
    zy = z_to_y(cells, xz, examples, least)
    return two_hop(xz, zy, written(joinable(xz, zy, examples, reachable(examples, least)), "joined"))


def transform(cells: DataFrame, keys: DataFrame, examples: DataFrame, tables_of: Callable[[DataFrame], DataFrame], least: int = 2, rounds: int = 2) -> DataFrame:
    """(k, v, score) for every key: the direct loop (at most `rounds` rounds), then the answers over two hops, whose tables
    have half their prior; then all tables are rated and all answers scored again."""
    direct = em.induce(cells, keys, examples, tables_of, least, searches=rounds, most=rounds)
    seen = direct.evidence.select(F.split("mid", ":")[0].cast("long").alias("tableid"))
    xz = intermediate(cells, keys, examples, least, seen)
    over = written(hops(cells, xz, examples, least), "hops")
    both = written(direct.evidence.unionByName(over).distinct(), "both")
    prior = tables_of(direct.evidence).unionByName(tables_of(over).withColumn("prior", F.col("prior") * 0.5))
    _, found = em.rounds(both, examples, written(prior, "tables"), rounds)
    return score.transform(keys, found)


def enrichment(cells: DataFrame, keys: DataFrame, least: int = 10, first: int = 20) -> DataFrame:
    """(k, name, z): for every input key, what the `first` tables with `least` of the keys add to it, by the columns that the
    key determines; name: t_<table>_<column>."""
    found = search.matching_columns(cells, keys.select(F.lit(0).alias("pos"), F.col("k").alias("tokenized")), least).select("tableid", F.col("colid").alias("x_col"))
    found = written(found.join(F.broadcast(found.select("tableid").distinct().orderBy("tableid").limit(first)), "tableid", "left_semi"), "x-columns")
    own = cells.join(F.broadcast(found.select("tableid").distinct()), "tableid", "left_semi")  # `first` tables at most
    xz = x_to_z(own, found, fd.cell_dependencies(own, found), keys)
    return xz.groupBy("k", F.concat_ws("_", F.lit("t"), "tableid", "z_col").alias("name")).agg(F.min("z").alias("z"))


def marked(rows: DataFrame, web: DataFrame) -> DataFrame:
    """rows (rowid, k, v), web (tableid, rowid, k, v). (own_col, rowid, v, other, n): where a web row shares the key and has
    another value, that value and in how many web rows."""
    w = web.select("tableid", F.col("rowid").alias("r"), "k", F.col("v").alias("other")).distinct()
    hit = rows.select("rowid", "k", "v").join(w, "k").where("v <> other")
    return hit.groupBy(F.lit(1).alias("own_col"), "rowid", "v", "other").agg(F.count("*").alias("n"))


def widen(keys: DataFrame, xz: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per input key, one column tableid_z per sub-table. Without given columns they are found by one query."""
    long = xz.withColumn("c", F.concat_ws("_", F.lit("t"), "tableid", "z_col")).groupBy("k", "c").agg(F.min("z").alias("z"))
    wide = (long.groupBy("k").pivot("c", columns) if columns else long.groupBy("k").pivot("c")).agg(F.min("z"))
    return keys.select("k").distinct().join(wide, "k", "left")


def alternatives(rows: DataFrame, xz: DataFrame) -> DataFrame:
    """rows (k, v): the original values, counted once each. (k, v, n): these and what other tables say of the same key."""
    return rows.select("k", "v").unionByName(xz.select("k", F.col("z").alias("v")).join(rows.select("k").distinct(), "k", "left_semi")).groupBy("k", "v").agg(F.count("*").alias("n"))

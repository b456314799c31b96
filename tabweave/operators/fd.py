"""Functional dependencies and keys. NULL is an ordinary value, "NULL".

Every test over a set of candidates is one pass: the candidates' grouping sets are made by exploding each row into one
row per candidate, so that a level of the lattice costs one aggregation however many candidates it has.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.plans.common import written


def _values(df: DataFrame, columns: tuple[str, ...]):
    return F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns))


def _name(columns: tuple[str, ...]) -> str:
    return ",".join(columns)


def partition_errors(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(x, n_classes, error): per column set, its classes of more than one row and e(X), the sum of their sizes less one."""
    each = F.explode(F.array(*(F.struct(F.lit(_name(s)).alias("x"), _values(df, s).alias("v")) for s in sets)))
    return df.select(each.alias("e")).groupBy("e.x", "e.v").agg(F.count("*").alias("n")).groupBy("x").agg(F.count_if(F.col("n") > 1).alias("n_classes"), F.sum(F.col("n") - 1).alias("error"))


def g3(df: DataFrame, candidates: list[tuple[tuple[str, ...], str]]) -> DataFrame:
    """(x, a, removed): rows to delete until X -> A holds."""
    each = F.explode(F.array(*(F.struct(F.lit(_name(x)).alias("x"), F.lit(a).alias("a"), _values(df, x).alias("v"), F.coalesce(F.col(a).cast("string"), F.lit("NULL")).alias("w")) for x, a in candidates)))
    n = df.select(each.alias("e")).groupBy("e.x", "e.a", "e.v", "e.w").agg(F.count("*").alias("n"))
    return n.groupBy("x", "a", "v").agg((F.sum("n") - F.max("n")).alias("r")).groupBy("x", "a").agg(F.sum("r").alias("removed"))


def dependencies(df: DataFrame, columns: list[str], eps: float = 0.0, most_left: int = 2) -> list[tuple[tuple[str, ...], str]]:
    """The minimal approximate dependencies with up to most_left columns on the left, level by level. An approximate key
    determines every other column and is not extended."""
    n = df.count()
    found: list[tuple[tuple[str, ...], str]] = []
    keys: list[tuple[str, ...]] = []
    for size in range(1, most_left + 1):
        level = [x for x in combinations(columns, size) if not any(set(k) <= set(x) for k in keys)]
        tests = [(x, a) for x in level for a in columns if a not in x and not any(b == a and set(y) <= set(x) for y, b in found)]
        if not tests:
            break
        errors = {r["x"]: r["error"] for r in partition_errors(df, level).collect()}
        removed = {(r["x"], r["a"]): r["removed"] for r in g3(df, tests).collect()}
        found += [(x, a) for x, a in tests if removed.get((_name(x), a), 0) <= eps * n]
        keys += [x for x in level if errors.get(_name(x), 0) <= eps * n]
    return sorted(found)


def closure(columns: set[str], found: list[tuple[tuple[str, ...], str]]) -> set[str]:
    out = set(columns)
    while new := {a for x, a in found if set(x) <= out} - out:
        out |= new
    return out


def candidate_keys(df: DataFrame, columns: list[str], most: int = 3) -> list[tuple[str, ...]]:
    """The minimal column sets of up to `most` columns without two equal rows."""
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        level = [x for x in combinations(columns, size) if not any(set(k) <= set(x) for k in keys)]
        if not level:
            break
        errors = {r["x"]: r["error"] for r in partition_errors(df, level).collect()}
        keys += [x for x in level if errors.get(_name(x), 0) == 0]
    return keys


def cell_dependencies(cells: DataFrame, x_columns: DataFrame | None = None, eps: float = 0.1) -> DataFrame:
    """(tableid, x_col, z_col): in every table of a cell relation at once, the single columns that determine another one
    for all but eps of the rows. If X is nearly a key, it determines every other column; a dependency on a column that is
    itself nearly a key isn't tested. Rows are paired only for what is left to test: X from x_columns (tableid, x_col) if
    given, neither column nearly a key."""
    c = cells.select("tableid", "colid", "rowid", F.coalesce("tokenized", F.lit("NULL")).alias("v")).distinct()
    per = c.groupBy("tableid", "colid", "v").agg(F.count("*").alias("n")).groupBy("tableid", "colid").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("error"))
    per = written(per.withColumn("key", F.col("error") <= eps * F.col("rows")), "column-keys")
    x = per.select("tableid", F.col("colid").alias("x_col"), F.col("key").alias("x_key"))
    if x_columns is not None:
        x = x.join(x_columns.select("tableid", "x_col").distinct(), ["tableid", "x_col"], "left_semi")
    z = per.select("tableid", F.col("colid").alias("z_col"), F.col("key").alias("z_key"))
    pairs = x.join(z, "tableid").where("x_col <> z_col")
    by_key = pairs.where("x_key")
    # a key's rows pair with those of every other column that stands in one of its rows
    rows_of = c.select("tableid", "colid", "rowid")
    wanted = pairs.where("not x_key and not z_key").select("tableid", "x_col", "z_col")
    open_x = wanted.select("tableid", F.col("x_col").alias("colid")).distinct()
    open_z = wanted.select("tableid", F.col("z_col").alias("colid")).distinct()
    a = c.join(open_x, ["tableid", "colid"], "left_semi").withColumnsRenamed({"colid": "x_col", "v": "x"})
    b = c.join(open_z, ["tableid", "colid"], "left_semi").withColumnsRenamed({"colid": "z_col", "v": "z"})
    n = a.join(b, ["tableid", "rowid"]).where("x_col <> z_col").groupBy("tableid", "x_col", "z_col", "x", "z").agg(F.count("*").alias("n"))
    r = n.groupBy("tableid", "x_col", "z_col", "x").agg((F.sum("n") - F.max("n")).alias("r"), F.sum("n").alias("m")).groupBy("tableid", "x_col", "z_col").agg(F.sum("r").alias("removed"), F.sum("m").alias("m"))
    tested = r.join(wanted, ["tableid", "x_col", "z_col"], "left_semi").where(f"removed <= {eps} * m").select("tableid", "x_col", "z_col")
    # a key determines the columns that it shares a row with
    left = rows_of.join(by_key.select("tableid", F.col("x_col").alias("colid")).distinct(), ["tableid", "colid"], "left_semi").groupBy("tableid", F.col("colid").alias("x_col")).agg(F.min("rowid").alias("lo"), F.max("rowid").alias("hi"))
    span = rows_of.groupBy("tableid", F.col("colid").alias("z_col")).agg(F.min("rowid").alias("z_lo"), F.max("rowid").alias("z_hi"))
    known = by_key.join(left, ["tableid", "x_col"]).join(span, ["tableid", "z_col"]).where("lo <= z_hi and z_lo <= hi").select("tableid", "x_col", "z_col")
    return tested.unionByName(known)


def minimal_cover(found: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    """The dependencies without columns that their left sides don't need, and without those that the others imply."""
    out = []
    for x, a in sorted(set(found)):
        left = set(x)
        for c in x:
            if len(left) > 1 and a in closure(left - {c}, found):
                left.discard(c)
        out.append((tuple(sorted(left)), a))
    out = sorted({(x, a) for x, a in out if a not in x})
    for f in list(out):
        rest = [g for g in out if g != f]
        if f[1] in closure(set(f[0]), rest):
            out = rest
    return out


def keys_of_source(df: DataFrame, most_columns: int = 10) -> list[tuple[str, ...]]:
    """The keys by which a flat source is looked up: with fewer than most_columns columns, the left sides of its exact
    dependencies of up to two columns whose closure is everything, the longest first; else each column by itself."""
    columns = df.columns
    if len(columns) >= most_columns:
        return [(c,) for c in columns]
    found = dependencies(df, columns, 0.0, 2)
    keys = sorted({x for x, _ in found if closure(set(x), found) == set(columns)}, key=lambda x: (-len(x), x))
    return keys or [(c,) for c in columns]

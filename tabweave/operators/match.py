"""Column matching: coverage of one table's columns by another's, best column, one-to-one mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(web: DataFrame, own: DataFrame) -> DataFrame:
    """web (web_col, v) and own (own_col, v), bags of comparable values; null matches null. (own_col, web_col, n): rows of
    the web column whose value some row of the own column has."""
    w = web.groupBy("web_col", F.coalesce("v", F.lit("\u0000")).alias("v")).agg(F.count("*").alias("n"))
    o = own.select("own_col", F.coalesce("v", F.lit("\u0000")).alias("v")).distinct()
    return w.join(o, "v").groupBy("own_col", "web_col").agg(F.sum("n").alias("n"))


def best_column(covered: DataFrame, least: int) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("own_col").orderBy(F.col("n").desc(), "web_col"))
    return covered.withColumn("i", i).where((F.col("i") == 1) & (F.col("n") >= least)).select("own_col", "web_col", "n")


def assign(weights: dict[tuple[int, int], float], n: int, m: int) -> list[tuple[int, int]]:
    """Maximum-weight assignment of n rows to m columns by shortest augmenting paths with potentials."""
    size = max(n, m)
    top = max(weights.values(), default=0.0)
    cost = [[top - weights.get((i, j), 0.0) for j in range(size)] for i in range(size)]
    inf = float("inf")
    u, v, p, way = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        p[0], j0 = i, 0
        low, used = [inf] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(size + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
    return [(p[j] - 1, j - 1) for j in range(1, size + 1) if p[j] and p[j] <= n and j <= m]


def column_mapping(covered: DataFrame, least: int) -> DataFrame:
    """(own_col, web_col, n): the one-to-one mapping of greatest coverage, pairs above `least` only. The matrix has as many
    cells as the two tables have column pairs."""
    rows = covered.where(F.col("n") > least).collect()
    own, web = sorted({r["own_col"] for r in rows}), sorted({r["web_col"] for r in rows})
    weights = {(own.index(r["own_col"]), web.index(r["web_col"])): float(r["n"]) for r in rows}
    chosen = [(own[i], web[j], int(weights[i, j])) for i, j in assign(weights, len(own), len(web)) if (i, j) in weights]
    kind = {f.name: f.dataType.simpleString() for f in covered.schema}
    return covered.sparkSession.createDataFrame(chosen, f"own_col {kind['own_col']}, web_col {kind['web_col']}, n long")


def entity_match(values: DataFrame, triples: DataFrame) -> DataFrame:
    """(v, subject): values that an object of some triple names, by a local knowledge base."""
    return values.select("v").distinct().join(triples.select(F.col("object_tokenized").alias("v"), "subject").distinct(), "v")

"""Candidate tables: which tables of a corpus hold the examples, and which examples to search with.

cells: (tableid, colid, rowid, term, tokenized), one row per cell; null and empty tokens never match. Example tokens come
as small relations and reach the scan of the cells as semi-joins. Every result is deterministic: ties and limits are
ordered by identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.text import TOKEN

#: The most example rows that are broadcast; a larger example relation is joined by a shuffle.
MAX_BROADCAST = 100_000


#: The most example tokens that are sent to the scan as a pushed-down list.
MAX_LISTED = 1_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is checked to be small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def usable(cells: DataFrame) -> DataFrame:
    return cells.where("tokenized is not null and tokenized <> ''").select("tableid", "colid", "rowid", "tokenized").distinct()


def holding(cells: DataFrame, tokens: DataFrame | list[tuple[int, str]]) -> DataFrame:
    """cells joined with tokens (tokenized, ..) on the token. Up to MAX_LISTED tokens become an IN list that the scan
    takes (row groups without any of them are skipped where the layout is sorted by token); more are joined. Tokens may be
    given as a list of (pos, token)."""
    if isinstance(tokens, list):
        rows = [(p, t) for p, t in sorted(set(tokens)) if t]
        tokens = cells.sparkSession.createDataFrame(rows, "pos int, tokenized string")
        rows = [{"tokenized": t} for _, t in rows]
        if rows and len(rows) <= MAX_LISTED:
            return cells.where(F.col("tokenized").isin(sorted({r["tokenized"] for r in rows}))).join(F.broadcast(tokens), "tokenized")
    else:
        tokens = tokens.where("tokenized <> ''").distinct()
        rows = tokens.limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        return cells.where("tokenized <> ''").join(small(tokens), "tokenized")
    listed = cells.where(F.col("tokenized").isin(sorted({r["tokenized"] for r in rows}))) if rows else cells.where(F.lit(False))
    return listed.join(F.broadcast(cells.sparkSession.createDataFrame(rows, tokens.schema)), "tokenized")


def matching_columns(cells: DataFrame, tokens: DataFrame | list[tuple[int, str]], least: int) -> DataFrame:
    """tokens (pos, tokenized). (pos, tableid, colid) of the columns with at least `least` different tokens of pos: one
    scan and one aggregation for all positions."""
    hit = holding(cells, tokens if isinstance(tokens, list) else tokens.select("pos", "tokenized"))
    return hit.groupBy("pos", "tableid", "colid").agg(F.count_distinct("tokenized").alias("n")).where(F.col("n") >= least).select("pos", "tableid", "colid")


def find_tables(cells: DataFrame, xs: DataFrame | list[str], ys: DataFrame | list[str], least: int) -> DataFrame:
    """(tableid, x_col, y_col): tables with a column holding `least` of the xs and another one holding `least` of the ys.
    The tokens are relations (tokenized) or lists."""
    if isinstance(xs, list):
        tokens = [(0, x) for x in xs] + [(1, y) for y in ys]
    else:
        tokens = xs.select(F.lit(0).alias("pos"), "tokenized").unionByName(ys.select(F.lit(1).alias("pos"), "tokenized"))
    found = matching_columns(cells, tokens, least)
    x, y = found.where("pos = 0").select("tableid", F.col("colid").alias("x_col")), found.where("pos = 1").select("tableid", F.col("colid").alias("y_col"))
    return x.join(y, "tableid").where("x_col <> y_col")


def find_tables_multi(cells: DataFrame, xs: list[DataFrame], ys: list[DataFrame], least: int, most: int = 1000, key: str = "tableid", by_row: bool = True) -> DataFrame:
    """(key, x0.., y0..): one column per x (all in one row of the table if by_row) and per y; columns of the xs differ from
    each other and from those of the ys. The first `most` in the order of the identity. By row, an X cell holds one token,
    so that one is all a cell can be asked for; `least` then holds for the Y columns (and for both without by_row)."""
    tokens = None
    for i, t in enumerate([*xs, *ys]):
        one = t.select(F.lit(i).alias("pos"), "tokenized")
        tokens = one if tokens is None else tokens.unionByName(one)
    hit = holding(cells, tokens)
    row = [key, "colid", "rowid"] if by_row else [key, "colid"]
    need_x = 1 if by_row else least
    out = None
    for i in range(len(xs)):
        c = hit.where(F.col("pos") == i).groupBy(*row).agg(F.count_distinct("tokenized").alias("n")).where(F.col("n") >= need_x).select(key, F.col("colid").alias(f"x{i}"), *(["rowid"] if by_row else []))
        out = c if out is None else out.join(c, [key, "rowid"] if by_row else [key]).where(" and ".join(f"x{i} <> x{j}" for j in range(i)))
    out = out.drop("rowid").distinct()
    for i in range(len(ys)):
        c = hit.where(F.col("pos") == len(xs) + i).groupBy(key, "colid").agg(F.count_distinct("tokenized").alias("n")).where(F.col("n") >= least).select(key, F.col("colid").alias(f"y{i}"))
        out = out.join(c, key).where(" and ".join(f"y{i} <> x{j}" for j in range(len(xs))))
    return out.orderBy(*out.columns).limit(most)


def row_pairs(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y). (tableid, rowid, x_col, y_col, x, y): rows of the corpus that hold both in different columns. Only the
    cells that hold an example are made distinct and shuffled."""
    p = pairs.select("x", "y").distinct()
    some = ["tableid", "rowid", "colid", "tokenized"]
    a = holding(cells.select(*some), p.select(F.col("x").alias("tokenized"), "y")).distinct().select("tableid", "rowid", F.col("colid").alias("x_col"), F.col("tokenized").alias("x"), "y")
    b = holding(cells.select(*some), p.select(F.col("y").alias("tokenized"))).distinct().select("tableid", "rowid", F.col("colid").alias("y_col"), F.col("tokenized").alias("y"))
    return a.join(b, ["tableid", "rowid", "y"]).where("x_col <> y_col").select("tableid", "rowid", "x_col", "y_col", "x", "y")


def validated(least: int, xs: list, ys: list) -> None:
    """The entry check of a search: more matches than examples can't be asked for."""
    if least < 1:
        raise ValueError("at least one match must be asked for")
    if least > len(set(xs)) or ys and least > len(set(ys)):
        raise ValueError(f"{least} matches asked for, but only {min(len(set(xs)), len(set(ys)) if ys else len(set(xs)))} examples given")


def query_tables(cells: DataFrame, examples: list[tuple[str, str]], least: int) -> DataFrame:
    """find_tables from the user's example pairs, checked."""
    xs, ys = [x for x, _ in examples], [y for _, y in examples]
    validated(least, xs, ys)
    return find_tables(cells, xs, ys, least)


def similar_find_tables(cells: DataFrame, inputs: list[str], outputs: list[str], least: int) -> DataFrame:
    """(tableid, x0, y0): the entry with parallel lists, inputs[i] -> outputs[i]."""
    if len(inputs) != len(outputs):
        raise ValueError("as many outputs as inputs are needed")
    validated(least, inputs, outputs)
    tokens = lambda v: cells.sparkSession.createDataFrame([(t,) for t in sorted(set(v))], "tokenized string")
    return find_tables_multi(cells, [tokens(inputs)], [tokens(outputs)], least, by_row=False)


def find_row_aligned(cells: DataFrame, examples: DataFrame, least: int) -> DataFrame:
    """examples (x, y). (tableid, x_col, y_col, n): columns that hold x and y of an example in one row, at least `least` times."""
    return row_pairs(cells, examples).groupBy("tableid", "x_col", "y_col").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fuzzy_terms(terms: DataFrame, wanted: DataFrame, most: int = 100) -> DataFrame:
    """wanted (w), terms (tokenized). (w, tokenized, distance): terms within min(2, ceil(0.2 x length)) edits of each w of
    5 and more characters, the nearest `most`. Candidates share one of three pieces of w at a place shifted by at most 2
    (two edits leave one piece whole), and their lengths differ by at most the allowed edits."""
    k = F.least(F.lit(2), F.ceil(F.length("w") * 0.2)).cast("int")
    w = wanted.select("w").distinct().where(F.length("w") >= 5).withColumn("k", k)
    size = F.floor(F.length("w") / 3).cast("int")
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.lit(i) < 2, F.expr(f"substr(w, {i} * int(length(w) / 3) + 1, int(length(w) / 3))")).otherwise(F.expr("substr(w, 2 * int(length(w) / 3) + 1)")).alias("p"), (F.lit(i) * size).alias("at")) for i in range(3)))
    probe = w.withColumn("piece", F.explode(pieces)).select("w", "k", "piece.*").withColumn("len", F.explode(F.sequence(F.length("w") - F.col("k"), F.length("w") + F.col("k"))))
    shapes = probe.select("len", F.length("p").alias("g"), F.explode(F.sequence(F.greatest(F.col("at") - 2, F.lit(0)), F.col("at") + 2)).alias("s")).distinct()
    t = terms.select("tokenized").where("tokenized <> ''").distinct().withColumn("len", F.length("tokenized"))
    # only the substrings that some wanted piece could meet are made
    grams = t.join(small(shapes), "len").select("tokenized", "len", F.expr("substr(tokenized, s + 1, g)").alias("p")).distinct()
    near = grams.join(small(probe.select("w", "k", "p", "len").distinct()), ["p", "len"]).select("w", "k", "tokenized").distinct()
    near = near.withColumn("distance", F.levenshtein("w", "tokenized", 2)).where("distance between 0 and k").select("w", "tokenized", "distance")
    return near.withColumn("i", F.row_number().over(Window.partitionBy("w").orderBy("distance", "tokenized"))).where(F.col("i") <= most).drop("i")


def find_tables_fuzzy(cells: DataFrame, xs: DataFrame, ys: DataFrame, least: int) -> DataFrame:
    """find_tables with each example widened by the terms near it."""
    terms = cells.select("tokenized").distinct()

    def widened(tokens: DataFrame) -> DataFrame:
        return tokens.select("tokenized").union(fuzzy_terms(terms, tokens.withColumnRenamed("tokenized", "w")).select("tokenized")).distinct()

    return find_tables(cells, widened(xs), widened(ys), least)


def substrings(values: DataFrame, longer_than: int = 3) -> DataFrame:
    """values (v). (v, s): the different substrings of v with more than longer_than characters."""
    at = values.select("v", F.explode(F.sequence(F.lit(1), F.length("v") - longer_than)).alias("i")).where(F.length("v") > longer_than)
    return at.select("v", "i", F.explode(F.sequence(F.lit(longer_than + 1), F.length("v") - F.col("i") + 1)).alias("n")).selectExpr("v", "substr(v, i, n) s").distinct()


def fulltext_tables(cells: DataFrame, headers: DataFrame, tables: DataFrame, stored: DataFrame, keys: DataFrame, values: DataFrame, wanted_headers: list[str], least_x: int, least_y: int, most: int = 1000) -> DataFrame:
    """Tables that hold `least_x` of the keys (tokenized) and `least_y` of the values (tokenized): (tableid, n_keys, n_values,
    n_headers, n_around, score). The rarest-supported keys count most (the stored idf of each token found); a header of the
    input's that the table has adds a quarter, a word of the keys in title or context a tenth."""
    w = stored.where("idf > 0 and idf < double('infinity')").groupBy(F.col("term").alias("tokenized")).agg(F.least(F.max("idf"), F.lit(30.0)).alias("w"))

    def side(tokens: DataFrame, least: int, n: str, s: str) -> DataFrame:
        t = tokens.select("tokenized").distinct()
        weighted = t.join(w.join(small(t), "tokenized", "left_semi"), "tokenized", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        hit = holding(cells.select("tableid", "tokenized"), weighted).distinct()
        return hit.groupBy("tableid").agg(F.count("*").alias(n), F.sum("w").alias(s)).where(F.col(n) >= least)

    heads = headers.where(F.col("header_tokenized").isin(wanted_headers) if wanted_headers else F.lit(False)).groupBy("tableid").agg(F.count_distinct("header_tokenized").alias("n_headers"))
    words = keys.select(F.explode(F.split("tokenized", " ")).alias("word")).distinct()
    shown = tables.select("tableid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "context")), F.lit(TOKEN), F.lit(0)))).alias("word"))
    around = shown.join(small(words), "word", "left_semi").groupBy("tableid").agg(F.count_distinct("word").alias("n_around"))
    out = side(keys, least_x, "n_keys", "sx").join(side(values, least_y, "n_values", "sy"), "tableid").join(heads, "tableid", "left").join(around, "tableid", "left")
    out = out.withColumns({"n_headers": F.coalesce("n_headers", F.lit(0)), "n_around": F.coalesce("n_around", F.lit(0))})
    score = F.round(F.col("sx") + F.col("sy") + 0.25 * F.col("n_headers") + 0.1 * F.col("n_around"), 6)
    return out.select("tableid", "n_keys", "n_values", "n_headers", "n_around", score.alias("score")).orderBy(F.col("score").desc(), "tableid").limit(most)


def cooccurrence(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (x, y). (x, y, n): the columns that hold both."""
    p = pairs.select("x", "y").distinct()
    some = ["tableid", "colid", "tokenized"]
    a = holding(cells.select(*some), p.select(F.col("x").alias("tokenized"), "y")).distinct().withColumnRenamed("tokenized", "x")
    b = holding(cells.select(*some), p.select(F.col("y").alias("tokenized"))).distinct().withColumnRenamed("tokenized", "y")
    return a.join(b, ["tableid", "colid", "y"]).groupBy("x", "y").agg(F.count("*").alias("n"))


def table_difference(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("tableid").distinct(), "tableid", "left_anti")


def present_in_corpus(cells: DataFrame, pairs: DataFrame, sizes: DataFrame | None = None, larger_than: int = 3) -> DataFrame:
    """pairs (x, y) that stand in one row of some table (of more than larger_than rows, if sizes (tableid, numrows) is given)."""
    found = row_pairs(cells, pairs)
    if sizes is not None:
        found = found.join(sizes.where(F.col("numrows") > larger_than).select("tableid").distinct(), "tableid", "left_semi")
    return found.select("x", "y").distinct()


def policy_by_frequency(cells: DataFrame, tokens: DataFrame, n: int, most: bool) -> DataFrame:
    """(tokenized, n_cols): the n most or least frequent example tokens, by the columns that hold them."""
    hit = holding(cells, tokens.select("tokenized")).groupBy("tokenized").agg(F.count_distinct("tableid", "colid").alias("n_cols"))
    return hit.orderBy(F.col("n_cols").desc() if most else F.col("n_cols"), "tokenized").limit(n)


def policy_by_pairs(cells: DataFrame, examples: DataFrame, n: int, most: bool) -> DataFrame:
    """(x, y, n_tables): the n examples whose x and y share a row in most or fewest tables, one pair per x."""
    counted = row_pairs(cells, examples).groupBy("x", "y").agg(F.count_distinct("tableid").alias("n_tables"))
    order = F.col("n_tables").desc() if most else F.col("n_tables")
    one = counted.withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy(order, "y"))).where("i = 1").drop("i")
    return one.orderBy(order, "x").limit(n)


def policy_certain(examples: DataFrame, policy: str, n: int, per_x: int = 2) -> DataFrame:
    """examples (x, y, score). most_certain: keys of the n best scores; pairs: the n best pairs; xs: the n best keys with at
    most per_x values each; only: score 1; fill: `only`, but `pairs` instead if that leaves fewer than n keys."""
    best = [F.col("score").desc(), "x", "y"]
    if policy == "only":
        return examples.where("score = 1.0")
    if policy == "fill":
        sure = examples.where("score = 1.0")
        return sure if sure.select("x").distinct().count() >= n else policy_certain(examples, "pairs", n)
    if policy == "pairs":
        return examples.orderBy(*best).limit(n)
    keys = examples.groupBy("x").agg(F.max("score").alias("top")).orderBy(F.col("top").desc(), "x").limit(n).select("x")
    of_keys = examples.join(F.broadcast(keys), "x", "left_semi")
    if policy == "most_certain":
        return of_keys
    return of_keys.withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy(F.col("score").desc(), "y"))).where(F.col("i") <= per_x).drop("i")

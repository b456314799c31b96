"""Checking tables against examples, rating tables, scoring answers, pruning and feedback.

answers (mid, k, v): table mapping mid says k -> v.  examples (k, v, score).  tables (mid, prior, schema).
A mapping id is any comparable value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.99


def table_map(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """matches (tableid, x_col, y_col). (tableid, x_col, y_col, k, v, n): the pairs of the matched columns, by row. Only the
    cells of matched columns are made distinct and shuffled."""
    return row_values(cells, matches).groupBy("tableid", "x_col", "y_col", "k", "v").agg(F.count("*").alias("n"))


def row_values(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """(tableid, rowid, x_col, y_col, k, v): the rows of matched columns. matches should be a written table: its size then
    decides, when the plan is made and again while it runs, whether it is broadcast."""
    m = matches.select("tableid", "x_col", "y_col").distinct()
    wanted = m.select("tableid", F.explode(F.array("x_col", "y_col")).alias("colid")).distinct()
    c = cells.where("tokenized <> ''").select("tableid", "colid", "rowid", "tokenized").join(wanted, ["tableid", "colid"], "left_semi").distinct()
    x = c.withColumnsRenamed({"colid": "x_col", "tokenized": "k"}).join(m, ["tableid", "x_col"])
    return x.join(c.withColumnsRenamed({"colid": "y_col", "tokenized": "v"}), ["tableid", "rowid", "y_col"]).select("tableid", "rowid", "x_col", "y_col", "k", "v")


def answers(mapped: DataFrame) -> DataFrame:
    """(mid, k, v), mid = tableid:x_col:y_col."""
    return mapped.select(F.concat_ws(":", "tableid", "x_col", "y_col").alias("mid"), "k", "v").distinct()


def named(mids: DataFrame) -> DataFrame:
    """mids (mid). (mid, tableid, x_col, y_col): what a mapping id stands for."""
    p = F.split("mid", ":")
    return mids.select("mid", p[0].cast("long").alias("tableid"), p[1].cast("int").alias("x_col"), p[2].cast("int").alias("y_col"))


def accepted(found: DataFrame, examples: DataFrame, keys: DataFrame, least: int, quality: float | None = 0.3, new_keys: bool = False) -> DataFrame:
    """found (mid, k, v): what candidate tables say. The pairs of those that pass the assessment, for the input keys only
    unless new_keys."""
    out = found.join(assess(check(found, examples), least, quality).select("mid"), "mid", "left_semi")
    return (out if new_keys else out.join(keys.select("k").distinct(), "k", "left_semi")).select("mid", "k", "v")


def check(ans: DataFrame, examples: DataFrame, mode: str = "plain", known_bad: DataFrame | None = None) -> DataFrame:
    """(mid, k, good, bad, n_good) for the keys of a mapping that are examples. A known value is good by its score. Another
    value is bad by 1 (plain, functional) or neutral (nonfunctional), and by 1 more if it is among known_bad (k, v);
    bad_pairs() gives the contradictions themselves."""
    keys = examples.select("k").distinct()
    hit = ans.join(keys, "k", "left_semi").join(examples.select("k", "v", F.col("score").alias("s")), ["k", "v"], "left")
    bad = F.lit(0.0) if mode == "nonfunctional" else F.when(F.col("s").isNull(), 1.0).otherwise(0.0)
    if known_bad is not None:
        hit = hit.join(known_bad.select("k", "v").distinct().withColumn("known", F.lit(1.0)), ["k", "v"], "left")
        bad = bad + F.coalesce("known", F.lit(0.0))
    return hit.groupBy("mid", "k").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("good"), F.sum(bad).alias("bad"), F.count("s").alias("n_good"))


def bad_pairs(ans: DataFrame, examples: DataFrame) -> DataFrame:
    """(k, v): values that a mapping gives for a validated key against its example."""
    return ans.join(examples.select("k").distinct(), "k", "left_semi").join(examples.select("k", "v"), ["k", "v"], "left_anti").select("k", "v").distinct()


def check_fuzzy(ans: DataFrame, examples: DataFrame, forms: DataFrame, key_forms: DataFrame | None = None) -> DataFrame:
    """forms (v, form, sim), key_forms (k, form, sim): accepted spellings of the example values and keys. As check(); a
    spelling of the value is good by score x sim, under a spelling of the key by the key's sim as well."""
    spelled = examples.join(forms, "v").select("k", F.col("form").alias("v"), (F.col("score") * F.col("sim")).alias("score"))
    both = examples.select("k", "v", "score").unionByName(spelled)
    if key_forms is not None:
        both = both.unionByName(both.join(key_forms, "k").select(F.col("form").alias("k"), "v", (F.col("score") * F.col("sim")).alias("score")))
    return check(ans, both.groupBy("k", "v").agg(F.max("score").alias("score")))


def local_completeness(ans: DataFrame, examples: DataFrame) -> DataFrame:
    """(mid, k, present, absent): of each example key that the mapping has, the scores of its known values there and not."""
    held = ans.select("mid", "k").distinct().join(examples, "k")
    seen = held.join(ans.select("mid", "k", "v", F.lit(1).alias("there")), ["mid", "k", "v"], "left")
    return seen.groupBy("mid", "k").agg(F.sum(F.when(F.col("there") == 1, F.col("score")).otherwise(0.0)).alias("present"), F.sum(F.when(F.col("there").isNull(), F.col("score")).otherwise(0.0)).alias("absent"))


def assess(checked: DataFrame, least: int, quality: float | None = 0.3) -> DataFrame:
    """(mid, n_good, correctness) of the mappings with at least `least` good examples, of `quality` if that is given."""
    m = checked.groupBy("mid").agg(F.sum("n_good").alias("n_good"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
    m = m.withColumn("correctness", F.coalesce(F.try_divide(F.col("g"), F.col("g") + F.col("b")), F.lit(0.0)))
    # quality None: an open world, in which a contradiction says nothing
    return m.where((F.col("n_good") >= least) & (F.lit(True) if quality is None else F.col("correctness") >= quality)).select("mid", "n_good", "correctness")


def assess_weighted(checked: DataFrame, least: int, quality: float = 0.3, weighted: bool = True) -> DataFrame:
    """Correctness per key, averaged by weight good + bad (or 1); every good example counts once per good of its key."""
    w = F.col("good") + F.col("bad") if weighted else F.lit(1.0)
    per_key = checked.withColumn("c", F.coalesce(F.try_divide(F.col("good"), F.col("good") + F.col("bad")), F.lit(0.0))).withColumn("w", w)
    m = per_key.groupBy("mid").agg(F.sum(F.col("n_good") * F.col("n_good")).alias("n_good"), F.sum(F.col("c") * F.col("w")).alias("cw"), F.sum("w").alias("w"))
    m = m.withColumn("correctness", F.coalesce(F.try_divide("cw", "w"), F.lit(0.0)))
    return m.where((F.col("n_good") >= least) & (F.col("correctness") >= quality)).select("mid", "n_good", "correctness")


def assess_open(checked: DataFrame, complete: DataFrame | None, least: int, quality: float = 0.3) -> DataFrame:
    """The assessment in an open world, where a contradiction says nothing: by local completeness (mid, k, present, absent) if
    that is given, else by the number of good examples alone. (mid, n_good)."""
    m = checked.groupBy("mid").agg(F.sum(F.col("n_good") * F.col("n_good")).alias("n_good")).where(F.col("n_good") >= least)
    if complete is None:
        return m
    share = F.coalesce(F.try_divide(F.sum("present"), F.sum("present") + F.sum("absent")), F.lit(0.0))
    return m.join(complete.groupBy("mid").agg(share.alias("share")).where(F.col("share") >= quality).select("mid"), "mid", "left_semi")


def consolidate(old: DataFrame, new: DataFrame, bad: DataFrame) -> DataFrame:
    """All evidence, without the pairs known to be bad."""
    return old.unionByName(new).distinct().join(bad.select("k", "v").distinct(), ["k", "v"], "left_anti").select("mid", "k", "v")


def _evidence(ans: DataFrame, examples: DataFrame) -> DataFrame:
    """(mid, good, total, unseen): scores of the examples the mapping agrees with; its pairs of example keys; the scores
    of the example keys it lacks."""
    keys = examples.groupBy("k").agg(F.max("score").alias("top"))
    all_keys = F.broadcast(keys.agg(F.coalesce(F.sum("top"), F.lit(0.0)).alias("all_keys")))  # one row
    hit = ans.join(keys, "k").join(examples.select("k", "v", F.col("score").alias("s")), ["k", "v"], "left")
    per_key = hit.groupBy("mid", "k").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("good"), F.count("*").alias("n"), F.max("top").alias("top"))
    per = per_key.groupBy("mid").agg(F.sum("good").alias("good"), F.sum("n").cast("double").alias("total"), F.sum("top").alias("seen"))
    return per.crossJoin(all_keys).select("mid", "good", "total", (F.col("all_keys") - F.col("seen")).alias("unseen"))


def rating(ans: DataFrame, examples: DataFrame, tables: DataFrame, weight: float = 1.0) -> DataFrame:
    """(mid, rating): instance evidence with the prior for unseen examples, and the schema score by weight."""
    e = _evidence(ans, examples).join(tables, "mid")
    inst = F.coalesce(F.try_divide((F.col("good") + F.col("prior") * F.col("unseen")) * ALPHA, F.col("total") + F.col("unseen")), F.lit(0.0))
    return e.select("mid", ((inst + F.col("schema") * weight) / (1 + weight)).alias("rating"))


def rating_indirect(ans: DataFrame, examples: DataFrame, tables: DataFrame, bad: DataFrame) -> DataFrame:
    """The instance part alone, with 10 in the denominator for each bad pair of the mapping."""
    n_bad = ans.join(bad.select("k", "v").distinct(), ["k", "v"]).groupBy("mid").agg(F.count("*").alias("n_bad"))
    e = _evidence(ans, examples).join(tables, "mid").join(n_bad, "mid", "left")
    inst = F.try_divide((F.col("good") + F.col("prior") * F.col("unseen")) * ALPHA, F.col("total") + F.col("unseen") + 10 * F.coalesce("n_bad", F.lit(0)))
    return e.select("mid", F.coalesce(inst, F.lit(0.0)).alias("rating"))


def rating_sets(ans: DataFrame, examples: DataFrame, tables: DataFrame, bad: DataFrame, prior_mode: str = "as_written") -> DataFrame:
    """tables (mid, prior, context): context is the tf-idf weight of the example terms around the table. Bad pairs count
    twice against the rating, and a rating of 0 or less drops the mapping. prior_mode: as_written, or sigmoid."""
    factor = 1 + F.exp(-0.1 * F.col("context")) if prior_mode == "as_written" else 1 / (1 + F.exp(-0.1 * F.col("context")))
    n_bad = ans.join(bad.select("k", "v").distinct(), ["k", "v"]).groupBy("mid").agg(F.count("*").alias("n_bad"))
    e = _evidence(ans, examples).join(tables, "mid").join(n_bad, "mid", "left").withColumn("p", F.least(F.col("prior") * factor, F.lit(1.0)))
    r = F.try_divide((F.col("p") * F.col("good") - (1 - F.col("p")) * 2 * F.coalesce("n_bad", F.lit(0))) * ALPHA, F.col("total") + (1 - F.col("p")) * F.col("unseen"))
    return e.select("mid", F.coalesce(r, F.lit(0.0)).alias("rating")).where("rating > 0")


def rating_pruned(ans: DataFrame, good: DataFrame, bad: DataFrame, tables: DataFrame) -> DataFrame:
    """(mid, rating) from validated examples only; mappings with a negative rating are pruned."""
    g = ans.join(good.select("k", "v").distinct(), ["k", "v"]).groupBy("mid").agg(F.count("*").alias("g"))
    b = ans.join(bad.select("k", "v").distinct(), ["k", "v"]).groupBy("mid").agg(F.count("*").alias("b"))
    e = tables.join(g, "mid", "left").join(b, "mid", "left").na.fill(0, ["g", "b"])
    r = F.try_divide((F.col("prior") * F.col("g") - (1 - F.col("prior")) * 2 * F.col("b")) * ALPHA, F.col("g") + F.col("b"))
    return e.select("mid", F.coalesce(r, F.lit(0.0)).alias("rating")).where("rating >= 0")


def score_functional(ans: DataFrame, ratings: DataFrame) -> DataFrame:
    """(k, v, score): over the tables T of k, s(v) is the product of r for tables saying v and 1 - r for the others,
    divided by the sum over all values of k and over "none of them".

    Divided by the product of all 1 - r, s(v) is the product of the odds r / (1 - r) of the tables saying v, and "none" is 1:
    no value has to be met with the tables that don't say it. Odds are added as logarithms, less the greatest of the key, so
    that no number of tables runs out of range; tables of rating 0 and 1 are counted apart."""
    r = F.col("rating")
    a = ans.select("mid", "k", "v").distinct().join(ratings, "mid")
    odds = F.sum(F.when((r > 0) & (r < 1), F.log(r / (1 - r))).otherwise(0.0))
    # ratings stay below 1 (ALPHA): the sets are empty but for ratings given from outside
    s = a.groupBy("k", "v").agg(odds.alias("l"), F.count_if(r <= 0).alias("zeros"), F.collect_set(F.when(r >= 1, F.col("mid"))).alias("ones"))
    of = Window.partitionBy("k")
    s = s.withColumn("all_ones", F.size(F.array_distinct(F.flatten(F.collect_list("ones").over(of)))))
    s = s.withColumn("l", F.when((F.col("zeros") == 0) & (F.size("ones") == F.col("all_ones")), F.col("l")))
    s = s.withColumn("top", F.greatest(F.max("l").over(of), F.when(F.col("all_ones") == 0, 0.0)))
    s = s.withColumn("w", F.coalesce(F.exp(F.col("l") - F.col("top")), F.lit(0.0)))
    none = F.when(F.col("all_ones") == 0, F.exp(-F.col("top"))).otherwise(0.0)
    return s.select("k", "v", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(of) + none), F.lit(0.0)).alias("score"))


def score_noisy_or(ans: DataFrame, ratings: DataFrame) -> DataFrame:
    return ans.join(ratings, "mid").groupBy("k", "v").agg((1 - F.product(1 - F.col("rating"))).alias("score"))


def score_majority(ans: DataFrame) -> DataFrame:
    """The value most tables say gets 0.5 + n / 2 / tables of the key, the others 0; ties go to the smaller value."""
    n = ans.groupBy("k", "v").agg(F.count_distinct("mid").alias("n"))
    all_ = ans.groupBy("k").agg(F.count_distinct("mid").alias("all_n"))
    i = F.row_number().over(Window.partitionBy("k").orderBy(F.col("n").desc(), "v"))
    return n.withColumn("i", i).join(all_, "k").select("k", "v", F.when(F.col("i") == 1, 0.5 + F.col("n") * 0.5 / F.col("all_n")).otherwise(0.0).alias("score"))


def best_per_key(scored: DataFrame) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("k").orderBy(F.round("score", 9).desc(), "v"))
    return scored.withColumn("i", i).where("i = 1").select("k", "v", "score")


def transform(keys: DataFrame, scored: DataFrame) -> DataFrame:
    """(k, v, score) for every input key: its best value, or null and 0."""
    return keys.select("k").distinct().join(best_per_key(scored), "k", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def prune_dangling(ans: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence without the removed mappings, and the (k, v) left without any support: new bad examples."""
    left = ans.join(removed.select("mid").distinct(), "mid", "left_anti")
    return left, ans.select("k", "v").distinct().join(left.select("k", "v").distinct(), ["k", "v"], "left_anti")


def prune_bad_only(ans: DataFrame, bad: DataFrame, more_than: int = 3) -> DataFrame:
    """Evidence without the answers that only mappings with more than `more_than` bad pairs support."""
    worse = ans.join(bad.select("k", "v").distinct(), ["k", "v"]).groupBy("mid").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("mid", F.lit(True).alias("worse"))
    marked = ans.join(worse, "mid", "left").withColumn("worse", F.coalesce("worse", F.lit(False)))
    kept = marked.groupBy("k", "v").agg(F.bool_and("worse").alias("only_bad")).where("not only_bad").select("k", "v")
    return ans.join(kept, ["k", "v"], "left_semi").select("mid", "k", "v")


def feedback(ans: DataFrame, examples: DataFrame, good: DataFrame, bad: DataFrame, query_mid: str) -> tuple[DataFrame, DataFrame]:
    """Validated pairs get score 1 and the query table as evidence; rejected ones leave the evidence and the examples."""
    e = examples.join(good.select("k", "v"), ["k", "v"], "left_anti").join(bad.select("k", "v"), ["k", "v"], "left_anti").select("k", "v", "score")
    e = e.unionByName(good.select("k", "v", F.lit(1.0).alias("score")).distinct())
    a = ans.join(bad.select("k", "v"), ["k", "v"], "left_anti").select("mid", "k", "v")
    return a.unionByName(good.select(F.lit(query_mid).alias("mid"), "k", "v")).distinct(), e


def boost(tables: DataFrame, used: DataFrame) -> DataFrame:
    """tables (mid, prior), used (mid): a prior grows by (1 - prior) x share of the uses x ALPHA."""
    n = used.groupBy("mid").agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("all_n")))  # one row
    return tables.join(n, "mid", "left").crossJoin(total).select("mid", (F.col("prior") + (1 - F.col("prior")) * F.coalesce("n", F.lit(0)) * ALPHA / F.col("all_n")).alias("prior"))


def best_table(ans: DataFrame, ratings: DataFrame) -> DataFrame:
    """(k, v, mid): the best rated mapping that says so, with a rating above 0; ties go to the smaller id."""
    a = ans.join(ratings.where("rating > 0"), "mid")
    i = F.row_number().over(Window.partitionBy("k", "v").orderBy(F.col("rating").desc(), "mid"))
    return a.withColumn("i", i).where("i = 1").select("k", "v", "mid")


def top_tables(ratings: DataFrame, n: int = 32, query_mid: str = "query") -> DataFrame:
    return ratings.where((F.col("rating") != 0.0) & (F.col("mid") != query_mid)).orderBy(F.col("rating").desc(), "mid").limit(n)


def similar_examples(ans: DataFrame, examples: DataFrame, edits: int = 23) -> DataFrame:
    """(mid, k, v): pairs of mappings that resemble an example: one contains the other, within `edits` edits, on both
    sides. Candidates are found by equality: the shorter key is a piece of the longer one, at most `edits` shorter, so the
    pieces of the (few) example keys meet the keys, and the keys' pieces of an example's length meet the example keys."""
    from tabweave.operators.search import small

    def pieces(c: str, least, most):
        return F.expr(f"flatten(transform(sequence({least}, {most}), g -> transform(sequence(1, length({c}) - g + 1), i -> substr({c}, i, g))))")

    e = examples.select(F.col("k").alias("ek"), F.col("v").alias("ev")).distinct()
    keys = ans.select("k").distinct()
    inside = e.select("ek", F.explode(F.array_distinct(pieces("ek", f"greatest(1, length(ek) - {edits})", "length(ek)"))).alias("k")).where("ek <> ''")
    within = keys.join(small(inside), "k").select("k", "ek")
    sizes = e.select(F.length("ek").alias("g"), F.col("ek")).where("ek <> ''").distinct()
    own = keys.withColumn("g", F.explode(F.sequence(F.greatest(F.lit(1), F.length("k") - edits), F.greatest(F.lit(1), F.length("k"))))).join(small(sizes.select("g").distinct()), "g", "left_semi")
    own = own.select("k", F.explode(F.array_distinct(F.expr("transform(sequence(1, greatest(1, length(k) - g + 1)), i -> substr(k, i, g))"))).alias("ek"))
    around = own.join(small(sizes.select("ek")), "ek").select("k", "ek")
    near = within.unionByName(around).distinct().where(F.levenshtein("k", "ek") <= edits).join(small(e), "ek")
    hit = ans.join(near, "k")
    v, ev = F.col("v"), F.col("ev")
    return hit.where((v.contains(ev) | ev.contains(v)) & (F.levenshtein("v", "ev") <= edits)).select("mid", "k", "v").distinct()


def schema_match(pairs: DataFrame) -> DataFrame:
    """pairs (mid, x_header, y_header, x_wanted, y_wanted), token forms. Mean similarity of the two, each below 0.5 as 0;
    0.5 without headers."""
    from tabweave.functions.text import similarity

    def one(a: str, b: str):
        s = similarity(F.col(a), F.col(b))
        return F.when(s < 0.5, 0.0).otherwise(s)

    none = F.col("x_header").isNull() & F.col("y_header").isNull()
    return pairs.select("mid", F.when(none, 0.5).otherwise((one("x_header", "x_wanted") + one("y_header", "y_wanted")) / 2).alias("schema"))


def select_pairs(ans: DataFrame, scored: DataFrame, policy: str, n: int, validated: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """(k, v): pairs to be validated next, none that is in validated (k, v). Ties go to the smaller pair.

    x_max           all pairs of the n keys with the most tables
    xy_max, xy_min  the pairs with the most or fewest tables;  xy_min_score: with the lowest score
    max_cover       greedily the pair that adds most tables to those covered; it goes on when none is left to cover
    min_overlap     greedily the pair with the fewest tables covered so far, of these the one with the fewest tables
    clustering      per key, the values below the first gap: with scores s1 >= s2 >= .., value i stays if m x s_m is above
                    s1 + .. + s_(m-1) for all m < i
    oracle_bad      the pairs with the most tables that are not in truth (k, v)

    Rankings are one aggregation; a greedy policy takes n rounds of one aggregation each."""
    done = validated.select("k", "v").distinct() if validated is not None else None
    free = (lambda df: df.join(done, ["k", "v"], "left_anti")) if done is not None else (lambda df: df)
    if policy == "clustering":
        w = Window.partitionBy("k").orderBy(F.col("score").desc(), "v")
        s = scored.withColumn("m", F.row_number().over(w)).withColumn("p", F.sum("score").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        s = s.withColumn("on", F.round(F.col("m") * F.col("score"), 9) > F.round(F.coalesce("p", F.lit(0.0)), 9))
        s = s.withColumn("good", F.coalesce(F.bool_and("on").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        return free(s.where("not good").select("k", "v"))
    if policy == "x_max":
        of = ans.join(done.select("k").distinct(), "k", "left_anti") if done is not None else ans
        top = of.groupBy("k").agg(F.count_distinct("mid").alias("n")).orderBy(F.col("n").desc(), "k").limit(n).select("k")
        return ans.join(top, "k", "left_semi").select("k", "v").distinct()
    if policy == "xy_min_score":
        return free(scored).orderBy(F.round("score", 9), "k", "v").limit(n).select("k", "v")
    sizes = free(ans.groupBy("k", "v").agg(F.count_distinct("mid").alias("n")))
    if policy == "oracle_bad":
        sizes = sizes.join(truth.select("k", "v").distinct(), ["k", "v"], "left_anti")
    if policy in ("xy_max", "xy_min", "oracle_bad"):
        return sizes.orderBy(F.col("n") if policy == "xy_min" else F.col("n").desc(), "k", "v").limit(n).select("k", "v")
    if policy not in ("max_cover", "min_overlap"):
        raise ValueError(policy)
    pair_schema, chosen = "k string, v string", []
    spark = ans.sparkSession
    for _ in range(n):
        picked = spark.createDataFrame(chosen, pair_schema)  # fewer than n rows
        covered = ans.join(F.broadcast(picked), ["k", "v"], "left_semi").select("mid", F.lit(1).alias("c")).distinct()
        c = ans.select("mid", "k", "v").distinct().join(covered, "mid", "left").groupBy("k", "v").agg(F.count("c").alias("old"), F.count("*").alias("all"))
        order = [(F.col("all") - F.col("old")).desc()] if policy == "max_cover" else [F.col("old"), F.col("all")]
        r = free(c).join(F.broadcast(picked), ["k", "v"], "left_anti").orderBy(*order, "k", "v").limit(1).collect()
        if not r:
            break
        chosen.append((r[0]["k"], r[0]["v"]))
    return spark.createDataFrame(chosen, pair_schema)

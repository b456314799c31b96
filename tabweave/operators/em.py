"""The iteration: ratings from examples, answer scores from ratings, until they no longer change.

The loop is the only place here that calls an action. Each round is written to the shared folder, which cuts the lineage
and survives the loss of executors; the driver sees two numbers per round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators import score, search
from tabweave.plans.common import written


def step(ans: DataFrame, examples: DataFrame, tables: DataFrame, fixed: DataFrame, method: str = "functional") -> tuple[DataFrame, DataFrame]:
    """One M- and E-step: (ratings, examples of the next round). fixed (k, v, score) are the user's own examples."""
    ratings = score.rating(ans, examples, tables)
    scored = {"functional": score.score_functional, "noisy_or": score.score_noisy_or}[method](ans, ratings) if method != "majority" else score.score_majority(ans)
    found = score.best_per_key(scored) if method != "noisy_or" else scored
    found = found.join(fixed.select("k").distinct(), "k", "left_anti")
    return ratings, fixed.select("k", "v", "score").unionByName(found.select("k", "v", "score"))


def rounds(ans: DataFrame, fixed: DataFrame, tables: DataFrame, n: int, method: str = "functional") -> tuple[DataFrame, DataFrame]:
    """n rounds. The examples of each are written: as one plan, a round would repeat all earlier ones."""
    examples = ratings = fixed.select("k", "v", "score")
    for _ in range(n):
        ratings, examples = step(ans, examples, tables, fixed, method)
        examples = written(examples, "examples")
    return ratings, examples


def run(ans: DataFrame, fixed: DataFrame, tables: DataFrame, most: int = 100, eps: float = 1e-5, method: str = "functional") -> tuple[DataFrame, DataFrame, int]:
    """Rounds until the scores change by less than eps in sum."""
    ans, tables = written(ans, "answers"), written(tables, "tables")
    examples = ratings = fixed.select("k", "v", "score")
    for i in range(1, most + 1):
        ratings, new = step(ans, examples, tables, fixed, method)
        new = written(new, "examples")
        both = new.join(examples.withColumnRenamed("score", "old"), ["k", "v"], "full")
        change = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        examples = new
        if change < eps:
            return ratings, examples, i
    return ratings, examples, most


@dataclass
class Induced:
    """The state of the loop: accepted evidence, ratings, examples with the answers found, rounds, and whether it settled."""

    evidence: DataFrame
    ratings: DataFrame
    examples: DataFrame
    rounds: int
    settled: bool


def induce(cells: DataFrame, keys: DataFrame, fixed: DataFrame, tables_of: Callable[[DataFrame], DataFrame], least: int = 2, quality: float | None = 0.3, searches: int = 3, most: int = 100, asked: int = 50, eps: float = 1e-5, method: str = "functional", new_keys: bool = False, by_token: DataFrame | None = None) -> Induced:
    """The inductive loop. cells: the corpus without the query table, best in the layout sorted by table; by_token: the same
    cells sorted by token, for the searches, if there is such a copy; keys (k): the input; fixed (k, v, score): the user's
    examples; tables_of(evidence): (mid, prior, schema) of its tables.

    Each round searches for tables with the `asked` best examples known so far (the user's and the answers found), leaves
    out tables seen before, accepts those that pass the assessment against the user's examples, adds what they say of the
    input keys to the evidence, rates all tables and scores all answers. Searching stops after `searches` rounds or when a
    search brings no new key; the loop ends when the scores then settle, or after `most` rounds.
    """
    spark = cells.sparkSession
    evidence = spark.createDataFrame([], "mid string, k string, v string")
    seen = spark.createDataFrame([], "tableid long, x_col int, y_col int")
    examples = ratings = fixed.select("k", "v", "score")
    n_keys, searching, tables = 0, True, None
    for i in range(1, most + 1):
        if searching:
            e = search.policy_certain(examples.select(F.col("k").alias("x"), F.col("v").alias("y"), "score"), "pairs", asked).collect()  # `asked` rows at most
            found = search.find_tables(cells if by_token is None else by_token, [r["x"] for r in e], [r["y"] for r in e], least)
            found = written(found.join(seen, ["tableid", "x_col", "y_col"], "left_anti"), "found")
            seen = seen.unionByName(found)
            said = written(score.answers(score.table_map(cells, found)), "said")
            evidence = written(evidence.unionByName(score.accepted(said, fixed, keys, least, quality, new_keys)).distinct(), "evidence")
            tables = tables_of(evidence)
            if searching := i < searches:
                n = evidence.select("k").distinct().count()
                searching, n_keys = n > n_keys, n
            if not searching and i < most:
                tables = written(tables, "tables")  # all further rounds read them
        ratings, new = step(evidence, examples, tables, fixed, method)
        new = written(new, "examples")
        if not searching and i < most:
            both = new.join(examples.withColumnRenamed("score", "old"), ["k", "v"], "full")
            change = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
            if change < eps:
                return Induced(evidence, ratings, new, i, True)
        examples = new
    return Induced(evidence, ratings, examples, most, False)


#: Pseudo-counts of the latent truth model: true claims said and not said, false claims said and not said.
TRUE_SAID, TRUE_SILENT, FALSE_SAID, FALSE_SILENT = 50.0, 50.0, 10.0, 1000.0


def latent_truth(ans: DataFrame, rounds: int = 20, eps: float = 1e-6) -> DataFrame:
    """(k, v, truth): the probability of each claim under the latent truth model. A mapping that has a key speaks on each
    value claimed for that key: it says it or is silent. Every mapping has a sensitivity (it says what is true) and a false
    positive rate, with beta priors. Expectation and maximisation alternate over all mappings and claims, from the share of
    the mappings that say a value, until no truth changes by eps or for `rounds` rounds; both steps are aggregations, so that
    counts are those of the whole evidence, whatever its size."""
    a = ans.select("mid", "k", "v").distinct()
    speakers, values = a.select("mid", "k").distinct(), a.select("k", "v").distinct()
    claims = written(values.join(speakers, "k").join(a.withColumn("said", F.lit(1)), ["mid", "k", "v"], "left").select("mid", "k", "v", F.coalesce("said", F.lit(0)).alias("said")), "claims")
    p = written(claims.groupBy("k", "v").agg(F.avg("said").alias("truth")), "truth")
    said, t = F.col("said") == 1, F.col("truth")
    for _ in range(rounds):
        both = claims.join(p, ["k", "v"])
        part = lambda of, when: F.sum(F.when(when, of).otherwise(0.0))
        n = both.groupBy("mid").agg(part(t, said).alias("tp"), part(t, ~said).alias("fn"), part(1 - t, said).alias("fp"), part(1 - t, ~said).alias("tn"))
        n = n.select("mid", ((F.col("tp") + TRUE_SAID) / (F.col("tp") + F.col("fn") + TRUE_SAID + TRUE_SILENT)).alias("sens"), ((F.col("fp") + FALSE_SAID) / (F.col("fp") + F.col("tn") + FALSE_SAID + FALSE_SILENT)).alias("fpr"))
        weight = F.when(said, F.log(F.col("sens") / F.col("fpr"))).otherwise(F.log((1 - F.col("sens")) / (1 - F.col("fpr"))))
        odds = claims.join(n, "mid").groupBy("k", "v").agg(F.sum(weight).alias("o"))
        new = written(odds.select("k", "v", (1 / (1 + F.exp(-F.col("o")))).alias("truth")), "truth")
        change = new.join(p.withColumnRenamed("truth", "old"), ["k", "v"]).agg(F.max(F.abs(F.col("truth") - F.col("old")))).first()[0] or 0.0
        p = new
        if change < eps:
            break
    return p

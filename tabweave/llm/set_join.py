"""All pairs of set-valued records whose sets overlap strongly: a prefix-filtered similarity join.

1. Sets. A record's values are made distinct; records with equal sets form one class, and only one representative of a
   class takes part in the join. Classes are found by size and 128 bits of hashes combined without order, and verified:
   every value of a class must be held by all its records; records of a class that fails stand for themselves.
2. Order. Values are ordered by rarity (number of sets holding them), ties by hash and text. A value's position in its
   set is its rank in that order. A large set is not ranked in one task: its values are salted by (rarity, leading bits
   of the hash), which follows the order, and the sizes of all earlier salts are added to the rank inside the salt.
3. Prefixes. Two sets with a Jaccard similarity of at least t share a value among the first n - ceil(t n) + 1 values of
   each. Only prefixes are joined, on (value, size band); bands of ratio 1 / t keep apart sets that the length filter
   would drop. The length and the positional filter are part of the join condition.
4. Verification. The distinct candidate pairs are joined with the sets on both sides and the overlap is counted exactly.

Prefix values that many sets share, sets with many candidates and classes of many records are heavy keys of their joins:
they are split into shards in proportion to their load, and the other side is copied to those shards only.

pairs() expands classes to records; membership() gives the form without the expansion.

Defined cases: null and empty values are in no set; sets smaller than min_size have no partner; repeated rows count
once; a record has no pair with itself. Equal sets are similar. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.skew import salted_join, with_group_size
from tabweave.plans.common import written

LARGE = 1 << 14


def classes(sets: DataFrame, min_size: int) -> DataFrame:
    """sets (r, v), distinct. (r, n, c) of each record of at least min_size values; c: the smallest record with an equal set."""
    hashes = F.hex(F.bit_xor(F.xxhash64("v"))), F.hex(F.bit_xor(F.xxhash64(F.lit(7), "v")))
    prints = written(sets.groupBy("r").agg(F.count("*").alias("n"), F.concat_ws("-", F.count("*"), *hashes).alias("h")).where(F.col("n") >= min_size), "prints")
    first = prints.groupBy("h").agg(F.min("r").alias("c"), F.count("*").alias("k"))
    known = written(salted_join(prints, first, "h", "inner", ["r"]).select("r", "n", "c", "k"), "classes")
    held = sets.join(known.where("k > 1").select("r", "c", "k"), "r").groupBy("c", "v").agg(F.count("*").alias("m"), F.max("k").alias("k"))
    wrong = held.where("m <> k").select("c").distinct()  # a collision of hashes: hardly ever any
    return known.join(wrong.withColumn("wrong", F.lit(True)), "c", "left").select("r", "n", F.when(F.col("wrong"), F.col("r")).otherwise(F.col("c")).alias("c"))


def _band(n: Column, t: float) -> Column:
    return F.floor(F.log(n) / math.log(1 / t) + 1e-9).cast("int")


def positions(rows: DataFrame) -> DataFrame:
    """rows (r, n, v, f): p, the rank of v in its set by (f, hash, v), from 1."""
    h = F.xxhash64("v")
    small = rows.where(F.col("n") <= LARGE).withColumn("p", F.row_number().over(Window.partitionBy("r").orderBy("f", h, "v")))
    big = rows.where(F.col("n") > LARGE).withColumn("salt", F.struct("f", F.shiftright(h, 54).alias("s")))
    sizes = big.groupBy("r", "salt").agg(F.count("*").alias("k"))
    before = (F.sum("k").over(Window.partitionBy("r").orderBy("salt")) - F.col("k")).alias("before")
    inside = F.row_number().over(Window.partitionBy("r", "salt").orderBy(h, "v"))
    big = big.join(sizes.select("r", "salt", before), ["r", "salt"]).withColumn("p", (F.col("before") + inside).cast("int"))
    return small.unionByName(big.select(*small.columns))


def links(sets: DataFrame, known: DataFrame, t: float) -> DataFrame:
    """(x, y, overlap): pairs of class representatives, x the smaller set (or of equal size and the smaller record)."""
    rows = written(sets.join(known.where("r = c").select("r", "n"), "r"), "sets")
    ranked = written(positions(with_group_size(rows, "v", "f")).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1), "prefixes")
    own = _band(F.col("n"), t)
    a = ranked.select("v", F.col("r").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.explode(F.array(own, own + 1)).alias("band")).withColumn("key", F.xxhash64("v", "band"))
    b = ranked.select(F.col("v").alias("w"), F.col("r").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), own.alias("b")).withColumn("key", F.xxhash64("w", "b"))
    need = F.ceil((F.col("nx") + F.col("ny")) * (t / (1 + t)) - 1e-9)
    near = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    length = F.col("nx") >= F.col("ny") * t - 1e-9
    position = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= need
    met = salted_join(a, b, "key", "inner", ["x"]).where((F.col("v") == F.col("w")) & near & length & position)
    candidates = written(met.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny")), "candidates")
    left, right = rows.select(F.col("r").alias("x"), "v"), rows.select(F.col("r").alias("y"), "v")
    shared = salted_join(candidates, left, "x", "inner", ["y"]).join(right, ["y", "v"]).groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("overlap"))
    return shared.where(F.col("overlap") >= (F.col("nx") + F.col("ny") - F.col("overlap")) * t - 1e-9).select("x", "y", "overlap")


def pairs(sets: DataFrame, t: float, min_size: int) -> DataFrame:
    """(a, b), a < b: all pairs of records with a Jaccard similarity of at least t. sets: (r, v), r comparable."""
    sets = written(sets.where("v <> ''").distinct(), "values")
    known = written(classes(sets, min_size), "known")
    found = written(links(sets, known, t), "links")
    a, b = known.select("c", F.col("r").alias("a")), known.select("c", F.col("r").alias("b"))
    half = written(salted_join(found.select(F.col("x").alias("c"), "y"), a, "c", "inner", ["y"]).select("a", F.col("y").alias("c")), "half")
    across = salted_join(half, b, "c", "inner", ["a"]).select("a", "b")
    within = salted_join(a, b, "c", "inner", ["a"]).where("a < b").select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)


def membership(sets: DataFrame, t: float, min_size: int) -> DataFrame:
    """(r, class, n_links): each record with its class of equal sets and the number of other classes linked to that class."""
    sets = written(sets.where("v <> ''").distinct(), "values")
    known = written(classes(sets, min_size), "known")
    found = written(links(sets, known, t), "links")
    n = found.select(F.explode(F.array("x", "y")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return salted_join(known.withColumnRenamed("c", "class"), n, "class", "left", ["r"]).select("r", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))

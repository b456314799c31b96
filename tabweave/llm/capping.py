"""Capping records per dominant contributor, the best by quality kept.

Ranks are exact and no contributor, however large, is ranked in one task. The salt of a record is the range it falls into
when all records are cut by (contributor, quality, id) into as many ranges of about equal size as there are tasks: salts
follow the ranking order for any values. A record's rank is its pre-rank inside (contributor, salt) plus the sizes of the
contributor's better salts, of which there are at most as many as tasks. Only a salt that the cap cuts through is ranked.

Defined cases: exact repeats of a row count once; a record whose id is null is ignored; null or negative openrank counts
as 0, null or NaN confidence as 0; ties go to the smaller id. A record with neither domain nor a host in its url belongs
to the contributor "" (one like any other). If rows of one id differ, the best of them stands for the id under each of
its contributors. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.plans.common import parallelism, written


def contributor(domain: Column, url: Column) -> Column:
    """The domain, or the host of the url: trimmed, lower case, without dots at the end, then without one 'www.'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    given = F.when(F.length(F.regexp_replace(F.coalesce(domain, F.lit("")), r"[\s\p{Z}]+", "")) > 0, domain).otherwise(host)
    lower = F.lower(F.regexp_replace(given, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.regexp_replace(F.regexp_replace(lower, r"\.+$", ""), r"^www\.", "")


def ranked(df: DataFrame, share: float | None = None, most: int | None = None) -> DataFrame:
    """(id, contributor, over): over says that the id's rank is beyond the cap, ceil(share x distinct ids) or most."""
    openrank = F.greatest(F.coalesce(F.nanvl(F.col("openrank").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    confidence = F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.where("id is not null").select(F.col("id").cast("long").alias("id"), contributor(F.col("domain"), F.col("url")).alias("contributor"), F.struct(openrank.alias("o"), confidence.alias("c")).alias("q"))
    one = rows.groupBy("id", "contributor").agg(F.max("q").alias("q")).select("id", "contributor", "q.o", "q.c")
    best = (F.col("o").desc(), F.col("c").desc(), F.col("id"))
    ranges = one.repartitionByRange(parallelism(df.sparkSession), F.col("contributor"), *best)
    one = written(ranges.withColumn("salt", F.spark_partition_id()), "ranges")
    if most is None:
        n_ids = one.select("id").distinct().count()
        most = math.ceil(Fraction(str(share)) * n_ids)
    sizes = one.groupBy("contributor", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("contributor").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = sizes.withColumn("before", before)
    # whole salts under or over the cap need no rank; those the cap cuts through (one per contributor) do
    kind = F.when(F.col("before") + F.col("n") <= most, 0).when(F.col("before") >= most, 2).otherwise(1)
    placed = one.join(sizes.select("contributor", "salt", "before", kind.alias("kind")), ["contributor", "salt"])
    pre = F.row_number().over(Window.partitionBy("contributor", "salt").orderBy(*best))
    whole = placed.where("kind <> 1").select("id", "contributor", (F.col("kind") == 2).alias("over"))
    cut = placed.where("kind = 1").withColumn("pre", pre).select("id", "contributor", (F.col("before") + F.col("pre") > most).alias("over"))
    return whole.unionByName(cut)


def dropped(df: DataFrame, share: float | None = None, most: int | None = None) -> DataFrame:
    """(id) of the records beyond their contributor's cap."""
    return ranked(df, share, most).where("over").select("id").distinct()


def kept(df: DataFrame, share: float | None = None, most: int | None = None) -> DataFrame:
    """df without the records beyond their contributor's cap."""
    return df.join(dropped(df, share, most), "id", "left_anti")

"""Occurrences and record counts of every value, kept up to date by signed deltas.

The state is a folder, and is opened again from it:

    manifest/   one JSON file per version: bucket -> folder of its counts, numbers of buckets and values
    terms/      (field, value) -> occurrences, records; partitioned by bucket, a hash of the value

apply() reads only added, changed and deleted records: a record that came is added, one that went is removed, a changed one
is removed as it was and added as it is. Each side is aggregated to one occurrence and one record count per value; the
signed sums are merged into the buckets they touch, all other buckets are carried over by reference, and a new version of
the manifest is written last. changes() finds the changed records of two snapshots; whole() turns added and removed cells
of known records into old and new records.

Records are aggregated where they are: one exchange by record serves the removal of repeats and the counts per (value,
record). Records that hold more than a quarter of a task's share are split by value instead. The number of buckets follows
the number of tasks, and is doubled when buckets hold more than PER_BUCKET values.

Defined cases: exact repeats of an added or removed row count once; a null value has no count, the empty string is a value;
rows without a record are ignored; a value whose occurrences fall to 0 leaves the state; removing what was never added
raises ValueError and leaves the state as it was. An empty delta changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabweave.plans.common import parallelism

PER_BUCKET = 4_000_000
_TERMS = "field string, value string, occurrences long, records long"


def counted(cells: DataFrame, record: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, value, occurrences, records) of whole records; cells may repeat rows."""
    spark = cells.sparkSession
    rows = cells.where(F.col(record).isNotNull())
    loads = rows.groupBy(record).agg(F.count("*").alias("n"))
    total = loads.agg(F.sum("n")).first()[0] or 0
    heavy = loads.where(F.col("n") > max(1.0, total / parallelism(spark) / 4)).select(F.col(record).alias("__tw_r"))  # fewer than 4 per task
    light = rows.join(F.broadcast(heavy), rows[record] == F.col("__tw_r"), "left_anti").repartition(record)
    large = rows.join(F.broadcast(heavy), rows[record] == F.col("__tw_r"), "left_semi")

    def pairs(df: DataFrame) -> DataFrame:
        values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
        one = df.distinct().select(F.col(record).cast("long").alias("record"), values.alias("x")).where("x.value is not null")
        return one.groupBy("record", "x.field", "x.value").agg(F.count("*").alias("n"))

    both = pairs(light).unionByName(pairs(large))
    return both.groupBy("field", "value").agg(F.sum("n").alias("occurrences"), F.count("*").alias("records"))


def changes(old: DataFrame, new: DataFrame, record: str = "tableid") -> tuple[DataFrame, DataFrame]:
    """(added, removed): the new and old cells of the records that differ between two snapshots with the same columns."""

    def prints(df: DataFrame) -> DataFrame:
        rows = df.distinct()
        h = [F.bit_xor(F.xxhash64(F.lit(i), *(F.struct(F.col(c)) for c in df.columns))).alias(f"h{i}") for i in (1, 2)]
        return rows.groupBy(record).agg(F.count("*").alias("n"), *h)

    a, b = prints(old).alias("a"), prints(new).alias("b")
    same = a.join(b, F.expr(f"a.{record} = b.{record} and a.n = b.n and a.h1 = b.h1 and a.h2 = b.h2")).select(F.col(f"a.{record}").alias(record))
    return new.join(same, record, "left_anti"), old.join(same, record, "left_anti")


def whole(held: DataFrame, added: DataFrame, removed: DataFrame, record: str = "tableid") -> tuple[DataFrame, DataFrame]:
    """(added, removed) of apply() for cells that come and go in records whose other cells (held) stay."""
    touched = added.select(record).union(removed.select(record)).distinct()
    old = held.select(*added.columns).join(touched, record, "left_semi").select(*added.columns).distinct()
    return old.union(added).subtract(removed), old


class TermCounts:
    """The state under root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 0):
        self.spark, self.root = spark, root.rstrip("/")
        self.version, self.n_terms, self.buckets = 0, 0, buckets or parallelism(spark)
        self.folders: dict[int, str] = {}
        fs, at = self._manifest()
        names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if names:
            stream = fs.open(self._path(f"manifest/{names[-1]}"))
            m = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.version, self.n_terms, self.buckets = m["version"], m["n_terms"], m["n_buckets"]
            self.folders = {int(b): f for b, f in m["folders"].items()}

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _manifest(self):
        at = self._path("manifest")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _publish(self) -> None:
        """Writes the manifest of this version beside the older ones; it counts once it has its name."""
        fs, _ = self._manifest()
        m = {"version": self.version, "n_terms": self.n_terms, "n_buckets": self.buckets, "folders": self.folders}
        new = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not fs.rename(new, self._path(f"manifest/v{self.version:012d}.json")):
            raise RuntimeError(f"version {self.version} of {self.root} has been written by another driver")

    def _read(self, buckets: set[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], _TERMS)
        for f in sorted(set(self.folders.values())):
            own = [b for b, g in self.folders.items() if g == f and (buckets is None or b in buckets)]
            if own:
                out = out.unionByName(self.spark.read.schema(_TERMS + ", bucket int").parquet(f).where(F.col("bucket").isin(own)).drop("bucket"))
        return out

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, record: str = "tableid", fields: tuple[str, ...] = ("term", "tokenized")) -> None:
        n_buckets = self.buckets
        while self.n_terms > n_buckets * PER_BUCKET:
            n_buckets *= 2
        bucket = F.pmod(F.xxhash64("field", "value"), F.lit(n_buckets)).cast("int")
        signed = None
        for df, sign in ((added, 1), (removed, -1)):
            if df is not None:
                one = counted(df, record, fields).select("field", "value", (F.lit(sign) * F.col("occurrences")).alias("occurrences"), (F.lit(sign) * F.col("records")).alias("records"))
                signed = one if signed is None else signed.unionByName(one)
        if signed is None:
            return
        if self.folders:
            folder = f"{self.root}/delta/{uuid.uuid4().hex}"
            signed.write.parquet(folder)
            signed = self.spark.read.schema(_TERMS).parquet(folder)
            touched = {r[0] for r in signed.select(bucket.alias("b")).distinct().collect()}  # at most n_buckets numbers
            if not touched:
                return
            if n_buckets != self.buckets:  # every bucket is split
                touched = set(range(n_buckets))
            signed = signed.unionByName(self._read(None if n_buckets != self.buckets else touched))
        else:
            touched = set(range(n_buckets))
        placed = signed.withColumn("bucket", bucket).repartition(n_buckets, "bucket")
        merged = placed.groupBy("bucket", "field", "value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        wrong = "occurrences < 0 or records < 0 or (occurrences = 0) <> (records = 0)"
        checked = F.when(F.expr(wrong), F.raise_error(F.lit("a removed cell was never added"))).otherwise(F.col("occurrences"))
        merged = merged.withColumn("occurrences", checked).where("occurrences <> 0")
        folder = f"{self.root}/terms/{uuid.uuid4().hex}"
        seen = Observation()
        try:
            merged.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").parquet(folder)
        except Exception as e:
            if "never added" in str(e):
                raise ValueError("a removed cell was never added") from e
            raise
        kept = {} if n_buckets != self.buckets else {b: f for b, f in self.folders.items() if b not in touched}
        self.folders, self.buckets = kept | {b: folder for b in touched}, n_buckets
        self.n_terms = self._read().count() if kept else seen.get["n"]
        self.version += 1
        self._publish()

    def terms(self) -> DataFrame:
        """(field, value, occurrences, records) of everything counted."""
        return self._read()


def marks(terms: DataFrame, n_records: int, stored: DataFrame, common_share: float = 0.03) -> DataFrame:
    """(term, mark): rare (one cell), common (in more than common_share of all records), drift (a stored number_occurence
    that is not the number of records having the entry as tokenized; an entry that no record has counts 0)."""
    own = terms.where("field = 'term'")
    rare = own.where("occurrences = 1").select(F.col("value").alias("term"), F.lit("rare").alias("mark"))
    common = own.where(F.col("records") > common_share * n_records).select(F.col("value").alias("term"), F.lit("common").alias("mark"))
    held = terms.where("field = 'tokenized'").select(F.col("value").alias("term"), "records")
    listed = stored.where("term is not null and number_occurence is not null").select("term", "number_occurence").distinct()
    drift = listed.join(held, "term", "left").where(F.col("number_occurence") != F.coalesce("records", F.lit(0))).select("term", F.lit("drift").alias("mark")).distinct()
    return rare.unionByName(common).unionByName(drift)

"""Reading tables and cutting lineage; shared by every query."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, a temporary one only where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not getattr(spark, "_tabweave_dir", None):
        if "local" not in spark.sparkContext.master or "local-cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark._tabweave_dir = tempfile.mkdtemp(prefix="tabweave-")
    return spark._tabweave_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tabweave/{label}-{uuid.uuid4().hex}"
    made = spark.__dict__.setdefault("_tabweave_made", [])
    if not made:
        atexit.register(cleanup, spark)
    made.append(path)
    return path


def cleanup(spark: SparkSession) -> None:
    """Deletes the scratch folders of this driver. Results that still read them must be written before."""
    made = spark.__dict__.get("_tabweave_made", [])
    try:
        jvm = spark.sparkContext._jvm
        for path in made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before: nothing can be deleted through it any more
        return
    made.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: a cut of the lineage that survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """value to all executors once, with the classes of this package in it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    return pickle.loads(sent.value)

"""Tables shared by the operators: inputs, tables kept between steps, worker memory."""

import gc
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolemill.session import use_checkpoint_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    It cuts lineage like ``checkpoint()``, but as compressed columns, so that later
    steps read only the columns they use. Lost executors lose nothing of it.
    """
    spark = df.sparkSession
    use_checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables that only finished steps have read: what was made of them has
    been kept itself, so lost executors need none of them.

    The driver's garbage is collected as well; Spark then removes the shuffle files of
    steps that nothing refers to any more."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.kept_in
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def worker_memory(name: str, make):
    """What ``make()`` gave at this worker's first call; workers serve many tasks."""
    holder = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def words(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no words of a null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python: texts are long, so batches are short.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of our own only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if (set_already := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return set_already.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder: cuts lineage, survives lost executors, and makes values that depend on placement stable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or any(c.startswith(name.lower() + "_") for c in taken):
        name += "_"
    return name


def text_key(id_col: str = "doc_id", text_col: str = "text"):
    """128 bits that name a row by its id and text, so that repeated ids with other texts stay apart."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))))


def plan_partitions(spark: SparkSession, least: int = 8) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))

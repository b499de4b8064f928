"""Lineage cuts for operators that go in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the folder that driver and executors share (``spark.checkpoint.dir``), one of our own only
    where it is unset and the master is local, as in tests. Parquet takes a fraction of the room of a checkpoint's rows."""
    spark = df.sparkSession
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        shared = found.get()
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="vellum-rounds-")
        sc.setCheckpointDir(shared)
    path = f"{shared}/vellum-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Sources and sinks: the tables a parser leaves, JSON artifacts, resumable scans, and artifacts by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOX = [T.StructField(k, T.DoubleType()) for k in ("x0", "y0", "x1", "y1")]
_PAGE = [T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType())]
SPANS = T.StructType([*_PAGE, T.StructField("ordinal", T.LongType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), *_BOX, T.StructField("font", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("vertical", T.BooleanType())])
DRAWINGS = T.StructType([*_PAGE, T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), *_BOX, T.StructField("width", T.DoubleType())])
IMAGES = T.StructType([*_PAGE, T.StructField("xref", T.LongType()), *_BOX])
PAGES = T.StructType([*_PAGE, T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("rotation", T.IntegerType()), T.StructField("text_length", T.LongType()), T.StructField("n_images", T.IntegerType()), T.StructField("encrypted", T.BooleanType())])
REGIONS = T.StructType([*_PAGE, T.StructField("id", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("confidence", T.DoubleType()), *_BOX])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows that don't parse, as they are): errors are kept, not swallowed."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null").select("_corrupt")


def flag_vertical(spans: DataFrame) -> DataFrame:
    """Blank spans dropped; tall narrow ones flagged."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return spans.where(F.trim("text") != "").withColumn("vertical", (h > 30) & (h > 2.5 * w))


def scan(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> tuple[DataFrame, DataFrame]:
    """files(path, content) from ``binaryFile`` through a pluggable parser, rows and errors apart: a file that fails is a row of the second frame."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                try:
                    rows, error = parse(bytes(r.content)), None
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    rows, error = [], f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [r.path], "rows": [rows], "error": [error]})

    out = files.select("path", "content").mapInPandas(run, f"path string, rows array<struct<{schema}>>, error string")
    return out.where("error is null").select("path", F.explode("rows").alias("r")).select("path", "r.*"), out.where("error is not null").select("path", "error")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed scan still has to do."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def preflight(pages: DataFrame) -> DataFrame:
    """By document: scanned if half its pages are images with little text; blocked if a page is rotated or encrypted."""
    image_only = (F.col("n_images") > 0) & (F.col("text_length") < 50)
    d = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(image_only).alias("image_only"), F.min("text_length").alias("least_text"), F.bool_or(F.col("rotation") != 0).alias("rotated"), F.bool_or("encrypted").alias("encrypted"))
    return d.withColumn("scanned", F.col("image_only") * 2 >= F.col("pages")).withColumn("blocked", F.col("rotated") | F.col("encrypted"))


def write_artifacts(df: DataFrame, path: str, by: str = "doc_id") -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

"""Cuts of lineage."""

from vellum.operators import rounds


def test_cut_is_a_compressed_table_in_the_shared_folder(spark):
    """Rows of a checkpoint take some fifty bytes a word."""
    df = spark.range(1000).selectExpr("id", "array(cast(id as double), null) a", "struct(cast(null as string) s, id t) b")
    held = rounds.cut(df)
    assert held.schema.simpleString() == df.schema.simpleString() and sorted(map(str, held.collect())) == sorted(map(str, df.collect()))
    assert all(f.endswith(".parquet") and spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in f for f in held.inputFiles()) and held.inputFiles()

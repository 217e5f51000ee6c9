"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyria.session import scratch_path

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable_on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *parts])
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back.

    Cuts the lineage so that a lost executor costs one read, not the work before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def boxed(df: DataFrame, **computed: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside computed columns.

    Working columns can then never clash with columns that the caller's table has.
    """
    box = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(box, *[c.alias(n) for n, c in computed.items()])


def unboxed(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """Undo ``boxed``; result columns replace input columns of the same name."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in results]
    return df.select(*kept, *[c.alias(n) for n, c in results.items()])


def with_keys(docs: DataFrame) -> DataFrame:
    """(row key in order of doc_id, doc_id, text); the key is doc_id where that is sound."""
    return keyed_rows(docs)[0]


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The same, and whether the keys are the ids."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("ids")).first()
    rows = docs.withColumn("text", text_of())
    if ids.n == ids.known == ids.ids:
        return rows.withColumn("doc", F.col("doc_id").cast("long")), True
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("doc", F.monotonically_increasing_id())
    return stored(ordered, "keyed-documents"), False

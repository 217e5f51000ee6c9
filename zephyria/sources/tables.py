"""CSV and Parquet tables: declared-schema scans, fallbacks and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyria import config
from zephyria.functions.numeric import no_nan
from zephyria.sources import schemas

#: What a file without the column has in it; other absent columns are NULL.
KEY_DEFAULTS = {"station_id": config.DEFAULT_STATION, "region_id": config.DEFAULT_REGION}
#: Versions of a written table are folders beside each other; a numbered pointer names the one that counts.
POINTER, VERSION = "_current-", "v-"
#: Before the number of buckets in the name of a version that has them.
BUCKETS = "-in-"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating column with NaN as NULL: one rule for "missing" downstream."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[no_nan(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in declared order; absent keys get their default, others NULL."""
    have = set(df.columns)
    if not have.intersection(schema.fieldNames()):
        raise ValueError(f"none of the declared columns is among {sorted(have)}")
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(KEY_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _open(spark: SparkSession, path: str, schema: T.StructType | None, fmt: str) -> DataFrame | None:
    """A stored table, or None where the path is absent.

    A CSV file is read by the names in its header, whatever their order; the header
    is the only thing read twice. Of a table that was written here, the newest version is read.
    """
    path = current(spark, path)
    try:
        if fmt != "csv":
            return (spark.read if schema is None else spark.read.schema(schema)).format(fmt).load(path)
        reader = spark.read.option("header", True)
        header = reader.csv(path).columns
        if schema is None:
            return reader.csv(path)
        declared = {f.name: f for f in schema.fields}
        stored = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
        return by_name(reader.option("enforceSchema", False).schema(stored).csv(path), schema)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def find(spark: SparkSession, path: str, schema: T.StructType | None, fmt: str = "csv") -> DataFrame | None:
    """A stored table, or None where there is none."""
    df = _open(spark, path, schema, fmt)
    return None if df is None else nan_to_null(df)


def scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a stored table for a report; an absent path is an empty table of the same schema.

    A job that writes must use ``find`` and decide what an absent input means.
    """
    df = find(spark, path, schema, fmt)
    return spark.createDataFrame([], schema) if df is None else df


def scan_first(
    spark: SparkSession, candidates: Iterable[tuple[str, T.StructType]], fmt: str = "csv"
) -> DataFrame | None:
    """The first candidate path that exists, in order; None when none does."""
    for path, schema in candidates:
        df = find(spark, path, schema, fmt)
        if df is not None:
            return df
    return None


def scan_wards(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.WARD)


def _folder(spark: SparkSession, path: str):
    """(the path as Hadoop has it, its file system)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the published versions of a table, oldest first.

    A pointer's name holds both, so it is never read half written.
    """
    folder, files = _folder(spark, path)
    if not files.exists(folder) or not files.getFileStatus(folder).isDirectory():
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    parts = [n.removeprefix(POINTER).split("-", 1) for n in names if n.startswith(POINTER)]
    return sorted((int(number), version) for number, version in parts)


def current(spark: SparkSession, path: str) -> str:
    """Where the rows of a table are: its newest published version, or the path itself where it has none."""
    found = versions(spark, path)
    return f"{path.rstrip('/')}/{VERSION}{found[-1][1]}" if found else path


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = ("year",),
    fmt: str = "parquet",
    then: Callable[[DataFrame], DataFrame] | None = None,
    compression: str | None = None,
) -> None:
    """Replace the table at ``path``. Parquet is laid out by year so year filters prune files.

    Rows are gathered by year and the parts balanced by their measured bytes, so files
    neither stay tiny nor hold a year of any size. ``then`` adds columns that depend on
    their row alone; they are worked out where rows are written and are not moved. The table is written as a version of
    its own; creating the pointer to it publishes it, in one step. Before that a reader,
    or whoever comes after a crash, has the version before, which is kept as long as
    this one is the newest, for readers who have opened it. Read with ``find`` or ``scan``.
    """
    keys = [] if fmt == "csv" else [c for c in partition_by if c in df.columns]
    spark, root = df.sparkSession, path.rstrip("/")
    name = uuid.uuid4().hex
    gathered = df.hint("rebalance", *keys) if keys else df
    writer = (then(gathered) if then else gathered).write.format(fmt)
    # a CSV file is as long as what one task writes, so it need not be split to be read
    writer = writer.option("header", True) if fmt == "csv" else writer
    compression = compression or ("gzip" if fmt == "csv" else None)
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*keys) if keys else writer).save(f"{root}/{VERSION}{name}")
    publish(spark, root, name)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a stored table."""
    folder, files = _folder(spark, current(spark, path))
    return files.getContentSummary(folder).getLength() if files.exists(folder) else 0


def write_clustered(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``write_table`` where rows of one ``key`` are in one of so many buckets, whose number is in the version's name.

    Two tables with as many buckets meet, and windows over ``key`` run, without moving rows once more.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    name = f"{uuid.uuid4().hex}{BUCKETS}{buckets}"
    entry = f"clustered_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", f"{root}/{VERSION}{name}")
    try:
        writer.saveAsTable(entry)
    finally:
        spark.sql(f"drop table if exists {entry}")  # the files stay
    publish(spark, root, name)


def clustered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The stored table, with its buckets where ``write_clustered`` made it."""
    folder = current(spark, path)
    stored = spark.read.parquet(folder)
    _, found, buckets = folder.rpartition("/")[2].partition(BUCKETS)
    if not found:
        return stored
    entry, columns = f"clustered_{uuid.uuid4().hex}", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table {entry} ({columns}) using parquet clustered by (`{key}`) into {int(buckets)} buckets location '{place}'")
    try:
        return spark.table(entry)
    finally:
        spark.sql(f"drop table {entry}")


def publish(spark: SparkSession, root: str, name: str) -> None:
    """Make version ``name`` the table; of two writers with one number the later one fails."""
    before = versions(spark, root)
    number = before[-1][0] + 1 if before else 1
    folder, files = _folder(spark, root)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{POINTER}{number}-{name}"), False).close()
    if [n for n, _ in versions(spark, root)].count(number) > 1:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{POINTER}{number}-{name}"), False)
        raise OSError(f"another writer replaced {root} at the same time")
    for number, version in before[:-1]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{POINTER}{number}-{version}"), False)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{VERSION}{version}"), True)

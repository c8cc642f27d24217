"""Readers and writers: feed scans with format fallback, named tables, lineage stamps, guarded sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ledgerloom.session import shared_dir, shuffles_dropped


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller wrote."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def read_feed(spark: SparkSession, base: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """`<base>/<name>.parquet`, else the folder `<base>/<name>`, else `<base>/<name>.csv`.

    The format is chosen by what exists, so a broken file raises its own error instead of being skipped.
    """
    root = f"{base.rstrip('/')}/{name}"
    for path in (f"{root}.parquet", root):
        if path_exists(spark, path):
            return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if path_exists(spark, f"{root}.csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(f"{root}.csv")
    raise FileNotFoundError(f"no parquet or csv feed at {root}")


def read_named(spark: SparkSession, *parts: str) -> DataFrame:
    """A table by name; several parts are joined to a qualified name."""
    return spark.read.table(".".join(parts))


def save_table(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), fmt: str = "parquet", path: str | None = None
) -> None:
    """Overwrite a table together with its schema, at `path` or in the warehouse. `fmt="delta"` works where that jar
    is installed."""
    writer = df.write.mode("overwrite").option("overwriteSchema", "true").format(fmt)
    writer = writer.option("path", path) if path else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def save_if_any(df: DataFrame, path: str, probe: DataFrame | None = None) -> bool:
    """Write only when there is a row; looks at one row, counts nothing. `probe` has a row if and only if `df` has one,
    and is cheaper to look at: rows behind a join are then worked out once, for the write."""
    if (df if probe is None else probe).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def nested_to_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The listed columns, or every nested one, as JSON text. NULL stays NULL."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, StructType, MapType))]
    chosen = nested if columns is None else [c for c in columns if c in nested]
    return df.withColumns({c: F.to_json(c) for c in chosen}) if chosen else df


def stamp_lineage(
    df: DataFrame,
    source: str,
    source_file: str | Column,
    ingestion_ts: str,
    batch_id: str,
    key: Sequence[str | Column] = (),
    data_version: str = "1.0",
    synthetic: bool = True,
) -> DataFrame:
    """Lineage columns on every row.

    With `key` the record id is a hash of source, file and key, so replaying a batch gives the same id;
    without it a random uuid.
    """
    file_col = F.lit(source_file) if isinstance(source_file, str) else source_file
    if key:
        record = F.sha2(F.concat_ws("|", F.lit(source), file_col, *key), 256)
    else:
        record = F.expr("uuid()")
    return df.withColumns(
        {
            "_record_id": record,
            "_source_system": F.lit(source),
            "_source_file": file_col,
            "_ingestion_ts": F.lit(ingestion_ts),
            "_batch_id": F.lit(batch_id),
            "_data_version": F.lit(data_version),
            "_is_synthetic": F.lit(synthetic),
        }
    )


def compact(df: DataFrame, path: str, cluster_by: Sequence[str], files: int | None = None) -> DataFrame:
    """Rewrite clustered by range and sorted inside each file, so min/max statistics prune; read back.

    Add a high-cardinality last column to `cluster_by` when the first is skewed: range bounds then cut
    through the hot value.
    """
    ranged = df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)
    ranged.sortWithinPartitions(*cluster_by).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of an executor."""
    path = f"{shared_dir(df.sparkSession)}/t"
    writer = df.write.mode("overwrite")
    with shuffles_dropped(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a table that a join may hold in memory on the driver and in each executor: about 100 MB of ids.
LOOKUP_ROWS = 1_000_000


def looked_up(table: DataFrame, most: int = LOOKUP_ROWS) -> DataFrame:
    """A written table as the side of a join that rows are looked up in.

    Spark plans a broadcast by the size of the files. Ids in their order take a byte or two there and some eighty in memory, so
    10 MB of files can be half a gigabyte on the driver. The rows are counted, for which only the files' footers are read;
    with more than `most` of them the join sorts and merges, with fewer Spark chooses as ever.
    """
    return table.hint("merge") if table.count() > most else table

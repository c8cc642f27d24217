"""Table layout for pruning on several columns, and tables in key buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: Rank bits of each clustered column: 2^6 ranges of about equally many rows.
BITS = 6
BUCKET = "_bucket"


def _number(df: DataFrame, c: str) -> Column:
    """The column as a number in the same order. Strings by their first six bytes: those that agree in them share a rank."""
    kind, col = df.schema[c].dataType, F.col(c)
    if isinstance(kind, NumericType):
        return col.cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"{c}: {kind.simpleString()} has no rank")


def _ranked(df: DataFrame, c: str, out: str, bits: int, error: float) -> DataFrame:
    """The number of the range between approximate quantiles that the value falls into; NULL in the first."""
    df = df.withColumn(out, _number(df, c))
    cuts = sorted(set(df.approxQuantile(out, [k / 2**bits for k in range(1, 2**bits)], error)))
    cuts += [float("inf")] * (2**bits - 1 - len(cuts))
    bounds = F.array(*[F.lit(x) for x in cuts])
    df = df.withColumnRenamed(out, f"{out}_value").withColumn(out, F.lit(0))
    for step in (2**k for k in range(bits - 1, -1, -1)):  # binary search, one column for each step
        beyond = F.col(f"{out}_value") > F.element_at(bounds, (F.col(out) + step).cast("int"))
        df = df.withColumn(out, F.col(out) + F.when(beyond, step).otherwise(0))
    return df.drop(f"{out}_value")


def cluster(
    df: DataFrame, path: str, columns: Sequence[str], files: int, bits: int = BITS, error: float = 0.001
) -> DataFrame:
    """Rewritten so that a filter on any one of the columns skips most files; read back.

    The bits of the columns' ranks are interleaved, and rows are range-partitioned and sorted by the result, so every file
    holds a narrow range of each column. Ranks come from quantiles, so skewed values are spread evenly; one value with
    very many rows is cut between files by a hash of the row. With n files and c columns a filter on one value reads about
    n^((c-1)/c) of them.
    """
    names = [f"_rank_{k}" for k in range(len(columns))]
    ranked = reduce(lambda d, x: _ranked(d, x[0], x[1], bits, error), zip(columns, names), df)
    parts = [
        F.shiftleft(F.shiftright(F.col(n), bit).bitwiseAND(F.lit(1)).cast("bigint"), bit * len(names) + len(names) - 1 - k)
        for k, n in enumerate(names) for bit in range(bits)]
    order = reduce(lambda a, b: a.bitwiseOR(b), parts)
    spread = ranked.withColumns({"_order": order, "_spread": F.xxhash64(*df.columns)}).drop(*names)
    out = spread.repartitionByRange(files, "_order", "_spread").sortWithinPartitions("_order", *columns)
    out.drop("_order", "_spread").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_touched(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """One row: n_files, and n_read, those whose range of the column meets [low, high]: the ones min/max statistics leave."""
    per = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(column).alias("mn"), F.max(column).alias("mx"))
    meets = (F.col("mx") >= F.lit(low)) & (F.col("mn") <= F.lit(high))
    return per.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(meets).alias("n_read"))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, only: Sequence[int] | None = None) -> None:
    """The table in folders of key buckets. With `only`, those folders are replaced and no other file is touched. A bucket is
    written by one task unless AQE splits it; choose `buckets` so that one is a few files' worth."""
    placed = df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    writer = placed.write.mode("overwrite").partitionBy(BUCKET)
    (writer if only is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(path)


def read_buckets(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The table, or some buckets of it: the others are not listed in the scan."""
    df = spark.read.parquet(path)
    return (df if only is None else df.filter(F.col(BUCKET).isin(list(only)))).drop(BUCKET)

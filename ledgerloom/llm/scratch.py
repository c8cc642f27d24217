"""Intermediate tables in the shared folder, and helpers that every operator of this folder uses."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a session without one gets one beside its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


class Scratch:
    """One run's folder. `keep` writes a frame there and reads it back, which cuts the lineage; `drop` removes a table
    that its readers no longer need. Tables survive a lost executor, since all executors share the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.dir = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.dir}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.dir}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = _fs(self.spark, f"{self.dir}/{name}")
            fs.delete(path, True)

    def put(self, name: str, data: bytes) -> str:
        """A small file in the folder; its path."""
        fs, path = _fs(self.spark, f"{self.dir}/{name}")
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
        return f"{self.dir}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n


def fold_of(key: int, n: int) -> int:
    return zlib.crc32(str(key).encode()) % n


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash with columns made later."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def keyed(df: DataFrame, key: str, ddl: str) -> StructType:
    """The key's field as it is in `df`, followed by the fields of `ddl`."""
    return StructType([df.select(key).schema[0], *StructType.fromDDL(ddl).fields])


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    place = public_tokenizers.path(name)
    if not Path(place).exists():
        raise FileNotFoundError(place)
    return place


def groups(texts: list, size: int = 4_000_000) -> Iterator[list]:
    """Runs of texts of about that size, so that what is held at once does not follow the batch."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group

"""A version merge whose cost follows the batch, not the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import any_of, differs
from ledgerloom.operators.temporal import scd2_apply
from ledgerloom.sources.landing import materialize
from ledgerloom.sources.layout import bucket_of, read_buckets, write_buckets


@dataclass
class BucketMerge:
    rewritten: list[int]
    rejected: DataFrame


def changed_buckets(open_rows: DataFrame, updates: DataFrame, key: str, compare: Sequence[str], buckets: int) -> list[int]:
    """Buckets in which the batch changes anything: a new key, or a tracked attribute that differs from the open version.

    The result is at most one number for each bucket. Spark builds a Bloom filter of the batch's keys at run time where that
    pays, so open rows of other keys drop out before the join.
    """
    old = open_rows.select(F.col(key).alias("_k"), F.struct(*compare).alias("_old"))
    new = updates.filter(F.col(key).isNotNull())
    both = new.join(old, new[key] == old["_k"], "left")
    moved = any_of([differs(F.col(f"_old.{c}"), F.col(c)) for c in compare])
    hit = both.filter(F.col("_k").isNull() | moved).select(bucket_of(key, buckets).alias("b")).distinct()
    return sorted(r["b"] for r in hit.collect())


def merge_buckets(
    path: str, updates: DataFrame, key: str, compare: Sequence[str], change_date: str, buckets: int,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> BucketMerge:
    """T4/J9 in place: `scd2_apply` on the buckets that the batch changes, the rest of the table untouched.

    The buckets of the batch's keys are scanned, no others; of these only the ones with a change are merged and
    replaced, so a batch that was applied before rewrites nothing. The merged rows are written aside first and then
    put in their place, so the table is never read while it is written; a job that dies in between is run again.
    """
    spark = updates.sparkSession
    updates = keep(updates)
    asked = updates.filter(F.col(key).isNotNull()).select(bucket_of(key, buckets).alias("b")).distinct()
    asked = sorted(r["b"] for r in asked.collect())  # at most one number for each bucket
    current = read_buckets(spark, path, asked)
    touched = changed_buckets(current.filter("is_current"), updates, key, compare, buckets)
    rejected = scd2_apply(current.limit(0), updates, key, compare, change_date).rejected
    opened = current.filter("is_current").select(key, F.col("valid_from").alias("_from"), *[F.col(c).alias(f"_{c}") for c in compare])
    late = updates.join(opened, key).filter(
        (F.col(change_date) < F.col("_from")) & any_of([differs(F.col(c), F.col(f"_{c}")) for c in compare]))
    late = late.select(*updates.columns).withColumn("_reject_reason", F.lit("before_open_version"))
    rejected = keep(rejected.unionByName(late))  # before any file that it reads is replaced
    if touched:
        mine = updates.filter(bucket_of(key, buckets).isin(touched))
        merged = keep(scd2_apply(read_buckets(spark, path, touched), mine, key, compare, change_date).state)
        write_buckets(merged, path, key, buckets, touched)
    return BucketMerge(touched, rejected)

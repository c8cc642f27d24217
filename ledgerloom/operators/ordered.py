"""Ordered work that neither a hot key nor a hot day confines to one task: as-of joins and running totals.

Rows are range-partitioned by key and order, so a key is cut anywhere. What a partition hands on to those behind it, the last
version or the sum so far, is one row for each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ledgerloom.functions.scalars import valid_at
from ledgerloom.operators.measures import Star, row_worth, select_facts
from ledgerloom.operators.temporal import with_neighbours
from ledgerloom.sources.landing import materialize

Keep = Callable[[DataFrame], DataFrame]


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())


def asof_join(fact: DataFrame, at: str, dim: DataFrame, key: str, sk: str, keep: Keep = materialize) -> DataFrame:
    """The dimension version valid at the fact's date, NULL when there is none; rows as those of `star.pit_join`.

    Facts and versions are one frame, sorted by key and time; every fact takes the last version before it, inside its
    partition or handed on from those before. That is the only one it can match, as long as versions end before the next
    begins. Versions that do not are set apart first and joined by key and window; where there are none, nothing is joined.
    """
    kinds = [fact.schema[at].dataType, dim.schema["valid_from"].dataType]
    kind = kinds[0] if kinds[0] == kinds[1] else next((k for k in kinds if k != DateType()), kinds[0])
    versions = dim.select(
        F.col(key).alias("_k"), F.col(sk).alias("_sk"), F.col("valid_from").cast(kind).alias("_vf"),
        F.col("valid_to").cast(kind).alias("_vt")).filter("_k is not null and _vf < _vt").withColumn("_id", F.monotonically_increasing_id())
    seen = with_neighbours(versions, "_k", ["_vf", "_id"], ["_vf"], "_prev", "_next", keep)
    crossing = F.coalesce(F.col("_vt") > F.col("_next._vf"), F.lit(False))
    apart = keep(seen.filter(crossing).select("_k", "_sk", "_vf", "_vt"))

    facts = fact.drop(sk)
    row = F.struct(*facts.columns)
    version = F.struct("_k", "_sk", "_vt")
    order = ["_key", "_time", "_kind", "_tie"]  # a version that begins at the fact's time comes before it
    starts = seen.filter(~crossing).select(
        F.col("_k").alias("_key"), F.col("_vf").alias("_time"), F.lit(0).alias("_kind"), F.col("_id").alias("_tie"), version.alias("_version"))
    asks = facts.select(
        F.col(key).alias("_key"), F.col(at).cast(kind).alias("_time"), F.lit(1).alias("_kind"),
        F.monotonically_increasing_id().alias("_tie"), row.alias("_row"))
    rows = keep(_ranged(starts.unionByName(asks, allowMissingColumns=True), order))

    rank = F.when(F.col("_kind") == 0, F.struct(*order))
    along = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    ends = rows.groupBy("_part").agg(F.max_by("_version", rank).alias("_last")).select(
        "_part", F.last("_last", ignorenulls=True).over(along).alias("_handed"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.join(ends, "_part").withColumn(
        "_near", F.coalesce(F.last("_version", ignorenulls=True).over(inside), F.col("_handed")))
    hit = F.coalesce((F.col("_near._k") == F.col("_key")) & (F.col("_time") < F.col("_near._vt")), F.lit(False))
    found = near.filter("_kind = 1").select("_key", "_time", "_row", hit.alias("_hit"), F.when(hit, F.col("_near._sk")).alias(sk))
    if apart.isEmpty():
        return found.select("_row.*", sk)
    found = keep(found)
    on = (F.col("_key") == F.col("_k")) & valid_at(F.col("_time"), "_vf", "_vt")
    several = found.drop(sk).join(apart, on).select("_row.*", F.col("_sk").alias(sk))
    none = found.filter("not _hit").join(apart, on, "left_anti")
    return found.filter("_hit").select("_row.*", sk).unionByName(several).unionByName(none.select("_row.*", sk))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], keep: Keep = materialize
) -> DataFrame:
    """The sum of each expression over the rows of the same keys up to this one; without keys over all rows.

    A prefix sum in two levels: inside range partitions, and over what each partition adds to its last key. Rows are
    ordered by `order`, NULL first, which must be unique among the rows of a key (add up peers before); NULL keys are keys.
    Use exact types for exact totals: partitions add in another order than one task does.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    values = {f"_add_{n}": c for n, c in sums.items()}
    rows = _ranged(df.withColumns({"_group": group, **values}), [*keys, *order])
    inside = Window.partitionBy("_part", "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keep(rows.withColumns({n: F.sum(f"_add_{n}").over(inside) for n in sums}).drop(*values))

    rank = F.struct("_group", *order)
    ends = local.groupBy("_part").agg(
        F.min("_group").alias("_first"), F.max("_group").alias("_last"), F.max_by(F.struct(*sums), rank).alias("_tail"))
    added = ends.select(F.col("_last").alias("_g"), "_part", "_tail", F.lit(False).alias("_asks")).unionByName(
        ends.select(F.col("_first").alias("_g"), "_part", F.lit(True).alias("_asks")), allowMissingColumns=True)
    before = Window.partitionBy("_g").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    handed = added.withColumns({f"_before_{n}": F.sum(f"_tail.{n}").over(before) for n in sums}).filter("_asks").drop("_tail", "_asks")

    def whole(n: str) -> Column:
        carried = F.when(F.col("_group").eqNullSafe(F.col("_g")), F.col(f"_before_{n}"))
        return F.when(carried.isNull(), F.col(n)).otherwise(carried + F.coalesce(F.col(n), F.lit(0)))

    out = local.join(handed, "_part").withColumns({n: whole(n) for n in sums})
    return out.drop("_part", "_group", "_g", *[f"_before_{n}" for n in sums])


def running_nav(
    star: Star, by: Sequence[str], order: Sequence[str], where: dict[str, object] | None = None, keep: Keep = materialize
) -> DataFrame:
    """A13/M7 at the grain of single facts: capital and NAV so far after each fact, for each group of `by`."""
    facts = select_facts(star, by, where).select(*dict.fromkeys([*by, *order]), "participation_amount", row_worth().alias("_worth"))
    exact = "decimal(28,4)"
    sums = {"invested_so_far": F.col("participation_amount").cast(exact), "nav_so_far": F.col("_worth").cast(exact)}
    return running_total(facts, by, order, sums, keep).drop("participation_amount", "_worth")

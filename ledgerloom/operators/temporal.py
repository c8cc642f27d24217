"""Stage C: two time axes, version envelopes, version merge, as-of reads and histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v
from ledgerloom.functions.scalars import any_of, differs, valid_at
from ledgerloom.operators.validate import with_key_count
from ledgerloom.sources.landing import materialize

ENVELOPE = ["valid_from", "valid_to", "is_current"]
KNOWLEDGE = ["known_from", "known_to"]


def day(c: str | Column) -> Column:
    """As a date; text that is none gives NULL, which the checks report, and does not stop the job."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("date")


def with_axes(df: DataFrame, *effective: str | Column, ingestion: str = "_ingestion_ts") -> DataFrame:
    """`effective_date` is the first non-null of the given dates, else the ingestion date."""
    ingested = F.col(ingestion).try_cast("timestamp")
    return df.withColumns(
        {"effective_date": F.coalesce(*[day(c) for c in effective], ingested.cast("date")), "ingestion_date": ingested}
    )


def envelope(df: DataFrame, effective: str | Column = "effective_date") -> DataFrame:
    """The first version of every row opens at its effective date."""
    return df.withColumns(
        {"valid_from": day(effective), "valid_to": F.lit(v.OPEN_END).cast("date"), "is_current": F.lit(True)}
    )


def envelope_from_genesis(df: DataFrame) -> DataFrame:
    """No business date exists, so the first version covers all past facts."""
    return envelope(df, F.lit(v.GENESIS).cast("date"))


def as_of(df: DataFrame, valid: str | Column, known: str | Column | None = None) -> DataFrame:
    """Rows true at `valid` as known at `known`, or as known now.

    A table with a knowledge interval (`bitemporal.learn`) answers for any past `known`. Of a table without one, rows that
    were already ingested by then; closed versions of it carry later knowledge in their end.
    """
    at = F.lit(valid).cast("date") if isinstance(valid, str) else valid
    out = df.filter(valid_at(at))
    if set(KNOWLEDGE) <= set(df.columns):
        if known is None:
            return out.filter(F.col("known_to") == F.lit(v.OPEN_END).cast(df.schema["known_to"].dataType))
        return out.filter(valid_at(F.lit(known).cast("timestamp_ntz") if isinstance(known, str) else known, *KNOWLEDGE))
    if known is not None:
        out = out.filter(F.col("ingestion_date") <= (F.lit(known).cast("timestamp") if isinstance(known, str) else known))
    return out


def versions(df: DataFrame, key: str, value: str | DataFrame) -> DataFrame:
    """T5: all versions of one key, oldest first; the key as a value, or as a frame of one row that need not be known yet."""
    own = df.filter(F.col(key) == value) if isinstance(value, str) else df.join(value, key, "left_semi")
    return own.orderBy("valid_from", "valid_to")


def null_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and NULLs on either axis, one aggregate per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("effective_date").isNull()).alias("effective_null"),
            F.count_if(F.col("ingestion_date").isNull()).alias("ingestion_null"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "effective_null", "ingestion_null")
        out = part if out is None else out.unionByName(part)
    return out


def pass_through(df: DataFrame, columns: Sequence[str], *effective: str, genesis: bool = False) -> DataFrame:
    """A feed with one source needs no reconciling: status clean, axes and envelope."""
    out = with_axes(df, *effective).withColumn("reconciliation_status", F.lit(v.CLEAN))
    out = out.select(*columns, "effective_date", "ingestion_date", "reconciliation_status")
    return envelope_from_genesis(out) if genesis else envelope(out)


@dataclass
class Merge:
    state: DataFrame
    rejected: DataFrame


def scd2_apply(
    current: DataFrame, updates: DataFrame, key: str, compare: Sequence[str], change_date: str
) -> Merge:
    """The table after a batch of updates: changed keys get their open version closed and a new one
    opened, new keys open, unchanged keys stay. Replaying a batch changes nothing.

    Pure function: write `state` to a new path or table, never over the one being read. Rejected with a
    reason: keys that occur twice in the batch, NULL keys, and changes dated before the open version.
    Closed history never enters the shuffle.
    """
    columns = current.columns
    business = [c for c in columns if c not in ENVELOPE]
    counted = with_key_count(updates, key)
    reason = F.when(F.col(key).isNull(), "null_key").when(F.col("_copies") > 1, "dup_key").when(
        F.col(change_date).isNull(), "null_change_date")
    counted = counted.withColumn("_reject_reason", reason).drop("_copies")
    usable = counted.filter(F.col("_reject_reason").isNull()).drop("_reject_reason")

    old = F.struct(*[F.col(f"t.{c}") for c in columns])
    opened = current.filter("is_current").alias("t").select(F.col(f"t.{key}").alias("_tk"), old.alias("old"))
    new = usable.alias("u").select(
        F.col(f"u.{key}").alias("_uk"), F.struct(*[F.col(f"u.{c}") for c in usable.columns]).alias("new"))
    both = opened.join(new, opened["_tk"] == new["_uk"], "full_outer")

    have = [c for c in business if c in usable.columns]
    at = F.col(f"new.{change_date}")
    changed = (
        F.col("old").isNotNull() & F.col("new").isNotNull()
        & any_of([differs(F.col(f"old.{c}"), F.col(f"new.{c}")) for c in compare])
    )
    early = changed & (at < F.col("old.valid_from"))
    start_type = current.schema["valid_from"].dataType
    end_type = current.schema["valid_to"].dataType

    closed = F.struct(
        *[F.col(f"old.{c}").alias(c) for c in business],
        F.col("old.valid_from").alias("valid_from"),
        F.when(F.col("_changed"), at.cast(end_type)).otherwise(F.col("old.valid_to")).alias("valid_to"),
        (~F.col("_changed")).alias("is_current"),
    )
    fresh = F.struct(
        *[(F.col(f"new.{c}") if c in have else F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in business],
        at.cast(start_type).alias("valid_from"),
        F.lit(v.OPEN_END).cast(end_type).alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    both = both.withColumns({"_early": F.coalesce(early, F.lit(False)), "_changed": F.coalesce(changed & ~early, F.lit(False))})
    rows = F.array_compact(
        F.array(
            F.when(F.col("old").isNotNull(), closed),
            F.when(F.col("_changed") | F.col("old").isNull(), fresh),
        )
    )
    touched = both.select(F.explode(rows).alias("r")).select("r.*").select(*columns)
    state = current.filter("not is_current").select(*columns).unionByName(touched)
    late = both.filter("_early").select("new.*").withColumn("_reject_reason", F.lit("before_open_version"))
    return Merge(state, counted.filter(F.col("_reject_reason").isNotNull()).unionByName(late))


def with_neighbours(
    df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], before: str, after: str,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """The previous and the next row's values per key as structs, without a window over the whole key.

    Rows are range-partitioned by key and order, so a hot key is cut anywhere, also within one day, and neighbours are
    taken inside each partition. Only the first and the last row of each partition travel further: one row for each
    partition finds its neighbours in the partitions next to it that have rows. NULL keys are one key, NULL order
    values come first; `order` must be unique within a key. The partitions are written once, since both steps must see
    the same cuts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    packed = F.struct(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in values]).alias("_values"))
    rank = F.struct(F.col(key), *[F.col(c) for c in order])
    ends = rows.groupBy("_part").agg(F.min_by(packed, rank).alias("_first"), F.max_by(packed, rank).alias("_last"))
    along = Window.partitionBy(F.lit(1)).orderBy("_part")  # one row for each partition
    ends = ends.select("_part", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    inside = Window.partitionBy("_part").orderBy(key, *order)

    def near(step: Column, far: str) -> Column:
        found = F.coalesce(step, F.col(far))
        return F.when(found["_key"].eqNullSafe(F.col(key)), found["_values"])

    out = rows.join(ends, "_part").withColumns({before: near(F.lag(packed).over(inside), "_before"),
                                                after: near(F.lead(packed).over(inside), "_after")})
    return out.drop("_part", "_before", "_after")


def history_from_changes(
    changes: DataFrame, key: str, attrs: Sequence[str], at: str, tie: str,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Versions from an ordered change log: repeats of the same values drop out, each version ends where the
    next starts. Equals applying the changes one by one with `scd2_apply`. NULL keys are one key.
    """
    seen = with_neighbours(changes, key, [at, tie], [*attrs, at], "_prev", "_next", keep)
    moved = F.col("_prev").isNull() | any_of([differs(F.col(a), F.col(f"_prev.{a}")) for a in attrs])
    starts = seen.filter(moved).select(key, *attrs, at, tie)
    after = with_neighbours(starts, key, [at, tie], [at], "_prev", "_next", keep)
    end = F.col(f"_next.{at}")
    kind = changes.schema[at].dataType
    return after.select(
        key, *attrs, F.col(at).alias("valid_from"),
        F.coalesce(end, F.lit(v.OPEN_END).cast(kind)).alias("valid_to"), end.isNull().alias("is_current"),
    )

"""Versions on two axes: when a fact held, and when it was known.

A table of versions has a validity interval and a knowledge interval. Nothing in it is ever rewritten but `known_to`: a batch
closes the knowledge of the rows that it shows to be wrong and adds the corrected ones, so what was known at any past moment
stays readable. Both intervals include their start and exclude their end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from ledgerloom.functions import vocab as v
from ledgerloom.operators.temporal import KNOWLEDGE, with_neighbours
from ledgerloom.sources.landing import materialize

INTERVALS = ["valid_from", "valid_to", *KNOWLEDGE]


@dataclass
class Knowledge:
    state: DataFrame
    rejected: DataFrame


def nothing_known(batch: DataFrame, key: str, attrs: Sequence[str], at: str) -> DataFrame:
    """The empty table of versions that batches of this kind fill."""
    fields = [batch.schema[c] for c in (key, *attrs)]
    kinds = [batch.schema[at].dataType] * 2 + [TimestampNTZType()] * 2
    return batch.sparkSession.createDataFrame([], StructType(fields + [StructField(n, k) for n, k in zip(INTERVALS, kinds)]))


def learn(
    table: DataFrame, batch: DataFrame, key: str, attrs: Sequence[str], at: str, known: str | Column, tie: Sequence[str],
    retracted: str | None = None, keep: Callable[[DataFrame], DataFrame] = materialize,
) -> Knowledge:
    """The table after a batch that became known at `known`.

    Each row of the batch says that from `at` on the key had these attributes, until the next row of the key; rows with
    `retracted` take back what was said of that moment. Batches come in the order of `known`, but their rows may lie anywhere
    in the past: a late row cuts the version it falls into, a row for a moment already told of corrects it. Of several rows
    for one moment the one with the greatest `tie` counts. Replaying a batch changes nothing. Rows without a key or a moment
    are rejected with a reason.

    Only open rows of the batch's keys are worked on, cut into ranges of (key, moment), so a key with a third of the rows
    is no task's own. Closed knowledge passes through without a shuffle. Write `state` to a new place.
    """
    columns = [key, *attrs, *INTERVALS]
    start, end = (table.schema[c].dataType for c in ("valid_from", "valid_to"))
    moment = F.lit(known) if isinstance(known, str) else known
    moment = moment.cast("timestamp_ntz")
    never = F.lit(v.OPEN_END).cast("timestamp_ntz")

    reason = F.when(F.col(key).isNull(), "null_key").when(F.col(at).isNull(), "null_moment")
    judged = batch.withColumn("_reject_reason", reason)
    gone = F.coalesce(F.col(retracted), F.lit(False)) if retracted else F.lit(False)
    said = F.struct(F.struct(*attrs).alias("attrs"), gone.alias("gone"))
    news = judged.filter("_reject_reason is null").groupBy(F.col(key).alias("_key"), F.col(at).cast(start).alias("_at")).agg(
        F.max_by(said, F.struct(*tie)).alias("_new"))
    news = keep(news)
    touched = news.select(F.col("_key").alias(key)).distinct()

    is_open = F.col("known_to") == never
    now = table.filter(is_open)
    untouched = now.join(touched, key, "left_anti")
    old = now.join(touched, key, "left_semi").select(
        F.col(key).alias("_key"), F.col("valid_from").alias("_at"),
        F.struct(F.struct(*attrs).alias("attrs"), "valid_to", "known_from").alias("_old"))
    points = keep(old.join(news, ["_key", "_at"], "full_outer").withColumn(
        "_attrs", F.when(F.col("_new").isNull(), F.col("_old.attrs")).when(~F.col("_new.gone"), F.col("_new.attrs"))).withColumn(
        "_told", F.when(F.col("_new").isNull(), True).otherwise(~F.col("_new.gone"))))

    alive = with_neighbours(points.filter("_told"), "_key", ["_at"], ["_at"], "_prev", "_next", keep)
    until = F.coalesce(F.col("_next._at"), F.lit(v.OPEN_END).cast(start)).cast(end)
    same = F.col("_old.attrs").eqNullSafe(F.col("_attrs")) & F.col("_old.valid_to").eqNullSafe(F.col("_until"))
    same = F.col("_old").isNotNull() & same

    def row(values: str, upto: Column, since: Column, closed: Column) -> Column:
        return F.struct(
            F.col("_key").alias(key), *[F.col(f"{values}.{a}").alias(a) for a in attrs], F.col("_at").alias("valid_from"),
            upto.alias("valid_to"), since.alias("known_from"), closed.alias("known_to"))

    before = row("_old.attrs", F.col("_old.valid_to"), F.col("_old.known_from"), F.when(F.col("_same"), never).otherwise(moment))
    after = row("_attrs", F.col("_until"), moment, never)
    alive = alive.withColumn("_until", until).withColumn("_same", same)
    alive = alive.select(F.explode(F.array_compact(F.array(
        F.when(F.col("_old").isNotNull(), before), F.when(~F.col("_same"), after)))).alias("r"))
    gone_rows = points.filter("not _told and _old is not null").withColumn("_same", F.lit(False)).select(before.alias("r"))
    worked = alive.unionByName(gone_rows).select("r.*")
    state = table.filter(~is_open).select(*columns).unionByName(untouched.select(*columns)).unionByName(worked.select(*columns))
    return Knowledge(state, judged.filter("_reject_reason is not null"))

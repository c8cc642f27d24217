"""Stage D: data-quality assertions. Each table is read once for all its checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import vocab as v


class QualityError(RuntimeError):
    """A hard assertion failed."""


@dataclass(frozen=True)
class Check:
    """A named condition over a one-row frame of counts."""

    name: str
    ok: Column
    detail: Column
    hard: bool = True


def evaluate(counts: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Turn one row of counts into one report row per check."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check_name"),
                F.when(F.coalesce(c.ok, F.lit(False)), "PASS").otherwise("FAIL" if c.hard else "WARN").alias("status"),
                F.lit(c.hard).alias("is_hard"),
                c.detail.alias("detail"),
            )
            for c in checks
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def said(text: str, *counts: Column) -> Column:
    """The detail text with the counts filled in."""
    return F.format_string(text, *[F.coalesce(c.cast("string"), F.lit("none")) for c in counts])


def reference_counts(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null child keys, and how many of them have no parent, in one pass."""
    keys = child.select(F.col(child_key).alias("k")).filter(F.col("k").isNotNull()).distinct()
    parents = parent.select(F.col(parent_key).alias("p")).distinct()
    return keys.join(parents, F.col("k") == F.col("p"), "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").isNull()).alias("missing"))


def check_reference(
    name: str, child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, hard: bool = True
) -> DataFrame:
    """C2."""
    missing, n = F.col("missing"), F.col("n")
    counts = reference_counts(child, child_key, parent, parent_key)
    return evaluate(counts, [Check(name, missing == 0, said(v.DETAIL_REFERENCE, missing, n), hard)])


def entity_counts(df: DataFrame, key: str) -> DataFrame:
    """All counts the per-table checks need: one scan, one shuffle of pre-aggregated keys."""
    have = set(df.columns)
    nothing = F.lit(0).cast("bigint")
    late = F.count_if(F.col("effective_date") > F.to_date("ingestion_date")) if "ingestion_date" in have else nothing
    status = F.col("reconciliation_status")
    outside = F.count_if(~status.isin(v.ALLOWED_STATUS)) if "reconciliation_status" in have else nothing
    no_status = F.count_if(status.isNull()) if "reconciliation_status" in have else nothing
    per_key = df.groupBy(key).agg(
        F.count_if("is_current").alias("n_current"),
        F.count_if(F.col("valid_from").isNull() | F.col("valid_to").isNull() | F.col("is_current").isNull()).alias("null_env"),
        F.count_if(F.col("valid_from") > F.col("valid_to")).alias("inverted"),
        outside.alias("outside"), no_status.alias("no_status"), late.alias("late"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per_key.agg(
        F.count_if(F.col("n_current") > 1).alias("multi"),
        F.count_if(F.col("n_current") > 0).alias("with_current"),
        F.count(F.lit(1)).alias("n_groups"),
        *[total(c) for c in ("null_env", "inverted", "outside", "no_status", "late")],
    )


def check_entity(name: str, df: DataFrame, key: str, expected: DataFrame, temporal: bool = False) -> DataFrame:
    """C3-C8 for one table. `expected` is a one-row frame with the column `expected_keys`."""
    c = F.col
    counts = entity_counts(df, key).select("*", expected.select("expected_keys").scalar().alias("expected_keys"))
    checks = [
        Check(v.CHECK_ONE_CURRENT % name, (c("multi") == 0) & (c("with_current") == c("n_groups")),
              said(v.DETAIL_ONE_CURRENT, c("multi"), c("with_current"), c("n_groups"))),
        Check(v.CHECK_NO_NULLS % name, c("null_env") == 0, said(v.DETAIL_NO_NULLS, c("null_env"))),
        Check(v.CHECK_ORDERED % name, c("inverted") == 0, said(v.DETAIL_ORDERED, c("inverted"))),
        Check(v.CHECK_ROW_COUNT % name, c("n_groups") == c("expected_keys"),
              said(v.DETAIL_ROW_COUNT, c("n_groups"), c("expected_keys"))),
        # A NULL status passes the domain test, so its count is shown.
        Check(v.CHECK_STATUS % name, c("outside") == 0, said(v.DETAIL_STATUS, c("outside"), c("no_status"))),
    ]
    if temporal:
        checks.append(Check(v.CHECK_TEMPORAL % name, c("late") == 0, said(v.DETAIL_TEMPORAL, c("late")), hard=False))
    return evaluate(counts, checks)


def expected_from_map(mapping: DataFrame, entity_type: str) -> DataFrame:
    return mapping.filter(F.col("entity_type") == entity_type).agg(F.count_distinct("canonical_id").alias("expected_keys"))


def expected_from_feed(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count(F.lit(1)).alias("expected_keys"))


def report(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(checked: DataFrame) -> None:
    """Raise when a hard check failed. Write the report first; it has one row per check."""
    failed = [r["check_name"] for r in checked.filter("is_hard and status = 'FAIL'").select("check_name").collect()]
    if failed:
        raise QualityError(f"{len(failed)} hard assertion(s) failed: {failed}")
